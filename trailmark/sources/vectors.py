"""Lines and points of GeoJSON, GeoPackage, shapefiles and GPX, and rasters of text grids. Files are read whole by one task each, as their formats
ask for it; many files are many tasks. Places come as the file has them (degrees, where it says nothing)."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import LINES, _local, kml_lines

ROWS = "path string, feature long, kind string, part long, attributes map<string,string>, x array<double>, y array<double>"
#: Extensions in order of preference (a registry says more than a recording), and the tags of a GPX file's lines.
EXTENSIONS = [".kmz", ".kml", ".gpkg", ".shp", ".geojson", ".json", ".gpx"]
GPX_LINES = [("trk", "trkpt"), ("rte", "rtept")]

Row = tuple[int, str, int, dict[str, str], list[float], list[float]]


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _parts(kind: str, c) -> list[list]:
    """Lists of places of a GeoJSON geometry."""
    deep = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}.get(kind)
    if deep is None or not c:
        return []
    if deep == 0:
        return [[c]]
    if kind == "MultiPoint":
        return [[p] for p in c]
    return [c] if deep == 1 else list(c) if deep == 2 else [ring for polygon in c for ring in polygon]


def geojson_rows(content: bytes) -> Iterator[Row]:
    data = json.loads(content)
    features = data.get("features", [data] if data.get("type") == "Feature" else [])
    for k, f in enumerate(features):
        g = f.get("geometry") or {}
        shapes = g.get("geometries") or [g]
        own = {str(a): _text(v) for a, v in (f.get("properties") or {}).items()}
        n = 0
        for s in shapes:
            for part in _parts(s.get("type", ""), s.get("coordinates")):
                yield k, s["type"], n, own, [float(p[0]) for p in part], [float(p[1]) for p in part]
                n += 1


def wkb_parts(data: bytes) -> list[tuple[str, np.ndarray]]:
    """(kind, places) of a well-known binary geometry: its lines, rings or points."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    def places(order: str, dims: int) -> np.ndarray:
        nonlocal at
        (n,) = take(order + "I")
        out = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2]
        at += 8 * n * dims
        return out

    def one() -> list[tuple[str, np.ndarray]]:
        order = "<" if take("B")[0] else ">"
        (code,) = take(order + "I")
        flags, code = code >> 29, code & 0x1FFFFFFF
        dims = 2 + (flags >> 2 & 1) + (flags >> 1 & 1) + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        if flags & 1:
            take(order + "I")
        code %= 1000
        if code == 1:
            return [("Point", np.array([take(order + f"{dims}d")[:2]]))]
        if code == 2:
            return [("LineString", places(order, dims))]
        (n,) = take(order + "I")
        if code == 3:
            return [("Polygon", places(order, dims)) for _ in range(n)]
        return [p for _ in range(n) for p in one()]

    return one()


def geopackage_rows(content: bytes) -> Iterator[Row]:
    """Features of all layers of lines and points. A geometry is a header and well-known binary."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    k = 0
    for table, column in con.execute("select table_name, column_name from gpkg_geometry_columns order by table_name").fetchall():
        found = con.execute(f'select * from "{table}"')
        names = [c[0] for c in found.description]
        for values in found:
            row = dict(zip(names, values, strict=True))
            raw = row.pop(column)
            if raw:
                envelope = [0, 32, 48, 48, 64][raw[3] >> 1 & 7]
                for n, (kind, p) in enumerate(wkb_parts(raw[8 + envelope :])):
                    yield k, kind, n, {"layer": table} | {a: _text(v) for a, v in row.items()}, p[:, 0].tolist(), p[:, 1].tolist()
            k += 1
    con.close()


def dbf_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Attributes of a shapefile's records."""
    count, first, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 13:
        fields.append((content[at : at + 11].partition(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    for i in range(count):
        at, own = first + i * size + 1, {}
        for name, width in fields:
            own[name] = content[at : at + width].decode("utf-8", "replace").strip()
            at += width
        yield own


def shapefile_rows(content: bytes, attributes: bytes | None = None) -> Iterator[Row]:
    """Features of a shapefile of points, lines or areas."""
    own = list(dbf_rows(attributes)) if attributes else []
    at, k = 100, 0
    while at + 8 <= len(content):
        (words,) = struct.unpack_from(">I", content, at + 4)
        at += 8
        (code,) = struct.unpack_from("<I", content, at)
        about = own[k] if k < len(own) else {}
        if code % 10 == 1:
            x, y = struct.unpack_from("<2d", content, at + 4)
            yield k, "Point", 0, about, [x], [y]
        elif code % 10 in (3, 5):
            parts, points = struct.unpack_from("<2I", content, at + 36)
            starts = [*struct.unpack_from(f"<{parts}I", content, at + 44), points]
            p = np.frombuffer(content, "<f8", 2 * points, at + 44 + 4 * parts).reshape(points, 2)
            for n in range(parts):
                yield k, "LineString" if code % 10 == 3 else "Polygon", n, about, p[starts[n] : starts[n + 1], 0].tolist(), p[starts[n] : starts[n + 1], 1].tolist()
        at += 2 * words
        k += 1


def gpx_rows(content: bytes) -> Iterator[Row]:
    """The tracks, else the routes; where there is neither, nothing: waypoints are no line."""
    root = ElementTree.fromstring(content)
    for tag, point in GPX_LINES:
        found = [e for e in root.iter() if _local(e.tag) == tag]
        rows = []
        for k, e in enumerate(found):
            name = next((c.text for c in e if _local(c.tag) == "name"), None)
            segments = [s for s in e if _local(s.tag) == "trkseg"] or [e]
            for n, s in enumerate(segments):
                p = [(float(c.get("lon")), float(c.get("lat"))) for c in s if _local(c.tag) == point]
                if len(p) > 1:
                    rows.append((k, "LineString", n, {"name": name}, [x for x, _ in p], [y for _, y in p]))
        if rows:
            yield from rows
            return


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of all files under path that have a known extension; a shapefile's attributes come from the file beside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    stem, ext = F.regexp_replace("path", r"\.[^./]*$", ""), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    named = files.withColumns({"stem": stem, "ext": ext})
    tables = named.where("ext = '.dbf'").select("stem", F.col("content").alias("beside"))
    shapes = named.where(F.col("ext").isin(EXTENSIONS)).join(tables, "stem", "left").select("path", "ext", "content", "beside")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                if r.ext in (".kml", ".kmz"):
                    found = [(k, "LineString", x[4], {"layer": x[1], "name": x[2], "description": x[3]}, x[5], x[6]) for k, x in enumerate(kml_lines(r.path, r.content))]
                elif r.ext == ".shp":
                    found = shapefile_rows(r.content, r.beside)
                else:
                    found = {".gpkg": geopackage_rows, ".gpx": gpx_rows}.get(r.ext, geojson_rows)(r.content)
                yield pd.DataFrame([(r.path, *x) for x in found], columns=[c.split()[0] for c in ROWS.replace("<string,", "<").split(", ")])

    return shapes.mapInPandas(parse, ROWS)


def is_line_file(name: str, content: bytes) -> bool:
    """Whether a GPX file holds a track or a route; other kinds are taken at their word."""
    if not name.lower().endswith(".gpx"):
        return True
    try:
        return next(gpx_rows(content), None) is not None
    except ElementTree.ParseError:
        return False


def best_source(spark: SparkSession, folder: str, own: tuple[str, ...] = ("qn_geocam.gpkg", "agua_osm.json", "tracks.gpkg")) -> str | None:
    """The file of a folder to take the road from: by the order of EXTENSIONS, then by name; without what the steps wrote themselves, and without
    GPX files that hold waypoints alone."""
    listed = [r[0] for r in spark.read.format("binaryFile").load(folder).select("path").collect()]  # names of one folder
    known = sorted((EXTENSIONS.index(PurePosixPath(p).suffix.lower()), PurePosixPath(p).name, p) for p in listed if PurePosixPath(p).suffix.lower() in EXTENSIONS and PurePosixPath(p).name not in own)
    for _, name, path in known:
        if not name.lower().endswith(".gpx") or is_line_file(name, bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])):
            return path
    return None


def source_kind(wanted: str, has_file: bool, has_tracks: bool) -> str:
    """Where the road comes from: what is wanted, or, for `auto`, a file, else recorded tracks, else the registry's service."""
    return wanted if wanted != "auto" else "file" if has_file else "tracks" if has_tracks else "service"


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, z, x, y) of text grids (a header of ncols, nrows, a corner, cellsize, NODATA_value); x and y are cells' centres, and cells
    without data are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                lines = io.StringIO(r.content.decode())
                head: dict[str, float] = {}
                first = lines.readline().split()
                while first and first[0][0].isalpha():
                    head[first[0].lower()] = float(first[1])
                    first = lines.readline().split()
                z = np.loadtxt(io.StringIO(" ".join(first) + "\n" + lines.read()), ndmin=2).reshape(int(head["nrows"]), int(head["ncols"]))
                row, col = np.nonzero((z != head.get("nodata_value", -9999.0)) & np.isfinite(z))
                size = head["cellsize"]
                west, south = (head.get(f"{c}llcorner", head.get(f"{c}llcenter", 0.0) - size / 2) for c in "xy")
                yield pd.DataFrame({"path": r.path, "row": row, "col": col, "z": z[row, col], "x": west + (col + 0.5) * size, "y": south + (z.shape[0] - row - 0.5) * size})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row long, col long, z double, x double, y double")


def union_sources(*tables: DataFrame) -> DataFrame:
    """Features of several sources, whatever columns each has, with their number as source."""
    out = None
    for k, t in enumerate(tables):
        own = t.withColumn("source", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


__all__ = ["EXTENSIONS", "LINES", "ROWS", "best_source", "dbf_rows", "geojson_rows", "geopackage_rows", "gpx_rows", "is_line_file", "read_grid", "read_vectors", "shapefile_rows", "source_kind", "union_sources", "wkb_parts"]
