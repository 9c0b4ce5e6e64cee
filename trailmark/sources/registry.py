"""Road registries and the like: KML and KMZ, Overpass answers, tables of sites."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category, html_attributes

LINES = "path string, layer string, name string, description string, part long, lon array<double>, lat array<double>"
# Attribute names of the registry, and accepted column names of site tables.
ATTRIBUTES = ["nombre", "tramnomb", "longitud", "dptonomb", "provnomb", "distnomb", "ubigeo", "ccppprox", "TipoCamino"]
LON, LAT, NAME = ["lon", "longitud", "x"], ["lat", "latitud", "y"], ["nombre", "Name", "name", "NOMBRE", "sitio"]
OVERPASS = "elements array<struct<id: bigint, tags: map<string, string>, geometry: array<struct<lon: double, lat: double>>>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def kml_lines(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of LINES for each line of each placemark; other geometries are passed over. A KMZ holds its KML first by name order of
    the archive; one without any is an error."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            inside = [n for n in z.namelist() if n.lower().endswith(".kml")]
            if not inside:
                raise ValueError(f"no KML in {path}")
            content = z.read(inside[0])
    layers: list[str] = []
    names: list[str] = []
    for event, e in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        tag = _local(e.tag)
        if event == "start":
            names.append(tag)
            if tag == "Folder":
                layers.append("")
            continue
        names.pop()
        if tag == "name" and names and names[-1] == "Folder":
            layers[-1] = (e.text or "").strip()
        elif tag == "Folder":
            layers.pop()
        elif tag == "Placemark":
            text = {_local(c.tag): c.text for c in e}
            lines = [c.text or "" for g in e.iter() if _local(g.tag) == "LineString" for c in g if _local(c.tag) == "coordinates"]
            for part, line in enumerate(lines):
                points = [tuple(map(float, p.split(",")[:2])) for p in line.split()]
                if len(points) > 1:
                    yield path, layers[-1] if layers else "", text.get("name"), text.get("description"), part, [p[0] for p in points], [p[1] for p in points]
            e.clear()


def read_registry(spark: SparkSession, path: str, observed_only: bool = True, layers: list[str] | None = None) -> DataFrame:
    """Lines of KML and KMZ files with the registry's attributes, their layer and its category. Without named layers only
    observed ones are kept, unless observed_only is false."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame(list(kml_lines(r.path, r.content)), columns=[c.split()[0] for c in LINES.split(", ")])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, LINES)
    told = html_attributes(F.coalesce("description", F.lit("")))
    rows = rows.withColumn("told", told).withColumns({"category": category(F.col("layer"))} | {a: F.col("told").getItem(a) for a in ATTRIBUTES}).drop("told")
    if layers is not None:
        return rows.where(F.col("layer").isin(layers))
    return rows.where("category = 'observado'") if observed_only else rows


def layer_names(rows: DataFrame) -> DataFrame:
    """(layer, category, lines): what layers there are."""
    return rows.groupBy("layer", category(F.col("layer")).alias("category")).agg(F.count("*").alias("lines")).orderBy("layer")


def by_category(rows: DataFrame) -> DataFrame:
    """(category, features, km, share) of features (category, length in metres): share of all kilometres; what no category names is `otro`."""
    sums = rows.groupBy(F.coalesce("category", F.lit("otro")).alias("category")).agg(F.count("*").alias("features"), (F.sum("length") / 1000).alias("km"))
    total = sums.agg(F.sum("km").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("category", "features", "km", F.when(F.col("all") > 0, F.col("km") / F.col("all")).alias("share"))  # one row


def sites_summary(sites: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(sites, inside): how many sites (lon, lat) there are, and in the box."""
    inside = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    return sites.agg(F.count("*").alias("sites"), F.count_if(inside).alias("inside"))


def without_excluded(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows whose stretch name is none of the given ones, letter for letter."""
    return rows.where(~F.coalesce("tramnomb", F.lit("")).isin(names)) if names else rows


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """(id, tags, geometry) of the elements with two points or more, from saved answers."""
    raw = spark.read.schema(OVERPASS).option("multiLine", True).json(path)
    return raw.select(F.explode("elements").alias("e")).select("e.*").where(F.size(F.filter("geometry", lambda p: p.isNotNull())) >= 2)


def lakes(elements: DataFrame, least_m2: float) -> DataFrame:
    """Closed rings of natural=water of at least least_m2, by the shoelace formula on geometry (x, y in metres)."""
    g = F.col("geometry")
    following = F.slice(g, 2, F.size(g) - 1)
    twice = F.aggregate(F.zip_with(F.slice(g, 1, F.size(g) - 1), following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    ring = (F.size(g) >= 4) & (g[0] == F.element_at(g, -1)) & (F.col("tags").getItem("natural") == "water")
    return elements.where(ring).withColumn("area_m2", F.abs(twice) / 2).where(F.col("area_m2") >= least_m2)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat) of a table of sites with any of the accepted column names; rows without a place go."""
    raw = spark.read.option("header", True).csv(path)

    def first(names: list[str]):
        return next((c for n in names for c in raw.columns if c.strip() == n), None)

    lon, lat, name = first(LON), first(LAT), first(NAME)
    if lon is None or lat is None:
        raise ValueError(f"no columns for a place in {raw.columns}")
    place = raw.select((F.col(f"`{name}`") if name else F.lit(None).cast("string")).alias("name"), *[F.expr(f"try_cast(`{c}` as double)").alias(n) for c, n in ((lon, "lon"), (lat, "lat"))])
    return place.where("lon is not null and lat is not null")
