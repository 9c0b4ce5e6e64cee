"""Readers of vector and raster files against files made here."""

import json
import sqlite3
import struct

import pytest

from trailmark.sources import gpx, vectors

GPX = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"/>%s</gpx>'
TRACK = '<trk><name>t</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="1.5" lon="2.5"/></trkseg></trk>'
ROUTE = '<rte><name>r</name><rtept lat="3" lon="4"/><rtept lat="5" lon="6"/></rte>'


def wkb(points, z=False):
    form = "<3d" if z else "<2d"
    return struct.pack("<BII", 1, 1002 if z else 2, len(points)) + b"".join(struct.pack(form, *p, *([9.0] if z else [])) for p in points)


def test_readers_agree(spark, tmp_path):
    line = [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1, "name": "x"}, "geometry": {"type": "MultiLineString", "coordinates": [line, line[:2]]}}, {"type": "Feature", "properties": None, "geometry": None}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [7, 8]}}]}))
    con = sqlite3.connect(tmp_path / "b.gpkg")
    con.executescript("create table gpkg_geometry_columns (table_name text, column_name text); create table roads (fid integer, geom blob, name text)")
    con.execute("insert into gpkg_geometry_columns values ('roads', 'geom')")
    con.execute("insert into roads values (1, ?, 'y')", (b"GP\0\1" + struct.pack("<i", 4326) + wkb(line, True),))
    con.execute("insert into roads values (2, null, 'z')")
    con.commit()
    con.close()
    record = struct.pack("<i4d2i", 3, 0, 1, 4, 5, 1, 3) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in line)
    (tmp_path / "c.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(record) // 2) + record)
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    (tmp_path / "c.dbf").write_bytes(struct.pack("<B3BIHH", 3, 1, 1, 1, 1, 32 + 32 + 1, 7) + b"\0" * 20 + field + b"\r" + b" " + b"w".ljust(6))
    (tmp_path / "d.gpx").write_text(GPX % (TRACK + ROUTE))
    rows = {}
    for r in vectors.read_vectors(spark, str(tmp_path)).collect():
        rows.setdefault(r.path[-3:], []).append(r)
    assert sorted((r.part, len(r.x)) for r in rows["son"]) == [(0, 1), (0, 3), (1, 2)] and {r.attributes["n"] for r in rows["son"] if r.kind != "Point"} == {"1"}
    for ext, name in (("pkg", "y"), ("shp", "w")):
        (r,) = rows[ext]
        assert (r.kind, list(r.x), list(r.y), r.attributes["name"]) == ("LineString", [0.0, 2.0, 4.0], [1.0, 3.0, 5.0], name)
    assert [(r.attributes["name"], list(r.x)) for r in rows["gpx"]] == [("t", [2.0, 2.5])]


def test_routes_and_waypoints():
    assert [list(r[4]) for r in vectors.gpx_rows((GPX % ROUTE).encode())] == [[4.0, 6.0]]
    assert list(vectors.gpx_rows((GPX % "").encode())) == [] and not vectors.is_line_file("a.GPX", (GPX % "").encode()) and vectors.is_line_file("a.kml", b"")


def test_source_order(spark, tmp_path):
    (tmp_path / "z.gpx").write_text(GPX % "")
    assert vectors.best_source(spark, str(tmp_path)) is None
    (tmp_path / "y.gpx").write_text(GPX % TRACK)
    assert vectors.best_source(spark, str(tmp_path)).endswith("y.gpx")
    (tmp_path / "qn_geocam.gpkg").write_bytes(b"")
    (tmp_path / "b.json").write_text("{}")
    assert vectors.best_source(spark, str(tmp_path)).endswith("b.json")
    assert [vectors.source_kind("auto", *x) for x in ((True, True), (False, True), (False, False))] == ["file", "tracks", "service"] and vectors.source_kind("osm", True, True) == "osm"


def test_text_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -1\n1 2 -1\n4 5 6\n")
    rows = sorted(tuple(r)[1:] for r in vectors.read_grid(spark, str(tmp_path / "g.asc")).collect())
    assert rows == [(0, 0, 1.0, 105.0, 215.0), (0, 1, 2.0, 115.0, 215.0), (1, 0, 4.0, 105.0, 205.0), (1, 1, 5.0, 115.0, 205.0), (1, 2, 6.0, 125.0, 205.0)]


def test_track_reader(spark, tmp_path):
    point = '<trkpt lat="%s" lon="-69"><ele>1</ele>%s%s%s</trkpt>'
    at = "<time>2026-01-01T00:0%d:00Z</time>"
    speed = '<extensions><osmand:speed xmlns:osmand="https://osmand.net">%s</osmand:speed></extensions>'
    body = "".join([point % (-13.5, at % 2, "<hdop>3</hdop>", speed % 1.5), point % (-13.4, at % 1, "<hdop>11</hdop>", ""), point % (-13.3, "", "", ""), point % (-13.2, at % 1, "", "")])
    for folder in "pq":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a b.gpx").write_text(f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>{body}</trkseg></trk></gpx>')
    rows = gpx.read_tracks(spark, str(tmp_path / "*" / "*.gpx"), 32719).orderBy("track", "seq").collect()
    assert len(rows) == 4 and len({r.track for r in rows}) == 2  # equal names in two folders are two tracks
    assert [(r.seq, r.t, r.v, r.declared) for r in rows[:2]] == [(0, 0.0, 0.0, False), (1, 60.0, 1.5, True)]
    with pytest.raises(ValueError):
        gpx.need_two(spark.createDataFrame([("a",)], "track string"))


def test_gpx_document():
    from xml.etree import ElementTree

    root = ElementTree.fromstring(gpx.gpx_document([{"lat": 1, "lon": 2, "name": "a<b", "ele": 3}], {"r": [(1, 2), (3, 4)]}))
    assert len(root) == 2 and root[0][1].text == "a<b"
