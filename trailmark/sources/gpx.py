"""GPX tracks and waypoints: Spark's XML reader in, plain XML out."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import utm

POINT = "_lat double, _lon double, ele double, time timestamp, hdop double, extensions struct<`osmand:speed`: double>"


def read_tracks(spark: SparkSession, path: str, epsg: int, hdop_max: float = 10.0) -> DataFrame:
    """Fixes (track, seq, ts, t, x, y, z, hdop, v, declared) in order of time, ties in order of the file. A track is a file's name, with the folder in front where
    several files have it. Points without time go; a missing speed is 0; hdop over hdop_max goes, a missing one stays; t counts from the first
    fix that is kept."""
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema(POINT).load(path).withColumns({"__path": F.col("_metadata.file_path"), "__at": F.monotonically_increasing_id()})
    part = lambda i: F.url_decode(F.replace(F.element_at(F.split("__path", "/"), i), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(part(-1), r"\.gpx$", "")
    files = raw.select(name.alias("name"), "__path").distinct()
    shared = files.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("shared"))
    speed = F.col("extensions.`osmand:speed`")
    x, y = utm(F.col("_lon"), F.col("_lat"), epsg)
    rows = raw.where("time is not null and (hdop is null or isnan(hdop) or hdop <= %f)" % hdop_max).withColumn("name", name).join(shared, "name", "left")
    track = F.when(F.col("shared"), F.concat(part(-2), F.lit("/"), "name")).otherwise(F.col("name"))
    rows = rows.select(track.alias("track"), F.col("time").alias("ts"), x.alias("x"), y.alias("y"), F.col("ele").alias("z"), "hdop", F.coalesce(speed, F.lit(0.0)).alias("v"), speed.isNotNull().alias("declared"), "__at")
    order = Window.partitionBy("track").orderBy("ts", "__at")
    return rows.withColumn("seq", F.row_number().over(order) - 1).withColumn("t", (F.unix_micros("ts") - F.unix_micros(F.first("ts").over(order))) / 1e6).drop("__at")


def need_two(fixes: DataFrame) -> DataFrame:
    """fixes, if each track has two at least; a track of one can't be measured."""
    short = [r[0] for r in fixes.groupBy("track").agg(F.count("*").alias("n")).where("n < 2").select("track").limit(5).collect()]
    if short:
        raise ValueError(f"tracks of a single fix: {', '.join(short)}")
    return fixes


def gpx_document(points: list[dict], tracks: dict[str, list[tuple[float, float]]] | None = None) -> str:
    """GPX 1.1 of waypoints (lat, lon, and any of ele, name, cmt, desc, sym) and tracks."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gpx version="1.1" creator="trailmark" xmlns="http://www.topografix.com/GPX/1/1">']
    for p in points:
        inner = "".join(f"<{k}>{escape(str(p[k]))}</{k}>" for k in ("ele", "name", "cmt", "desc", "sym") if p.get(k) is not None)
        out.append(f'<wpt lat="{p["lat"]:.7f}" lon="{p["lon"]:.7f}">{inner}</wpt>')
    for name, line in (tracks or {}).items():
        seg = "".join(f'<trkpt lat="{lat:.7f}" lon="{lon:.7f}"/>' for lat, lon in line)
        out.append(f"<trk><name>{escape(name)}</name><trkseg>{seg}</trkseg></trk>")
    return "\n".join([*out, "</gpx>"])
