"""Views of the test tables that stand for tracks, rasters and sites, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from events: a user is a track, two minutes count as a second, small values as standing still."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("track"), (F.row_number().over(order) - 1).alias("seq"), F.floor(micros / 120000000).cast("double").alias("t"),
        (F.col("event_id") * 37 % 101 * 3.0).alias("x"), (F.col("event_id") * 53 % 97 * 3.0).alias("y"), F.col("value").alias("z"),
        F.when(F.col("value") < 30, 0.0).otherwise(F.col("value") / 10).alias("v"),
    )


FIXES = """fixes AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (epoch_us(ts) // 120000000)::DOUBLE AS t,
  event_id * 37 % 101 * 3.0::DOUBLE AS x, event_id * 53 % 97 * 3.0::DOUBLE AS y, value AS z, CASE WHEN value < 30 THEN 0.0 ELSE value / 10 END::DOUBLE AS v FROM events),
steps AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS dl, z - lag(z) OVER w AS dz FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)),
cut AS (SELECT *, sum(CASE WHEN dt > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY seq)::BIGINT AS piece FROM steps),
rows_ AS (SELECT track, seq, t, x, y, z, v, piece, CASE WHEN f > 1 THEN dt END AS dt, CASE WHEN f > 1 THEN dl END AS dl, CASE WHEN f > 1 THEN dz END AS dz
  FROM (SELECT *, count(*) OVER (PARTITION BY track, piece) AS n, row_number() OVER (PARTITION BY track, piece ORDER BY seq) AS f FROM cut) WHERE n > 1),
stops AS (SELECT track, piece, min(seq) AS i0, max(seq) AS i1, min(t) AS t0, max(t) AS t1, avg(z) AS z FROM (SELECT *, row_number() OVER (PARTITION BY track, piece ORDER BY seq) - row_number() OVER (PARTITION BY track, piece, v <= 0 ORDER BY seq) AS run FROM rows_)
  WHERE v <= 0 GROUP BY track, piece, run HAVING count(*) > 1 AND max(t) - min(t) >= 120),
moving AS (SELECT r.* FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.track = r.track AND s.piece = r.piece AND r.seq BETWEEN s.i0 AND s.i1)),
piece_modes AS (SELECT p.track, p.piece, quantile_cont(v, 0.95) AS p95 FROM (SELECT DISTINCT track, piece FROM rows_) p LEFT JOIN moving m ON p.track = m.track AND p.piece = m.piece GROUP BY p.track, p.piece),
modes AS (SELECT track, CASE WHEN bool_or(coalesce(p95 > 4.0, false)) THEN 'vehiculo' ELSE 'pie' END AS mode FROM piece_modes GROUP BY track)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 50 columns from part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return p.select(F.floor(F.col("p_partkey") / 50).cast("long").alias("row"), (F.col("p_partkey") % 50).alias("col"), (F.col("p_partkey") * F.col("p_partkey") * 7 % 41 * 0.5).alias("z"))


CELLS = "cells AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_partkey * p_partkey * 7 % 41 * 0.5::DOUBLE AS z FROM part)"


def nodes(spark: SparkSession, sf_dir: str, size: float = 30.0) -> DataFrame:
    """The grid's cells as nodes of a graph; x and y count from the centre of cell (0, 0)."""
    c = cells(spark, sf_dir)
    return c.select((F.col("row") * 50 + F.col("col")).alias("node"), "row", "col", (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y"), "z")


def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A winding line across the grid for each region: (unit, seq, x, y)."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("u"))
    k = r.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))))
    return k.select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("unit"), "seq", ((2 + F.col("seq") * 3.75) * 30.0).alias("x"), ((4 + F.col("u") * 7 + F.col("seq") * (F.col("u") + 3) % 3 * 2.0) * 30.0).alias("y"))


NODES = "nodes AS (SELECT row * 50 + col AS node, row, col, col * 30.0::DOUBLE AS x, row * 30.0::DOUBLE AS y, z FROM cells)"
UNITS = "units AS (SELECT 'u' || r_regionkey AS unit, seq, (2 + seq * 3.75::DOUBLE) * 30 AS x, (4 + r_regionkey * 7 + seq * (r_regionkey + 3) % 3 * 2.0::DOUBLE) * 30 AS y FROM region, range(13) t(seq))"
