import glob
import os

import duckdb
import numpy as np
import pytest

from trailmark import catalog
from trailmark.functions.geo import lon_lat, utm
from trailmark.operators import paths
from trailmark.operators import trajectory as tr

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["anatomy_device_stops", "mode_rollup", "march_segments", "resample_fixed_distance", "edges_16_knight", "d8_direction", "vrm", "mean_symmetric_distance"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want))


def test_walk_stop_walk():
    t = np.arange(0, 900, 15.0)
    x = np.where(t < 300, t * 0.25, np.where(t < 600, 75.0, 75 + (t - 600) * 0.25))
    found = tr.scan_stops(t, x, np.zeros_like(x), np.ones_like(x), 20.0, 120.0, "dispersion")
    assert len(found) == 1 and t[found[0][0]] <= 300 <= 585 <= t[found[0][1]]
    v = np.where((t >= 300) & (t < 600), 0.0, 1.0)
    assert tr.scan_stops(t, x, np.zeros_like(x), v, 20.0, 120.0, "device") == [(20, 39)]


def test_projection_round_trip(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-71.2, -13.6), (-69.0, -0.5), (-66.1, -45.0)], "lon double, lat double")
    x, y = utm(F.col("lon"), F.col("lat"), 32719)
    a, b = lon_lat(F.col("x"), F.col("y"), 32719)
    for r in df.withColumns({"x": x, "y": y}).withColumns({"a": a, "b": b}).collect():
        assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9
    centre = df.withColumns({"x": x, "y": y}).where("lon = -69.0").first()
    assert abs(centre.x - 500000) < 1e-6


def test_dijkstra():
    best, before = paths.dijkstra(np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([1.0, 5.0, 1.0]), 0)
    assert best[2] == 2 and before[2] == 1


def test_marks_are_the_device_stops(spark):
    v = [1, 0, 0, 0, 1, 0, 1, 0, 0]
    rows = spark.createDataFrame([("a", 0, i, 100.0 * i, float(x), 0.0) for i, x in enumerate(v)], "track string, piece long, seq long, t double, v double, z double")
    assert [r.stop for r in tr.device_marks(rows).orderBy("seq").collect()] == [None, 1, 1, 1, None, None, None, None, None]
    marks = tr.marked(rows, tr.device_stops(rows)).orderBy("seq").collect()
    assert [r.stop for r in marks] == [None, 1, 1, 1, None, None, None, None, None]


def test_gap_of_exactly_300_seconds(spark):
    rows = [("a", i, t, 0.0, 0.0, 0.0, 1.0) for i, t in enumerate([0.0, 300.0, 601.0, 610.0])]
    df = spark.createDataFrame(rows, "track string, seq long, t double, x double, y double, z double, v double")
    assert [r.piece for r in tr.pieces(df).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_grids_and_costs(spark):
    from pyspark.sql import functions as F

    from trailmark.functions import cost, geo
    from trailmark.operators import raster

    one = spark.range(1)
    row, col = geo.cell_of(F.lit(119.0), F.lit(71.0), 100.0, 100.0, 10.0)
    x, y = geo.cell_centre(F.lit(2), F.lit(1), 100.0, 100.0, 10.0)
    low, high = geo.outward(F.lit(-0.1), F.lit(61.0), 30.0)
    got = one.select(row, col, x, y, low, high, cost.visibility_cost(F.lit(1.5)), cost.visibility_cost(F.lit(0.25)), cost.graph_gigabytes(F.lit(1 << 30), 1)).first()
    assert tuple(got)[:8] == (2, 1, 115.0, 75.0, -30.0, 90.0, 0.0, 0.75) and abs(got[8] - 0.35 * 12.9 * 20) < 1e-9
    source = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(5) for j in range(5)], "row long, col long, z double")
    target = spark.createDataFrame([(0, 0, 15.0, 85.0), (0, 1, 22.5, 85.0), (9, 9, 500.0, 85.0)], "row long, col long, x double, y double")
    assert sorted(map(tuple, raster.aligned(target, source, 0.0, 100.0, 10.0).collect())) == [(0, 0, 11.0), (0, 1, 11.75)]
    assert raster.off_grid(source, 5, 4).count() == 5 and raster.off_grid(source, 5, 5).count() == 0


def test_sessions_over_the_gap(spark):
    from trailmark.streaming.sessions import session_totals

    rows = [("a", 0), ("a", 300), ("a", 601), ("b", 0)]
    df = spark.createDataFrame(rows, "track string, s long").selectExpr("track", "timestamp_seconds(s) as ts", "cast(1 as double) as v")
    assert len(session_totals(df).collect()) == 3
