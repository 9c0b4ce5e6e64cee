"""Lines, cost graphs and networks against plain versions on small inputs."""

import glob
import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark import catalog, catalog_routes
from trailmark.operators import hydrology, lines, network, paths, raster
from trailmark.operators import trajectory as tr
from trailmark.plans import extent

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["unit_ends", "least_cost_sweep", "weight_extension", "band_ratios", "resample_fixed_count", "line_sectors", "separation_profile", "merged_chains", "corridor_cells", "clipped_lines", "touches_edge", "stop_union_merge", "flow_accumulation", "vrm_mask_p99", "horn_slope_aspect"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want))


def test_every_query_with_sql_is_registered():
    assert catalog.ORACLE_SQL.keys() <= catalog.QUERIES.keys() and catalog_routes.QUERIES.keys() <= catalog.QUERIES.keys()


def table(p, q):
    """The Fréchet table cell by cell."""
    t = np.zeros((len(p), len(q)))
    for i, j in itertools.product(range(len(p)), range(len(q))):
        d = np.hypot(*(p[i] - q[j]))
        before = [t[i - 1, j]] * (i > 0) + [t[i, j - 1]] * (j > 0) + [t[i - 1, j - 1]] * (i > 0 and j > 0)
        t[i, j] = max(min(before), d) if before else d
    return t[-1, -1]


def test_frechet_equals_the_table(spark):
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 5), (7, 3), (12, 20)):
        p, q = r.random((n, 2)), r.random((m, 2))
        assert abs(lines.frechet(p, q) - table(p, q)) < 1e-12 and lines.frechet(p, p) == 0
    rows = [("u", i, float(i), 0.0) for i in range(5)] + [("v", 0, 0.0, 0.0)]
    a = spark.createDataFrame(rows, "unit string, seq long, x double, y double")
    got = {x.unit: x.frechet for x in lines.frechet_distance(a, a.withColumn("y", F.lit(3.0)), "unit").collect()}
    assert abs(got["u"] - 3) < 1e-9 and got["v"] == 3 and lines.even(np.array([[1.0, 2.0]]), 3).tolist() == [[1.0, 2.0]] * 3


def test_simplified_lines_stay_within_the_tolerance(spark):
    r = np.random.default_rng(3)
    x, y = np.arange(60.0), r.random(60) * 4
    kept = lines.simplified_indices(x, y, 1.0)
    assert kept[0] == 0 and kept[-1] == 59 and len(kept) < 60
    for a, b in itertools.pairwise(kept):
        d = np.array([x[b] - x[a], y[b] - y[a]])
        p = np.column_stack([x[a : b + 1] - x[a], y[a : b + 1] - y[a]])
        w = np.clip(p @ d / (d @ d), 0, 1)
        assert np.hypot(*(p - w[:, None] * d).T).max() <= 1.0
    ring = np.array([0.0, 1, 1, 0, 0]), np.array([0.0, 0, 1, 1, 0])
    assert len(lines.simplified_indices(*ring, 0.1)) == 5


def test_nearest_segment_is_the_nearest(spark):
    r = np.random.default_rng(4)
    line = [(k, float(i), *xy) for k in (0, 1) for i, xy in enumerate((r.random((6, 2)) * 1000).tolist())]
    rows = spark.createDataFrame(line, "k int, seq double, x double, y double")
    points = [(k, i, *xy) for k in (0, 1, 2) for i, xy in enumerate((r.random((20, 2)) * 3000).tolist())]
    got = lines.nearest_segment(spark.createDataFrame(points, "k int, pid int, x double, y double"), lines.segments(rows, ["k"]), ["k"], 5.0).collect()
    assert len(got) == 40  # a key without segments has no nearest one
    for g in got:
        p = np.array(next(q[2:] for q in points if q[:2] == (g.k, g.pid)))
        best = np.inf
        v = np.array([q[2:] for q in line if q[0] == g.k])
        for a, b in itertools.pairwise(v):
            w = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
            best = min(best, np.hypot(*(a + w * (b - a) - p)))
        assert abs(best - g.d) < 1e-9


def test_places_parts_and_still_lines(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 3.0, 0.0), ("a", 2, 3.0, 4.0), ("b", 0, 5.0, 5.0), ("b", 1, 5.0, 5.0)], "k string, seq int, x double, y double")
    at = spark.createDataFrame([("a", s) for s in (-1.0, 0.0, 3.0, 5.0, 7.0, 9.0)], "k string, s double")
    assert sorted((r.s, r.x, r.y) for r in lines.places(rows, ["k"], at).collect()) == [(-1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (3.0, 3.0, 0.0), (5.0, 3.0, 2.0), (7.0, 3.0, 4.0), (9.0, 3.0, 4.0)]
    even = {(r.k, r.s, r.x, r.y) for r in lines.equidistant(rows.where("k = 'b'").withColumnRenamed("k", "name"), ["name"], F.lit(3)).select("name", "k", "s", "x", "y").select(F.col("k"), "s", "x", "y").collect()}
    assert even == {(0, 0.0, 5.0, 5.0), (1, 0.0, 5.0, 5.0), (2, 0.0, 5.0, 5.0)}
    with pytest.raises(ValueError):
        lines.equal_parts(rows.where("k = 'a'"), ["k"], 2)


def test_noding_touching_and_overlapping(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 5.0, -5.0, 5.0, 5.0), (3, 4.0, 0.0, 20.0, 0.0), (4, 20.0, 0.0, 20.0, 5.0), (5, 8.0, 0.0, 8.0, 3.0)], "id long, x double, y double, x1 double, y1 double")
    got = sorted((r.x0, r.y0, r.x1, r.y1, r.length) for r in lines.chains(seg, 3.0).collect())
    assert got == [(0.0, 0.0, 5.0, 0.0, 5.0), (5.0, -5.0, 5.0, 0.0, 5.0), (5.0, 0.0, 5.0, 5.0, 5.0), (5.0, 0.0, 8.0, 0.0, 3.0), (8.0, 0.0, 8.0, 3.0, 3.0), (8.0, 0.0, 20.0, 5.0, 17.0)]
    ring = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(itertools.pairwise([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]))], "id int, x double, y double, x1 double, y1 double")
    (one,) = lines.chains(ring, 1.0).collect()
    assert (one.x0, one.y0) == (one.x1, one.y1)
    named = lines.by_name(seg.withColumn("name", F.when(F.col("id") < 3, "a").otherwise("b")), "name", 3.0).collect()
    assert [(r.name, r.pieces, round(r.longest_km, 3)) for r in named] == [("b", 3, 0.017), ("a", 4, 0.005)]


def test_fill_and_accumulation_across_tiles(spark):
    r = np.random.default_rng(5)
    z = r.random((23, 17)) * 10
    z[5:9, 3:14] -= 30  # a basin over several tiles
    z[20, 10] = np.nan
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(23) for j in range(17) if np.isfinite(z[i, j])], "row long, col long, z double")
    import heapq

    want, heap, seen = z.copy(), [], ~np.isfinite(z)
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    for i, j in zip(*np.nonzero(~seen), strict=True):
        if any(not (0 <= i + a < 23 and 0 <= j + b < 17) or not np.isfinite(z[i + a, j + b]) for a, b in near):
            heapq.heappush(heap, (z[i, j], i, j))
    for _, i, j in heap:
        seen[i, j] = True
    while heap:
        h, i, j = heapq.heappop(heap)
        for a, b in near:
            if 0 <= i + a < 23 and 0 <= j + b < 17 and not seen[i + a, j + b]:
                seen[i + a, j + b] = True
                want[i + a, j + b] = max(z[i + a, j + b], h + 1e-4)
                heapq.heappush(heap, (want[i + a, j + b], i + a, j + b))
    high = hydrology.filled(cells, 6)
    got = {(r.row, r.col): r.z for r in high.collect()}
    assert all(abs(v - want[at]) < 1e-9 for at, v in got.items()) and len(got) == 23 * 17 - 1 and (want > z).any()
    flow = raster.downstream(high, 1.0).collect()
    to = {(r.row, r.col): (r.to_row, r.to_col) if r.to_row is not None else None for r in flow}
    count = dict.fromkeys(to, 0)
    for at in to:
        while at is not None:
            count[at] += 1
            at = to[at]
    found = {(r.row, r.col): r.cells for r in hydrology.accumulation(raster.downstream(high, 1.0), 6).collect()}
    assert found == count


def test_percentiles_by_bins(spark):
    v = np.concatenate([np.random.default_rng(6).standard_normal(5000), [3.0] * 400])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = raster.percentiles(df, "v", [0.0, 0.05, 0.5, 0.93, 0.99, 1.0], bins=8)
    assert np.allclose(got, np.percentile(v, [0, 5, 50, 93, 99, 100])) and raster.percentiles(df.limit(0), "v", [0.5]) == [None]
    assert raster.percentiles(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", [0.3]) == [2.0]


def test_paths_and_parts(spark):
    net = paths.Network(np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]))
    cost = np.array([1.0, 5.0, 1.0, 1.0])
    total, way = net.path(cost, 0, 3)
    assert total == 3 and net.nodes[way].tolist() == [0, 1, 2, 3] and paths.along(net, cost, way) == 3 and np.isnan(paths.along(net, cost, np.array([0, 3])))
    assert net.path(cost, 3, 0)[0] == float("inf") and net.path(cost, 9, 0)[0] == float("inf")
    with pytest.raises(ValueError):
        paths.check_weights([0.5, 0.6], 2)
    edges = spark.createDataFrame([("u", 1, 2), ("u", 3, 2), ("u", 7, 8), ("v", 1, 8)], "unit string, src long, dst long")
    parts = {}
    for r in paths.parts_of(edges).collect():
        parts.setdefault((r.unit, r.component), set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [[1, 2, 3], [1, 8], [7, 8]]
    assert paths.lattice_size(3, 20) == paths.lattice(spark, 3, 20).count() == 231
    w = {r.weight_id: r.w for r in paths.model_weights(spark, ["a", "b", "c"], ["a", "c"], 2).collect()}
    assert w == {0: [0.0, 0.0, 1.0], 1: [0.5, 0.0, 0.5], 2: [1.0, 0.0, 0.0]}


def test_random_paths_are_the_same_again(spark):
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.lit(0.0).alias("z"))
    e = raster.edges(cells, 1.0, raster.OFFSETS_8).select(F.lit("u").alias("unit"), (F.col("row") * 10 + F.col("col")).alias("src"), (F.col("to_row") * 10 + F.col("to_col")).alias("dst"), "l", F.array("phi").alias("phi"), "row", "col")
    ends = spark.createDataFrame([("u", 0, 99, [(float(i), float(i)) for i in range(10)])], "unit string, start long, goal long, observed array<struct<x:double,y:double>>")
    a, b = (sorted(map(tuple, paths.null_paths(e, ends, 4, 2.0, [1.0], batch=n).collect())) for n in (4, 3))
    straight = 9 * 2**0.5
    assert a == b and len(a) == 4 and all(r[3] >= straight - 1e-9 and r[2] >= 0 for r in a)
    (best,) = paths.sweep(e, ends, spark.createDataFrame([(0, [1.0])], "weight_id long, w array<double>")).collect()
    assert abs(best.cost - straight) < 1e-9 and best.d == 0 and abs(best.length - straight) < 1e-9 and len(best.path) == 10


def test_device_speed_at_the_middle_of_a_step(spark):
    rows = spark.createDataFrame([("a", i, 10.0 * i, 20.0 * i, 0.0, 0.0, float(i)) for i in range(8)], "track string, seq long, t double, x double, y double, z double, v double").withColumn("piece", F.lit(0).cast("long"))
    got = tr.step_speeds(tr.resample(rows, ["track", "piece"]), ["track", "piece"], rows=rows).orderBy("k").collect()
    assert len(got) == 4 and all(abs(r.device - (r.t + 7.5) / 10) < 1e-9 and abs(r.v - 2) < 1e-9 for r in got)


def test_stretches_over_ranges_and_lines_of_tracks(spark):
    rows = []
    for k, (t0, x0) in enumerate([(0.0, 0.0), (1000.0, 90.0), (2000.0, 500.0), (40000.0, 590.0)]):
        rows += [(f"2026_{k}_Mon n{k}", i, t0 + 60 * i, x0 + 30.0 * i, 0.0 if i != 1 else 3.0, 0.0, 1.0) for i in range(4)]
    fixes = spark.createDataFrame(rows, "track string, seq long, t double, x double, y double, z double, v double")
    got = [r.stretch for r in tr.stretches(tr.track_ends(fixes)).orderBy("start_t").collect()]
    assert got == [1, 1, 2, 3]
    made = tr.as_lines(fixes, 5.0).orderBy("stretch", "seq").collect()
    assert {(r.stretch, r.label) for r in made} == {("1", "n0 - n1"), ("2", "n2"), ("3", "n3")} and [r.x for r in made if r.stretch == "1"] == [0.0, 180.0]


def test_networks_by_tolerance(spark):
    r = np.random.default_rng(7)
    ends = [(k, 10.0 * (k % 6), 10.0 * (k // 6)) for k in range(30)]
    chains = spark.createDataFrame([(i, x, y, x + 9.0 + float(r.random()), y, 20000.0) for i, x, y in ends], "chain long, x0 double, y0 double, x1 double, y1 double, length double")
    seg = chains.select("chain", F.col("x0").alias("x"), F.col("y0").alias("y"), "x1", "y1")
    middles = chains.select(F.col("chain").alias("feature"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y"))
    rows = [x.asDict() for x in network.tolerance_rows(chains, middles, seg, [0.0, 1.5], 5.0).collect()]
    assert [x["components"] for x in rows] == [30, 5] and rows[0]["corridors"] == 0 and rows[1]["corridors"] == 5 and rows[1]["features_corridors"] == 30 and rows[1]["largest_km"] == 120.0
    assert network.verdict(rows) == "unstable" and network.verdict(rows[:1]) == "fragments" and network.verdict(rows, 0.5) == "unstable, trees"
    good = [{"large_share": 0.5, "rho_corridors": v, "common_corridors": 80} for v in (None, 0.9)]
    assert network.verdict(good) == "stable" and network.gained({"largest_km": 100, "large_share": 0.3}, {"largest_km": 131, "large_share": 0.3}) and not network.gained({"largest_km": 100, "large_share": 0.3}, {"largest_km": 110, "large_share": 0.35})
    share = network.tree_share(network.corridors(network.graph(chains, 1.5))).first()
    assert (share.corridors, share.trees, share.no_choice) == (5, 5, 1.0)
    by = network.by_stretch(spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.1), (None, 1.0, 0.9), ("c", 1.0, None)], "name string, km double, value double")).collect()
    assert [(x.name, x.most, x.km, x.features) for x in by] == [("(sin nombre)", 0.9, 1.0, 1), ("a", 0.5, 3.0, 2)]


def test_outside_and_summary(spark):
    seg = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 10.0, 0.0), ("a", 0, 1, 10.0, 0.0, 10.0, 30.0), ("b", 1, 0, 1.0, 1.0, 2.0, 2.0)], "k string, feature int, part int, x double, y double, x1 double, y1 double")
    assert [(r.k, r.outside) for r in extent.outside_length(seg, "k", (0.0, -1.0, 10.0, 10.0), 1.0).collect()] == [("a", 20.0)]
    row = extent.source_summary(seg).first()
    assert (row.features, row.parts, row.little) == (2, 3, True)
    with pytest.raises(ValueError):
        raster.corridor_mask(spark.createDataFrame([(0, 0)], "row long, col long"), seg.withColumns({"x": F.lit(9e5), "x1": F.lit(9e5)}), 30.0, 60.0)
    found = raster.repeated_edges(spark.createDataFrame([(0, 0, 0, 1)] * 2, "row int, col int, to_row int, to_col int"))
    assert found.count() == 1


def broadcasts(df):
    """What a query's plan broadcasts for equi-joins, a line a join."""
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]


def test_no_join_along_the_grid_is_broadcast(spark):
    cells = spark.createDataFrame([(i, j, 0.5 * ((i * j) % 3)) for i in range(6) for j in range(6)], "row long, col long, z double")
    found = raster.edges(cells, 1.0, raster.OFFSETS_8)
    assert not broadcasts(found) and found.where("row = 2 and col = 2").count() > 0
    assert not broadcasts(catalog_routes.cost_along_path(spark, SF))


def test_nodes_of_the_grid_are_not_broadcast(spark):
    members = spark.createDataFrame([("u", 0), ("u", 1), ("u", 3)], "unit string, node long")
    nodes = spark.range(4).selectExpr("id as node", "id div 2 as row", "id % 2 as col")
    places = spark.createDataFrame([("u", "start", 0, 0), ("u", "goal", 1, 0)], "unit string, name string, row long, col long")
    found = paths.nearest_node(members, nodes, places)
    assert len(broadcasts(found)) == 1  # of the places
    assert {r["name"]: r["node"] for r in found.collect()} == {"start": 0, "goal": 0}


def test_models_share_one_sweep(spark):
    held = catalog_routes._held(spark, SF)
    assert "MapCoGroups" not in held._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(f"select model, median, mean, n from ({catalog.ORACLE_SQL['model_summary']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in catalog_routes.model_summary(spark, SF).select("model", "median", "mean", "n").collect())


def test_cost_along_with_a_missing_edge_and_a_single_node(spark):
    path = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 1), ("b", 1, 9), ("c", 0, 4)], "unit string, seq long, node long")
    e = spark.createDataFrame([("a", 1, 2, 1.5), ("a", 2, 3, 2.0), ("b", 1, 2, 9.0)], "unit string, src long, dst long, cost double")
    assert {r["unit"]: r["cost"] for r in paths.cost_along(path, e).collect()} == {"a": 3.5, "b": None, "c": 0.0}
