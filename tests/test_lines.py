import glob
import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark import catalog_lines
from trailmark.operators import field, network, nulls, visibility

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog_lines.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog_lines.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({catalog_lines.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want))


def brute_betweenness(edges):
    """Every simple path between every pair of nodes; the shortest ones share the pair."""
    nodes = sorted({n for _, a, b, _ in edges for n in (a, b)})
    out = dict.fromkeys((k for k, *_ in edges), 0.0)

    def walks(at, goal, seen, used, length):
        if at == goal:
            yield length, used
        else:
            for k, a, b, w in edges:
                for u, v in ((a, b), (b, a)):
                    if u == at and v not in seen:
                        yield from walks(v, goal, seen | {v}, (*used, k), length + w)

    for s, t in itertools.permutations(nodes, 2):
        found = list(walks(s, t, {s}, (), 0.0))
        least = [used for length, used in found if length == min(w for w, _ in found)]
        for used in least:
            for k in used:
                out[k] += 1 / len(least)
    return {k: v / len(nodes) / (len(nodes) - 1) for k, v in out.items()}


def test_betweenness_equals_brute_force(spark):
    parts = [[(0, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 4, 1.0), (3, 4, 3, 1.0), (4, 3, 5, 2.0), (5, 3, 5, 2.0), (6, 5, 6, 4.0)], [(7, 10, 11, 3.0), (8, 11, 12, 1.0)]]
    df = spark.createDataFrame(parts[0] + parts[1], "chain long, a long, b long, length double")
    got = {r.chain: r.betweenness for r in network.betweenness(df, batch=2).collect()}
    want = brute_betweenness(parts[0]) | brute_betweenness(parts[1])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert network.betweenness(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(300).select((F.col("id") * 5 % 301).alias("a"), ((F.col("id") + 1) * 5 % 301).alias("b"))
    for one_task in (1000, 0):
        found = network.components(path, one_task).collect()
        assert len(found) == 301 and {r.component for r in found} == {0}
        assert network.components(path.limit(0), one_task).count() == 0


def test_points_at_sea_level_hide_each_other(spark):
    flat = spark.range(400).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.lit(0.0).alias("z"))
    at = spark.createDataFrame([(1, 0.0, 570.0)], "id long, x double, y double")
    other = spark.createDataFrame([(9, 570.0, 0.0), (8, -50.0, 0.0)], "id long, x double, y double")
    assert visibility.visible_share(flat, at, other, 30.0, 2000.0, eye=0.0).first()[1:] == (0, 0.0)
    assert visibility.visible_share(flat, at, other, 30.0, 2000.0).first()[1:] == (1, 1.0)  # the site off the raster does not count


def test_zone_borders_and_codes(spark):
    d = [0.0, 300.0, 400.0, 400.0, 300.0, 0.0, 260.0, 0.0]
    rows = spark.createDataFrame([("u", i, i * 200.0, v) for i, v in enumerate(d)], "unit string, seq long, s double, d double")
    (zone,) = field.separation_zones(rows).collect()
    assert (zone.i, zone.j, zone.k, zone.d) == (0, 5, 2, 400.0)
    names = spark.createDataFrame([(1, "Valle Alto - Mina"), (2, "Valle Alegre"), (3, "--")], "seq long, name string")
    assert [r.code for r in field.zone_codes(names).orderBy("seq").collect()] == ["VAAL", "VAAL2", "ZON"]


def test_null_surface_has_the_exponent_asked_for(spark):
    z = nulls.null_surface(128, 128, 3.0, [1, 2, 3], clip=(0.0, 100.0))
    assert abs(nulls.spectral_exponent(z) - 3.0) < 0.3 and abs(z.min() - 0.01) < 1e-9 and abs(z.max() - 1.01) < 1e-9
    units = spark.createDataFrame([(5, 4, 6, 2.0)], "unit long, n_rows long, n_cols long, exponent double")
    a, b = (sorted(map(tuple, nulls.null_fields(units, 2).collect())) for _ in range(2))
    assert a == b and len(a) == 48 and np.isclose(min(r[4] for r in a), 0.01)
