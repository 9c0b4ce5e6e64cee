"""Queries over networks, lines of sight, zones, rank correlation and null surfaces, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import field, network, nulls, visibility
from .plans.views import CELLS, FIXES, cells, fixes

SIZE = 30.0
TOLERANCE = 1.5
RADIUS = 300.0


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _chains(s, d) -> DataFrame:
    """A chain for each customer, between places of a lattice; first ends are off by up to two metres."""
    k, p, q = F.col("c_custkey"), F.col("c_custkey") * 7 % 1009, F.col("c_custkey") * 17 % 1499
    return s.read.parquet(f"{d}/customer.parquet").select(k.cast("long").alias("chain"), (p % 40 * 10.0 + k % 3).alias("x0"), (F.floor(p / 40) * 10.0).alias("y0"), (q % 40 * 10.0).alias("x1"), (F.floor(q / 40) * 10.0).alias("y1"), (1.0 + k % 89).alias("length"))


CHAINS = """chains AS (SELECT c_custkey AS chain, c_custkey * 7 % 1009 % 40 * 10.0::DOUBLE + c_custkey % 3 AS x0, c_custkey * 7 % 1009 // 40 * 10.0::DOUBLE AS y0,
  c_custkey * 17 % 1499 % 40 * 10.0::DOUBLE AS x1, c_custkey * 17 % 1499 // 40 * 10.0::DOUBLE AS y1, 1.0::DOUBLE + c_custkey % 89 AS length FROM customer),
ends AS (SELECT 2 * chain AS e, x0 AS x, y0 AS y FROM chains UNION ALL SELECT 2 * chain + 1, x1, y1 FROM chains),
places AS (SELECT x, y, min(e) AS n FROM ends GROUP BY x, y),
near AS (SELECT a.n AS a, b.n AS b FROM places a JOIN places b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2.25),
reach(n, r) AS (SELECT n, n FROM places UNION SELECT reach.n, near.b FROM reach JOIN near ON near.a = reach.r),
roots AS (SELECT n, min(r) AS node FROM reach GROUP BY n), nodes AS (SELECT e, node FROM ends JOIN places USING (x, y) JOIN roots USING (n)),
edges AS (SELECT chain, length, i.node AS a, j.node AS b FROM chains JOIN nodes i ON i.e = 2 * chain JOIN nodes j ON j.e = 2 * chain + 1 WHERE i.node <> j.node),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk(n, r) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT walk.n, both_.b FROM walk JOIN both_ ON both_.a = walk.r),
part AS (SELECT n, min(r) AS component FROM walk GROUP BY n)"""


def nodes_within_tolerance(s, d):
    return network.end_nodes(_chains(s, d), TOLERANCE).select(F.col("end").alias("end_id"), "node")


def network_edges(s, d):
    return network.graph(_chains(s, d))


def network_measures(s, d):
    return _rounded(network.measures(network.graph(_chains(s, d), TOLERANCE)), "length", "alpha")


def edge_betweenness(s, d):
    return _rounded(network.betweenness(network.graph(_chains(s, d), TOLERANCE)), "betweenness")


def rank_correlation(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return _rounded(network.spearman(li), "rho")


def line_of_sight(s, d):
    nodes = cells(s, d).select((F.col("row") * 50 + F.col("col")).alias("id"), (F.col("col") * SIZE).alias("x"), (F.col("row") * SIZE).alias("y"))
    sites = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 53.0 + 7).alias("x"), (F.col("n_nationkey") * 47.0 + 11).alias("y"))
    return _rounded(visibility.visible_share(cells(s, d), nodes, sites, SIZE, RADIUS), "share")


def separation_zones(s, d):
    f = fixes(s, d).select(F.col("track").alias("unit"), F.col("seq").cast("long").alias("seq"), (F.col("seq") * 30.0).alias("s"), F.col("x").alias("d"))
    return field.separation_zones(f, 150.0, 60.0)


def zone_codes(s, d):
    parts = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit("-"), "p_brand").alias("name"), F.col("p_size").alias("km"), (F.col("p_retailprice") * 3).alias("climb"))
    return field.zone_codes(parts).select("seq", "code", field.field_days(F.col("km"), F.col("climb")).alias("days"))


def surface_exponents(s, d):
    return _rounded(nulls.exponents(cells(s, d).withColumn("tile", F.floor(F.col("row") / 20)), "tile"), "exponent")


def null_surfaces(s, d):
    return _rounded(nulls.null_fields(surface_exponents(s, d).withColumnRenamed("tile", "unit"), 3), "z")


_Q = [nodes_within_tolerance, network_edges, network_measures, edge_betweenness, rank_correlation, line_of_sight, separation_zones, zone_codes, surface_exponents, null_surfaces]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

ORACLE_SQL: dict[str, str] = {
    "nodes_within_tolerance": f"WITH RECURSIVE {CHAINS} SELECT e AS end_id, node FROM nodes",
    "network_edges": f"WITH RECURSIVE {CHAINS} SELECT chain, i.n AS a, j.n AS b, length FROM chains JOIN places i ON i.x = x0 AND i.y = y0 JOIN places j ON j.x = x1 AND j.y = y1 WHERE i.n <> j.n",
    "network_measures": f"""WITH RECURSIVE {CHAINS}, deg AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM edges UNION ALL SELECT b FROM edges) GROUP BY n),
      per AS (SELECT component, count(*) AS nodes, max(degree) AS max_degree, count(*) FILTER (degree = 1) AS dead_ends FROM deg JOIN part USING (n) GROUP BY component),
      len AS (SELECT component, count(*) AS edges, sum(length) AS length FROM edges JOIN part ON n = a GROUP BY component)
      SELECT component, nodes, max_degree, dead_ends, edges, round(length, 6) AS length, edges - nodes + 1 AS cycles, round(CASE WHEN nodes > 2 THEN (edges - nodes + 1) / (2 * nodes - 5) ELSE 0 END::DOUBLE, 6) AS alpha FROM per JOIN len USING (component)""",
    "rank_correlation": "WITH r AS (SELECT l_returnflag AS key, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem) SELECT key, round(corr(a, b), 6) AS rho FROM r GROUP BY key",
    "line_of_sight": f"""WITH {CELLS}, sites AS (SELECT n_nationkey AS site, n_nationkey * 53.0::DOUBLE + 7 AS sx, n_nationkey * 47.0::DOUBLE + 11 AS sy FROM nation), c4 AS (SELECT i, j FROM range(2) a(i), range(2) b(j)),
      cz AS (SELECT site, sx, sy, CASE WHEN count(z) = 4 THEN sum((CASE i WHEN 1 THEN sy / 30 - floor(sy / 30) ELSE 1 - (sy / 30 - floor(sy / 30)) END) * (CASE j WHEN 1 THEN sx / 30 - floor(sx / 30) ELSE 1 - (sx / 30 - floor(sx / 30)) END) * z) END AS sz
        FROM sites, c4 LEFT JOIN cells ON row = floor(sy / 30)::BIGINT + i AND col = floor(sx / 30)::BIGINT + j GROUP BY site, sx, sy),
      pairs AS (SELECT row * 50 + col AS id, col * 30.0::DOUBLE AS x, row * 30.0::DOUBLE AS y, z + 1.65 AS z, cz.* FROM cells, cz WHERE sz IS NOT NULL AND pow(col * 30.0::DOUBLE - sx, 2) + pow(row * 30.0::DOUBLE - sy, 2) <= 90000),
      rays AS (SELECT *, k / 21.0::DOUBLE AS s, pow(x - sx, 2) + pow(y - sy, 2) AS d2, (sy + k / 21.0::DOUBLE * (y - sy)) / 30 AS fr, (sx + k / 21.0::DOUBLE * (x - sx)) / 30 AS fc FROM pairs, range(1, 21) t(k)),
      w AS (SELECT *, CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w FROM rays, c4),
      smp AS (SELECT w.id, w.site, w.s, max(w.sz + (w.z - w.sz) * w.s - 0.87::DOUBLE * w.d2 * w.s * (1 - w.s) / 12742000.0) AS bound, CASE WHEN count(c.z) = count(*) THEN sum(w.w * c.z) END AS h FROM w LEFT JOIN cells c ON c.row = floor(w.fr)::BIGINT + i AND c.col = floor(w.fc)::BIGINT + j WHERE w.w > 0 GROUP BY w.id, w.site, w.s),
      seen AS (SELECT id, site FROM smp GROUP BY id, site HAVING NOT bool_or(coalesce(h > bound, false)))
      SELECT row * 50 + col AS id, coalesce(v, 0) AS visible, round(coalesce(v, 0) / (SELECT count(sz) FROM cz)::DOUBLE, 6) AS share FROM cells LEFT JOIN (SELECT id, count(*) AS v FROM seen GROUP BY id) q ON q.id = row * 50 + col""",
    "separation_zones": f"WITH {FIXES}, m AS (SELECT track AS unit, seq, seq * 30.0::DOUBLE AS s, x AS d, x > 150 AS high, lag(seq) OVER w AS p, lead(seq) OVER w AS n, row_number() OVER w - row_number() OVER (PARTITION BY track, x > 150 ORDER BY seq) AS run FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)) SELECT unit, min(s) AS s0, max(s) AS s1, max(d) AS d, arg_max(seq, struct_pack(a := d, b := -seq)) AS k, arg_min(coalesce(p, seq), seq) AS i, arg_max(coalesce(n, seq), seq) AS j FROM m WHERE high GROUP BY unit, run HAVING max(s) - min(s) >= 60",
    "zone_codes": "WITH b AS (SELECT p_partkey AS seq, p_size AS km, p_retailprice * 3 AS climb, list_filter(string_split_regex(upper(p_name || '-' || p_brand), '[^0-9A-Z]+'), lambda w: w <> '') AS words FROM part), c AS (SELECT *, coalesce(left(words[1], 2), '') || coalesce(left(words[2], 2), '') AS base FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS k FROM c) SELECT seq, CASE WHEN k = 1 THEN base ELSE base || k END AS code, greatest(1, ceil(greatest(km / 14.0::DOUBLE, climb / 1200.0::DOUBLE)))::BIGINT AS days FROM n",
}
