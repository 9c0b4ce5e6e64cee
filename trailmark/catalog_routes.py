"""Queries over cost graphs of units, sweeps of weights on them, lines and registries, and the same results in SQL. Least costs have a
recursive twin: costs of nodes by key, lowered until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cost
from .operators import field, lines, network, paths, raster
from .operators import trajectory as tr
from .plans import extent
from .plans.views import CELLS, FIXES, NODES, UNITS, cells, fixes, nodes, unit_lines
from .sources import vectors

SIZE, RADIUS, WIDTHS, PARTS = 30.0, 150.0, [2, 3, 5], 21


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _graph(s, d) -> DataFrame:
    """Two components: the physical cost, and one that grows to the east."""
    e = raster.edges(cells(s, d), SIZE, raster.OFFSETS_8)
    return e.select((F.col("row") * 50 + F.col("col")).alias("src"), (F.col("to_row") * 50 + F.col("to_col")).alias("dst"), "l", F.array("phi", (F.col("col") + F.col("to_col")) / 100.0).alias("phi"), "row", "col")


_horner = "280.5::DOUBLE"
for _c in cost.MINETTI[1:]:
    _horner = f"({_horner}) * g + {_c}"
GRAPH = f"""{CELLS}, {NODES}, {UNITS}, off AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE i <> 0 OR j <> 0),
slopes AS (SELECT a.node AS src, b.node AS dst, a.col AS c0, b.col AS c1, 30 * sqrt(i * i + j * j)::DOUBLE AS l, (b.z - a.z) / (30 * sqrt(i * i + j * j))::DOUBLE AS g FROM nodes a, off JOIN nodes b ON b.row = a.row + i AND b.col = a.col + j),
edges AS (SELECT src, dst, l, ({_horner}) / 2.5 AS phi, (c0 + c1) / 100.0::DOUBLE AS east FROM slopes WHERE abs(g) <= 0.45),
members AS (SELECT unit, node, min(sqrt(pow(n.x - u.x, 2) + pow(n.y - u.y, 2))) AS d FROM nodes n JOIN units u ON pow(n.x - u.x, 2) + pow(n.y - u.y, 2) <= 22500 GROUP BY unit, node),
marks AS (SELECT unit, name, floor(y / 30 + 0.5)::BIGINT AS row, floor(x / 30 + 0.5)::BIGINT AS col FROM (SELECT unit, x, y, CASE seq WHEN 0 THEN 'start' WHEN 12 THEN 'goal' END AS name FROM units) WHERE name IS NOT NULL),
ranked AS (SELECT k.unit, k.name, node, row_number() OVER (PARTITION BY k.unit, k.name ORDER BY pow(n.row - k.row, 2) + pow(n.col - k.col, 2), node) AS q FROM marks k JOIN members m ON m.unit = k.unit JOIN nodes n USING (node)),
ends AS (SELECT unit, max(node) FILTER (name = 'start') AS start, max(node) FILTER (name = 'goal') AS goal FROM ranked WHERE q = 1 GROUP BY unit),
own AS (SELECT a.unit, src, dst, l, phi, east FROM edges JOIN members a ON a.node = src JOIN members b ON b.node = dst AND b.unit = a.unit)"""


def _least(key: str, edges: str, start: str) -> str:
    """Least costs `reach` (key..., node, dist) from rows of `start` (key..., node) over `edges` (key..., src, dst, c)."""
    same = " AND ".join(f"e.{k} = r.{k}" for k in key.split(", "))
    known = " AND ".join(f"o.{k} = e.{k}" for k in key.split(", "))
    names = ", ".join(f"e.{k}" for k in key.split(", "))
    return f"""reach({key}, node, dist) USING KEY ({key}, node) AS (SELECT {key}, node, 0.0::DOUBLE FROM {start}
  UNION SELECT {names}, e.dst, min(r.dist + e.c) FROM reach r JOIN {edges} e ON {same} AND e.src = r.node LEFT JOIN recurring.reach o ON {known} AND o.node = e.dst WHERE o.dist IS NULL OR r.dist + e.c < o.dist - 1e-9 GROUP BY {names}, e.dst)"""


def _units(s, d):
    return paths.units(nodes(s, d), _graph(s, d), unit_lines(s, d), RADIUS, SIZE)


def unit_nodes(s, d):
    return _rounded(paths.around(nodes(s, d), unit_lines(s, d), RADIUS), "d")


def induced_subgraph(s, d):
    members, edges, _ = _units(s, d)
    return _rounded(edges.select("unit", "src", "dst", "l"), "l")


def unit_ends(s, d):
    return _units(s, d)[2].select("unit", "start", "goal")


def node_to_edge_mean(s, d):
    n = nodes(s, d)
    return _rounded(paths.with_component(_graph(s, d), 1, n.select("node", F.col("z").alias("value"))).select("src", "dst", F.element_at("phi", 2).alias("value")), "value")


def cost_along_path(s, d):
    path = nodes(s, d).where("row % 5 = 0").select((F.col("row") * 10 + F.floor(F.col("col") / 8)).alias("unit"), F.col("col").alias("seq"), "node")
    return _rounded(paths.cost_along(path, s_edges(s, d)), "cost")


def s_edges(s, d) -> DataFrame:
    e = _graph(s, d).select("src", "dst", (F.col("l") * F.element_at("phi", 1)).alias("cost"))
    return e.withColumn("unit", F.floor(F.col("src") / 50) * 10 + F.floor(F.col("src") % 50 / 8))


def _swept(s, d) -> DataFrame:
    _, edges, ends = _units(s, d)
    return paths.sweep(edges, ends, paths.model_weights(s, ["physical", "east"], ["physical", "east"], PARTS), size=SIZE)


SWEPT = f"weights AS (SELECT m AS weight_id, m / {PARTS}.0::DOUBLE AS w0, ({PARTS} - m) / {PARTS}.0::DOUBLE AS w1 FROM range({PARTS + 1}) t(m)), priced AS (SELECT unit, weight_id, src, dst, l * (w0 * phi + w1 * east) AS c FROM own, weights), begin_ AS (SELECT unit, weight_id, start AS node FROM ends, weights), {_least('unit, weight_id', 'priced', 'begin_')}, swept AS (SELECT unit, weight_id, dist AS d FROM reach JOIN ends USING (unit) WHERE node = goal), least AS (SELECT unit, min(d) AS m FROM swept GROUP BY unit)"


def least_cost_sweep(s, d):
    return _rounded(_swept(s, d).select("unit", "weight_id", "cost"), "cost")


def _costs(s, d) -> DataFrame:
    return _swept(s, d).select("unit", "weight_id", F.col("cost").alias("d"))


def near_optimal_set(s, d):
    return _rounded(paths.near_optimal(_costs(s, d), 0.25).select("unit", "weight_id", "d"), "d")


def argmin_weights(s, d):
    return _rounded(paths.optimum(_costs(s, d)), "d")


def weight_extension(s, d):
    w = paths.model_weights(s, ["physical", "east"], ["physical", "east"], PARTS)
    return _rounded(paths.extension(paths.near_optimal(_costs(s, d), 0.25), w).withColumn("component", F.col("component").cast("long")), "low", "high", "centre")


TAUS = [i / 50 for i in range(26)]


def jaccard_profile(s, d):
    return _rounded(paths.jaccard_profile(_costs(s, d), TAUS), "jaccard")


def p_empirical(s, d):
    c = _costs(s, d)
    return _rounded(paths.empirical_p(c.where("weight_id = 12").select("unit", "d"), c.where("weight_id <> 12").select("unit", "d")), "p")


def null_cost_percentiles(s, d):
    c = _costs(s, d).withColumnRenamed("d", "ratio")
    return _rounded(paths.cost_null(c.where("weight_id = 12").select("unit", "ratio"), c.where("weight_id <> 12").select("unit", "ratio")), "ratio", "p25", "median", "p75", "p")


def _blocks(s, d) -> DataFrame:
    """Each unit's line in four blocks of vertices, as units of their own."""
    b = unit_lines(s, d).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).where("seq between block * 3 and block * 3 + 3")
    return b.select(F.concat_ws("|", "unit", "block").alias("unit"), "seq", "x", "y")


def _block_costs(s, d) -> DataFrame:
    _, edges, ends = paths.units(nodes(s, d), _graph(s, d), _blocks(s, d), RADIUS, SIZE)
    swept = paths.sweep(edges, ends, paths.model_weights(s, ["physical", "east"], ["physical", "east"], 5), size=SIZE)
    return swept.select(F.split("unit", r"\|")[0].alias("unit"), F.split("unit", r"\|")[1].cast("long").alias("block"), "weight_id", F.col("cost").alias("d"))


BLOCKS = GRAPH.replace(UNITS, UNITS.replace("units AS", "lines AS") + ", units AS (SELECT unit || '|' || block AS unit, seq, x, y FROM lines, range(4) t(block) WHERE seq BETWEEN block * 3 AND block * 3 + 3)").replace(
    "CASE seq WHEN 0 THEN 'start' WHEN 12 THEN 'goal' END AS name FROM units", "CASE seq WHEN min(seq) OVER (PARTITION BY unit) THEN 'start' WHEN max(seq) OVER (PARTITION BY unit) THEN 'goal' END AS name FROM units"
)
BLOCK_COSTS = SWEPT.replace(f"{PARTS}.0::DOUBLE", "5.0::DOUBLE").replace(f"({PARTS} - m)", "(5 - m)").replace(f"range({PARTS + 1})", "range(6)") + ", c AS (SELECT split_part(unit, '|', 1) AS unit, split_part(unit, '|', 2)::BIGINT AS block, weight_id, d FROM swept)"


def blocked_cv(s, d):
    return _rounded(paths.blocked_validation(_block_costs(s, d)), "fit", "held_out")


def _held(s, d) -> DataFrame:
    c = lines.cut_lineage(_block_costs(s, d))  # a row for each block and weight; both models read it
    plain = paths.blocked_validation(c.where("weight_id = 5")).withColumn("model", F.lit("reference"))
    return plain.unionByName(paths.blocked_validation(c).withColumn("model", F.lit("extended")))


def model_summary(s, d):
    return _rounded(paths.model_summary(_held(s, d)), "median", "mean")


def paired_wins(s, d):
    return paths.paired_wins(_held(s, d))


HELD = "f AS (SELECT a.unit, a.block, a.weight_id, a.d, avg(b.d) AS fit FROM c a JOIN c b ON a.unit = b.unit AND a.weight_id = b.weight_id AND a.block <> b.block GROUP BY a.unit, a.block, a.weight_id, a.d), held AS (SELECT 'extended' AS model, unit, block, weight_id, fit, d AS held_out FROM (SELECT *, row_number() OVER (PARTITION BY unit, block ORDER BY fit, weight_id) AS n FROM f) WHERE n = 1 UNION ALL SELECT 'reference', unit, block, weight_id, fit, d FROM f WHERE weight_id = 5)"


def cost_ratio_by_band(s, d):
    _, edges, ends = _units(s, d)
    n, g = nodes(s, d), _graph(s, d)
    return _rounded(paths.band_costs(n, g, unit_lines(s, d), ends, [1.0, 0.0], WIDTHS, SIZE), "cost")


def band_ratios(s, d):
    _, edges, ends = _units(s, d)
    free = paths.sweep(edges, ends, s.createDataFrame([(0, [1.0, 0.0])], "weight_id long, w array<double>"), size=SIZE).select("unit", "cost")
    bands = paths.band_costs(nodes(s, d), _graph(s, d), unit_lines(s, d), ends, [1.0, 0.0], WIDTHS, SIZE)
    return _rounded(paths.band_ratios(bands, free).withColumn("first_width", F.col("first_width").cast("long")), "optimum", *[f"ratio_{w}" for w in WIDTHS], "first_ratio", "drop")


SEGMENTS = "seg AS (SELECT *, sum(l) OVER (PARTITION BY unit ORDER BY seq) - l AS s0, sum(l) OVER (PARTITION BY unit ORDER BY seq) AS s1 FROM (SELECT *, sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) AS l FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM units WINDOW w AS (PARTITION BY unit ORDER BY seq)) WHERE x1 IS NOT NULL))"
DENSE = f"{SEGMENTS}, total AS (SELECT unit, max(s1) AS len, greatest(2, ceil(max(s1) / 15)::BIGINT + 1) AS n FROM seg GROUP BY unit), spots AS (SELECT unit, k, k * len / (n - 1) AS s FROM total, range(100000) t(k) WHERE k < n), dense AS (SELECT unit, k, x + (x1 - x) * w AS x, y + (y1 - y) * w AS y FROM (SELECT p.unit, p.k, x, y, x1, y1, least(1.0, (s - s0) / l) AS w, row_number() OVER (PARTITION BY p.unit, p.k ORDER BY s0 DESC) AS q FROM spots p JOIN seg ON seg.unit = p.unit AND s0 <= s + 1e-9) WHERE q = 1)"
BANDS = f"""{DENSE}, near AS (SELECT unit, node, min(sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2))) AS d FROM nodes n JOIN dense p ON pow(n.x - p.x, 2) + pow(n.y - p.y, 2) <= 22500 GROUP BY unit, node),
band AS (SELECT unit, width, node FROM near, (SELECT unnest({WIDTHS}) AS width) WHERE d <= width * 30),
bandends AS (SELECT b.unit, b.width, e.name, b.node, row_number() OVER (PARTITION BY b.unit, b.width, e.name ORDER BY pow(n.row - t.row, 2) + pow(n.col - t.col, 2), b.node) AS q FROM band b JOIN nodes n USING (node) JOIN (SELECT unit, 'start' AS name, start AS node FROM ends UNION ALL SELECT unit, 'goal', goal FROM ends) e ON e.unit = b.unit JOIN nodes t ON t.node = e.node),
bandgoal AS (SELECT unit, width, max(node) FILTER (name = 'start') AS start, max(node) FILTER (name = 'goal') AS goal FROM bandends WHERE q = 1 GROUP BY unit, width),
banded AS (SELECT a.unit, a.width, src, dst, l * phi AS c FROM edges JOIN band a ON a.node = src JOIN band b ON b.node = dst AND b.unit = a.unit AND b.width = a.width UNION ALL SELECT unit, 0, src, dst, l * phi FROM own),
begin_ AS (SELECT unit, width, start AS node FROM bandgoal UNION ALL SELECT unit, 0, start FROM ends), {_least('unit, width', 'banded', 'begin_')},
bandcost AS (SELECT g.unit, g.width, dist AS cost FROM (SELECT unit, width, goal FROM bandgoal UNION ALL SELECT unit, 0, goal FROM ends) g LEFT JOIN reach r ON r.unit = g.unit AND r.width = g.width AND r.node = g.goal)"""


# ---------------------------------------------------------------- lines


def resample_fixed_count(s, d):
    f = fixes(s, d).select(F.col("track"), "seq", "x", "y")
    return _rounded(lines.equidistant(f, ["track"], F.lit(20)).select("track", "k", "x", "y"), "x", "y")


def line_sectors(s, d):
    return _rounded(lines.equal_parts(unit_lines(s, d), ["unit"], 3, 100.0).select("unit", F.col("part").cast("long").alias("part"), F.col("seq").cast("long").alias("seq"), "x", "y"), "x", "y")


def _other_lines(s, d) -> DataFrame:
    """Each unit's line, moved, in place of a modelled one."""
    return unit_lines(s, d).select("unit", "seq", (F.col("x") + F.col("seq") % 4 * 20).alias("x"), (F.col("y") + 45 + F.col("seq") % 5 * 25).alias("y"))


OTHER = "other AS (SELECT unit, seq, x + seq % 4 * 20 AS x, y + 45 + seq % 5 * 25 AS y FROM units), oseg AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM other WINDOW w AS (PARTITION BY unit ORDER BY seq)) WHERE x1 IS NOT NULL)"
PROFILE = f"""{SEGMENTS}, {OTHER}, total AS (SELECT unit, max(s1) AS len, greatest(2, floor(max(s1) / 30)::BIGINT + 1) AS n FROM seg GROUP BY unit), spots AS (SELECT unit, k, k * len / (n - 1) AS s FROM total, range(100000) t(k) WHERE k < n),
places AS (SELECT unit, k, s, x + (x1 - x) * w AS x, y + (y1 - y) * w AS y FROM (SELECT p.unit, p.k, p.s, x, y, x1, y1, least(1.0, (s - s0) / l) AS w, row_number() OVER (PARTITION BY p.unit, p.k ORDER BY s0 DESC) AS q FROM spots p JOIN seg ON seg.unit = p.unit AND s0 <= s + 1e-9) WHERE q = 1),
feet AS (SELECT p.unit, k, p.s, p.x, p.y, o.x AS ox, o.y AS oy, o.x1 - o.x AS dx, o.y1 - o.y AS dy, least(1.0, greatest(0.0, ((p.x - o.x) * (o.x1 - o.x) + (p.y - o.y) * (o.y1 - o.y)) / (pow(o.x1 - o.x, 2) + pow(o.y1 - o.y, 2)))) AS w FROM places p JOIN oseg o USING (unit)),
profile AS (SELECT unit, k AS seq, s, x, y, min(sqrt(pow(ox + w * dx - x, 2) + pow(oy + w * dy - y, 2))) AS d FROM feet GROUP BY unit, k, s, x, y)"""


def separation_profile(s, d):
    return _rounded(lines.profile(unit_lines(s, d), _other_lines(s, d), ["unit"]).select("unit", "seq", "s", "d"), "s", "d")


def divergence_zones(s, d):
    return _rounded(field.separation_zones(lines.profile(unit_lines(s, d), _other_lines(s, d), ["unit"]), 90.0, 60.0).select("unit", "s0", "s1", "d", "i", "j"), "s0", "s1", "d")


ZONES = "m AS (SELECT *, d > 90 AS high, lag(seq) OVER w AS p, lead(seq) OVER w AS n, row_number() OVER w - row_number() OVER (PARTITION BY unit, d > 90 ORDER BY seq) AS run FROM profile WINDOW w AS (PARTITION BY unit ORDER BY seq)), zones AS (SELECT unit, min(s) AS s0, max(s) AS s1, max(d) AS d, arg_min(coalesce(p, seq), seq) AS i, arg_max(coalesce(n, seq), seq) AS j FROM m WHERE high GROUP BY unit, run HAVING max(s) - min(s) >= 60)"


def top_zones_with_control(s, d):
    z = field.separation_zones(lines.profile(unit_lines(s, d), _other_lines(s, d), ["unit"]), 90.0, 60.0)
    rows = z.select("unit", F.row_number().over(network.Window.partitionBy("unit").orderBy("s0")).cast("long").alias("zone"), ((F.col("s1") - F.col("s0")) / 1000).alias("observed_km"), (F.col("d") / 100).alias("ratio"))
    ratios = rows.groupBy("unit").agg(F.round(F.avg("ratio"), 9).alias("ratio"))
    return _rounded(field.chosen_zones(rows, ratios, 3, 1.0).withColumn("priority", F.col("priority").cast("long")), "observed_km", "ratio")


def _crossing(s, d) -> DataFrame:
    """Segments of the units' lines and of straight ones across them."""
    seg = lines.segments(unit_lines(s, d), ["unit"])
    up = s.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 6").select((F.lit(1000) + F.col("n_nationkey")).cast("long").alias("id"), (F.col("n_nationkey") * 217.0 + 110).alias("x"), F.lit(-20.0).alias("y"), (F.col("n_nationkey") * 217.0 + 150).alias("x1"), F.lit(1250.0).alias("y1"))
    return seg.select((F.substring("unit", 2, 9).cast("long") * 100 + F.col("seq")).alias("id"), "x", "y", "x1", "y1").unionByName(up)


def noded_lines(s, d):
    return lines.noded(_crossing(s, d), 200.0).select(*[F.round(c, 3).alias(c) for c in ("x", "y", "x1", "y1")])


def merged_chains(s, d):
    return lines.chains(_crossing(s, d), 200.0).select(*[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1", "length")])


NODED = f"""{UNITS}, {SEGMENTS}, raw AS (SELECT substr(unit, 2)::BIGINT * 100 + seq AS id, x, y, x1, y1 FROM seg UNION ALL SELECT 1000 + n_nationkey, n_nationkey * 217.0::DOUBLE + 110, -20.0, n_nationkey * 217.0::DOUBLE + 150, 1250.0 FROM nation WHERE n_nationkey < 6),
pairs AS (SELECT a.id, a.x, a.y, a.x1 - a.x AS dx, a.y1 - a.y AS dy, b.x - a.x AS fx, b.y - a.y AS fy, b.x1 - b.x AS ex, b.y1 - b.y AS ey FROM raw a JOIN raw b ON a.id <> b.id),
cuts AS (SELECT id, (fx * ey - fy * ex) / (dx * ey - dy * ex) AS t FROM pairs WHERE abs(dx * ey - dy * ex) > 1e-12 AND (fx * dy - fy * dx) / (dx * ey - dy * ex) BETWEEN -1e-9 AND 1 + 1e-9),
ts AS (SELECT id, t FROM cuts WHERE t > 1e-9 AND t < 1 - 1e-9 UNION SELECT id, 0.0 FROM raw UNION SELECT id, 1.0 FROM raw),
bits AS (SELECT id, t, lead(t) OVER (PARTITION BY id ORDER BY t) AS u FROM ts),
ends_ AS (SELECT round(x + (x1 - x) * t, 6) AS ax, round(y + (y1 - y) * t, 6) AS ay, round(x + (x1 - x) * u, 6) AS bx, round(y + (y1 - y) * u, 6) AS by_ FROM bits JOIN raw USING (id) WHERE u IS NOT NULL),
pieces AS (SELECT row_number() OVER () AS piece, * FROM (SELECT DISTINCT CASE WHEN (ax, ay) < (bx, by_) THEN ax ELSE bx END AS x, CASE WHEN (ax, ay) < (bx, by_) THEN ay ELSE by_ END AS y, CASE WHEN (ax, ay) < (bx, by_) THEN bx ELSE ax END AS x1, CASE WHEN (ax, ay) < (bx, by_) THEN by_ ELSE ay END AS y1 FROM ends_ WHERE ax <> bx OR ay <> by_))"""


def names_by_length(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("seg "), F.col("c_mktsegment")).alias("name"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40 * 10.0).alias("x"), F.lit(0.0).alias("y"), (F.col("c_custkey") % 40 * 10.0 + 3).alias("x1"), (F.col("c_custkey") % 7 + 4.0).alias("y1"))
    return _rounded(lines.by_name(c, "name", 100.0, merge=False), "km", "longest_km")


def running_box(s, d):
    b = extent.bounds(fixes(s, d).select("track", "x", "y"), "track")
    return extent.running_bounds(b, ["x1", "track"]).select("track", "n", *[F.col(f"all_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def registry_labels(s, d):
    f = fixes(s, d).select("track", "seq", "x", "y")
    return _rounded(extent.spread(f, lines.lengths(f, ["track"]), "track"), "diagonal", "length", "ratio")


def clipped_lines(s, d):
    box = (200.0, 150.0, 900.0, 700.0)
    seg = lines.segments(unit_lines(s, d), ["unit"]).select("unit", "seq", "x", "y", "x1", "y1")
    return _rounded(extent.inside(seg, box), "x", "y", "x1", "y1")


def corridor_cells(s, d):
    seg = lines.segments(unit_lines(s, d), ["unit"]).select("x", "y", "x1", "y1")
    return raster.corridor_mask(cells(s, d), seg, SIZE, 60.0, cells(s, d).where("row % 11 = 7"))


def sites_drop_ends(s, d):
    sites = s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") * 53 % 1400 * 1.0).alias("x"), (F.col("s_suppkey") * 71 % 1100 * 1.0).alias("y"), "s_suppkey")
    ends = unit_lines(s, d).where("seq in (0, 12)").select("x", "y")
    return raster.without_near(sites, ends, 250.0).select("s_suppkey", "x", "y")


def touches_edge(s, d):
    n = nodes(s, d)
    members = n.where("row between 2 and 30").select((F.col("row") % 3).alias("unit"), "node").unionByName(n.where("row > 1").select(F.lit(9).cast("long").alias("unit"), "node"))
    path = n.where("col between 3 and 9 and row between 3 and 20").select((F.col("row") % 3).alias("unit"), "node").unionByName(n.where("row = 5 and col between 2 and 40").select(F.lit(9).cast("long").alias("unit"), "node"))
    return paths.touches_edge(path, members, n)


def majority_agreement(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_orderkey") % 4 + 3).alias("cut"), (F.col("o_custkey") % 6).alias("k"), "o_orderpriority").agg(F.count("*").alias("n"))
    best = o.where("k < cut").groupBy("cut", "k").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("dominant"))
    return _rounded(paths.majority_agreement(best.select("cut", (F.col("k") / F.col("cut")).alias("start"), ((F.col("k") + 1) / F.col("cut")).alias("stop"), "dominant")), "agreement")


def value_counts(s, d):
    return extent.value_counts(s.read.parquet(f"{d}/events.parquet"), "event_type")


def json_props(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return _rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total")), "total")


def exclusion_anti(s, d):
    from .sources.registry import without_excluded

    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).alias("tramnomb"))
    return without_excluded(p, [r[0] for r in p.where("tramnomb is not null").groupBy("tramnomb").count().orderBy("tramnomb").limit(3).collect()])


def union_sources(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    r = s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("region"))
    return vectors.union_sources(n, r).withColumn("source", F.col("source").cast("long"))


def track_names(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("2026-06-0"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("_20-00_Tue"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise("")).alias("name"))
    return c.select("c_custkey", tr.track_label(F.col("name")).alias("label"), tr.stretch_label(F.col("name"), F.lit("2026-06-09_01-02_Mon building")).alias("stretch"))


def ascent_descent(s, d):
    rows = tr.long_pieces(tr.pieces(fixes(s, d)))
    return _rounded(rows.groupBy("track").agg(F.sum(F.when(F.col("dz") > 0, F.col("dz"))).alias("up_m"), F.sum(F.when(F.col("dz") < 0, -F.col("dz"))).alias("down_m")), "up_m", "down_m")


def corridor_km(s, d):
    from .catalog_lines import TOLERANCE, _chains

    return _rounded(network.corridors(network.graph(_chains(s, d), TOLERANCE), 0.1).withColumn("km", F.round("km", 6)), "km", "alpha")


def frechet_distance(s, d):
    return _rounded(lines.frechet_distance(unit_lines(s, d), _other_lines(s, d), "unit"), "frechet")


def line_simplification(s, d):
    return lines.simplify(fixes(s, d).select("track", "seq", "x", "y"), "track", 60.0)


_Q = [unit_nodes, induced_subgraph, unit_ends, node_to_edge_mean, cost_along_path, least_cost_sweep, near_optimal_set, argmin_weights, weight_extension, jaccard_profile, p_empirical, null_cost_percentiles, blocked_cv, model_summary, paired_wins, cost_ratio_by_band, band_ratios, resample_fixed_count, line_sectors, separation_profile, divergence_zones, top_zones_with_control, noded_lines, merged_chains, names_by_length, running_box, registry_labels, clipped_lines, corridor_cells, sites_drop_ends, touches_edge, majority_agreement, value_counts, json_props, exclusion_anti, union_sources, track_names, ascent_descent, corridor_km, frechet_distance, line_simplification]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_r = lambda *names: ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)
_g = f"WITH RECURSIVE {GRAPH}"
ORACLE_SQL: dict[str, str] = {
    "unit_nodes": f"{_g} SELECT unit, node, round(d, 6) AS d FROM members",
    "induced_subgraph": f"{_g} SELECT unit, src, dst, round(l, 6) AS l FROM own",
    "unit_ends": f"{_g} SELECT * FROM ends",
    "node_to_edge_mean": f"{_g} SELECT src, dst, round((a.z + b.z) / 2, 6) AS value FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst",
    "cost_along_path": f"{_g}, path AS (SELECT row * 10 + col // 8 AS unit, col AS seq, node, lead(node) OVER (PARTITION BY row * 10 + col // 8 ORDER BY col) AS dst FROM nodes WHERE row % 5 = 0) SELECT p.unit, round(CASE WHEN count(p.dst) = 0 THEN 0 WHEN count(p.dst) = count(e.l) THEN sum(e.l * e.phi) END, 6) AS cost FROM path p LEFT JOIN edges e ON e.src = p.node AND e.dst = p.dst GROUP BY p.unit",
    "least_cost_sweep": f"{_g}, {SWEPT} SELECT unit, weight_id, round(d, 6) AS cost FROM swept",
    "near_optimal_set": f"{_g}, {SWEPT} SELECT unit, weight_id, round(d, 6) AS d FROM swept JOIN least USING (unit) WHERE d <= 1.25::DOUBLE * m",
    "argmin_weights": f"{_g}, {SWEPT} SELECT unit, weight_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY d, weight_id) AS n FROM swept) WHERE n = 1",
    "weight_extension": f"{_g}, {SWEPT}, n AS (SELECT unit, w0, w1 FROM swept JOIN least USING (unit) JOIN weights USING (weight_id) WHERE d <= 1.25::DOUBLE * m), both_ AS (SELECT unit, 0::BIGINT AS component, w0 AS v FROM n UNION ALL SELECT unit, 1, w1 FROM n) SELECT unit, component, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS centre FROM both_ GROUP BY unit, component",
    "jaccard_profile": f"{_g}, {SWEPT}, k AS (SELECT unit, weight_id, tau, CASE WHEN d <= (1 + tau) * m THEN 1 ELSE 0 END AS inside FROM swept JOIN least USING (unit), (SELECT unnest({TAUS}::DOUBLE[]) AS tau)) SELECT a.unit AS unit_a, b.unit AS unit_b, a.tau, round(sum(a.inside * b.inside) / nullif(sum(greatest(a.inside, b.inside)), 0), 6) AS jaccard FROM k a JOIN k b ON a.weight_id = b.weight_id AND a.tau = b.tau AND a.unit < b.unit GROUP BY a.unit, b.unit, a.tau",
    "p_empirical": f"{_g}, {SWEPT} SELECT o.unit, round((1 + count(*) FILTER (n.d <= o.d)) / (count(n.d) + 1), 6) AS p FROM swept o JOIN swept n ON o.unit = n.unit AND n.weight_id <> 12 WHERE o.weight_id = 12 GROUP BY o.unit",
    "null_cost_percentiles": f"{_g}, {SWEPT} SELECT o.unit, round(o.d, 6) AS ratio, round(quantile_cont(n.d, 0.25), 6) AS p25, round(quantile_cont(n.d, 0.5), 6) AS median, round(quantile_cont(n.d, 0.75), 6) AS p75, round((1 + count(*) FILTER (n.d <= o.d)) / (count(n.d) + 1), 6) AS p, count(*) AS n FROM swept o JOIN swept n ON o.unit = n.unit AND n.weight_id <> 12 WHERE o.weight_id = 12 GROUP BY o.unit, o.d",
    "blocked_cv": f"WITH RECURSIVE {BLOCKS}, {BLOCK_COSTS}, {HELD} SELECT unit, block, weight_id, round(fit, 6) AS fit, round(held_out, 6) AS held_out FROM held WHERE model = 'extended'",
    "model_summary": f"WITH RECURSIVE {BLOCKS}, {BLOCK_COSTS}, {HELD} SELECT model, round(quantile_cont(held_out, 0.5), 6) AS median, round(avg(held_out), 6) AS mean, count(*) AS n FROM held GROUP BY model",
    "paired_wins": f"WITH RECURSIVE {BLOCKS}, {BLOCK_COSTS}, {HELD}, p AS (SELECT max(held_out) FILTER (model = 'reference') AS a, max(held_out) FILTER (model = 'extended') AS b FROM held GROUP BY unit, block) SELECT count(*) AS pairs, count(*) FILTER (b < a) AS wins, 2 * count(*) FILTER (b < a) > count(*) AS evidence FROM p WHERE a IS NOT NULL AND b IS NOT NULL",
    "cost_ratio_by_band": f"{_g}, {BANDS} SELECT unit, width::INTEGER AS width, round(cost, 6) AS cost FROM bandcost WHERE width > 0",
    "band_ratios": f"{_g}, {BANDS}, r AS (SELECT b.unit, b.width, f.cost AS optimum, b.cost / f.cost AS ratio FROM bandcost b JOIN bandcost f ON f.unit = b.unit AND f.width = 0 WHERE b.width > 0), a AS (SELECT unit, optimum, {', '.join(f'max(ratio) FILTER (width = {w}) AS ratio_{w}' for w in WIDTHS)}, min(width) FILTER (ratio IS NOT NULL) AS first_width, arg_min(ratio, width) FILTER (ratio IS NOT NULL) AS first_ratio, arg_max(ratio, width) FILTER (ratio IS NOT NULL) AS last_ratio, count(ratio) AS n FROM r GROUP BY unit, optimum), e AS (SELECT *, CASE WHEN n > 1 AND first_ratio > 0 THEN (first_ratio - last_ratio) / first_ratio END AS drop FROM a) SELECT unit, first_width::BIGINT AS first_width, {_r('optimum', *[f'ratio_{w}' for w in WIDTHS], 'first_ratio', 'drop')}, drop <= 0.2 AS steady FROM e",
    "resample_fixed_count": f"WITH {FIXES}, units AS (SELECT track AS unit, seq, x, y FROM fixes), {SEGMENTS}, total AS (SELECT unit, max(s1) AS len FROM seg GROUP BY unit), spots AS (SELECT unit, k, k * len / 19 AS s FROM total, range(20) t(k)) SELECT unit AS track, k, round(x + (x1 - x) * w, 6) AS x, round(y + (y1 - y) * w, 6) AS y FROM (SELECT p.unit, p.k, x, y, x1, y1, least(1.0, (s - s0) / l) AS w, row_number() OVER (PARTITION BY p.unit, p.k ORDER BY s0 DESC) AS q FROM spots p JOIN seg ON seg.unit = p.unit AND s0 <= s + 1e-9 WHERE l > 0) WHERE q = 1",
    "line_sectors": f"WITH {UNITS}, {SEGMENTS}, total AS (SELECT unit, max(s1) AS len FROM seg GROUP BY unit), cuts AS (SELECT unit, part, len * (part - 1) / 3 AS a, len * part / 3 AS b FROM total, range(1, 4) t(part)), over_ AS (SELECT c.unit, part, unnest([greatest(s0, a), least(s1, b)]) AS at_, x, y, x1, y1, s0, s1 FROM cuts c JOIN seg ON seg.unit = c.unit AND s1 > a AND s0 < b), pts AS (SELECT unit, part, at_, min(x + (x1 - x) * (at_ - s0) / (s1 - s0)) AS x, min(y + (y1 - y) * (at_ - s0) / (s1 - s0)) AS y FROM over_ GROUP BY unit, part, at_) SELECT unit, part, row_number() OVER (PARTITION BY unit, part ORDER BY at_) - 1 AS seq, round(x, 6) AS x, round(y, 6) AS y FROM pts",
    "separation_profile": f"WITH {UNITS}, {PROFILE} SELECT unit, seq, round(s, 6) AS s, round(d, 6) AS d FROM profile",
    "divergence_zones": f"WITH {UNITS}, {PROFILE}, {ZONES} SELECT unit, round(s0, 6) AS s0, round(s1, 6) AS s1, round(d, 6) AS d, i, j FROM zones",
    "top_zones_with_control": f"WITH {UNITS}, {PROFILE}, {ZONES}, z AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY s0) AS zone, (s1 - s0) / 1000 AS observed_km, d / 100 AS ratio FROM zones), best AS (SELECT unit AS best FROM (SELECT unit, round(avg(ratio), 9) AS r FROM z GROUP BY unit) ORDER BY r, unit LIMIT 1), short AS (SELECT * FROM z WHERE observed_km <= 1), top AS (SELECT * FROM short ORDER BY ratio DESC, unit, zone LIMIT 3), ctl AS (SELECT * FROM short WHERE unit IN (SELECT best FROM best) AND unit NOT IN (SELECT unit FROM top) ORDER BY observed_km DESC, zone LIMIT 1), u AS (SELECT *, 0 AS k FROM top UNION ALL SELECT *, 1 FROM ctl) SELECT unit, zone, round(observed_km, 6) AS observed_km, round(ratio, 6) AS ratio, row_number() OVER (ORDER BY k, ratio DESC, unit, zone) AS priority, unit IN (SELECT best FROM best) AS control FROM u",
    "noded_lines": f"WITH {NODED} SELECT round(x, 3) AS x, round(y, 3) AS y, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM pieces",
    "merged_chains": f"WITH RECURSIVE {NODED}, tips AS (SELECT piece, x, y FROM pieces UNION ALL SELECT piece, x1, y1 FROM pieces), two AS (SELECT min(piece) AS a, max(piece) AS b FROM tips GROUP BY x, y HAVING count(*) = 2 AND min(piece) < max(piece)), links AS (SELECT a, b FROM two UNION SELECT b, a FROM two), walk(n, r) AS (SELECT piece, piece FROM pieces UNION SELECT walk.n, links.b FROM walk JOIN links ON links.a = walk.r), part AS (SELECT n AS piece, min(r) AS chain FROM walk GROUP BY n), len AS (SELECT chain, sum(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2))) AS length, min(struct_pack(x := x, y := y)) AS any_ FROM pieces JOIN part USING (piece) GROUP BY chain), free AS (SELECT chain, min(p) AS a, max(p) AS b FROM (SELECT chain, struct_pack(x := x, y := y) AS p, count(*) AS n FROM tips JOIN part USING (piece) GROUP BY chain, x, y) WHERE n % 2 = 1 GROUP BY chain) SELECT round(coalesce(a, any_).x, 3) AS x0, round(coalesce(a, any_).y, 3) AS y0, round(coalesce(b, any_).x, 3) AS x1, round(coalesce(b, any_).y, 3) AS y1, round(length, 3) AS length FROM len LEFT JOIN free USING (chain)",
    "names_by_length": "SELECT 'seg ' || c_mktsegment AS name, count(*) AS pieces, round(sum(sqrt(9 + pow(c_custkey % 7 + 4.0::DOUBLE, 2))) / 1000, 6) AS km, round(max(sqrt(9 + pow(c_custkey % 7 + 4.0::DOUBLE, 2))) / 1000, 6) AS longest_km FROM customer GROUP BY c_mktsegment",
    "running_box": f"WITH {FIXES}, b AS (SELECT track, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fixes GROUP BY track) SELECT track, count(*) OVER w AS n, min(x0) OVER w AS x0, min(y0) OVER w AS y0, max(x1) OVER w AS x1, max(y1) OVER w AS y1 FROM b WINDOW w AS (ORDER BY x1, track)",
    "registry_labels": f"WITH {FIXES}, b AS (SELECT track, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS diagonal FROM fixes GROUP BY track), l AS (SELECT track, coalesce(sum(dl), 0) AS length FROM steps GROUP BY track) SELECT track, round(diagonal, 6) AS diagonal, round(length, 6) AS length, round(CASE WHEN length > 0 THEN diagonal / length ELSE 'infinity'::DOUBLE END, 6) AS ratio, CASE WHEN length > 0 THEN diagonal / length ELSE 'infinity'::DOUBLE END > 5 AS label FROM b JOIN l USING (track)",
    "clipped_lines": f"WITH {UNITS}, {SEGMENTS}, t AS (SELECT unit, seq, x, y, x1 - x AS dx, y1 - y AS dy, greatest(0.0, CASE WHEN x1 > x THEN (200 - x) / (x1 - x) WHEN x1 < x THEN (900 - x) / (x1 - x) ELSE 0 END, CASE WHEN y1 > y THEN (150 - y) / (y1 - y) WHEN y1 < y THEN (700 - y) / (y1 - y) ELSE 0 END) AS a, least(1.0, CASE WHEN x1 > x THEN (900 - x) / (x1 - x) WHEN x1 < x THEN (200 - x) / (x1 - x) ELSE 1 END, CASE WHEN y1 > y THEN (700 - y) / (y1 - y) WHEN y1 < y THEN (150 - y) / (y1 - y) ELSE 1 END) AS b FROM seg WHERE NOT (x1 = x AND (x < 200 OR x > 900)) AND NOT (y1 = y AND (y < 150 OR y > 700))) SELECT unit, seq, round(x + a * dx, 6) AS x, round(y + a * dy, 6) AS y, round(x + b * dx, 6) AS x1, round(y + b * dy, 6) AS y1 FROM t WHERE a < b",
    "corridor_cells": f"WITH {CELLS}, {UNITS}, {SEGMENTS}, k AS (SELECT row, col, col * 30.0::DOUBLE AS px, row * 30.0::DOUBLE AS py, x, y, x1 - x AS dx, y1 - y AS dy FROM cells, seg), c AS (SELECT row, col, i, j, x, y, dx, dy, px, py, px + i * 15 AS qx, py + j * 15 AS qy FROM k, (SELECT unnest([-1, 1]) AS i), (SELECT unnest([-1, 1]) AS j)), f AS (SELECT *, least(1.0, greatest(0.0, ((qx - x) * dx + (qy - y) * dy) / (dx * dx + dy * dy))) AS w FROM c), m AS (SELECT row, col, min(least(pow(x + w * dx - qx, 2) + pow(y + w * dy - qy, 2), pow(greatest(abs(x - px) - 15, 0), 2) + pow(greatest(abs(y - py) - 15, 0), 2), pow(greatest(abs(x + dx - px) - 15, 0), 2) + pow(greatest(abs(y + dy - py) - 15, 0), 2))) AS d2 FROM f GROUP BY row, col) SELECT row, col FROM m WHERE d2 <= 3600 AND row % 11 <> 7",
    "sites_drop_ends": f"WITH {UNITS}, t AS (SELECT s_suppkey, s_suppkey * 53 % 1400 * 1.0::DOUBLE AS x, s_suppkey * 71 % 1100 * 1.0::DOUBLE AS y FROM supplier) SELECT s_suppkey, x, y FROM t WHERE NOT EXISTS (SELECT 1 FROM units u WHERE seq IN (0, 12) AND pow(t.x - u.x, 2) + pow(t.y - u.y, 2) <= 62500)",
    "touches_edge": f"WITH {CELLS}, {NODES}, members AS (SELECT row % 3 AS unit, row, col FROM nodes WHERE row BETWEEN 2 AND 30 UNION ALL SELECT 9, row, col FROM nodes WHERE row > 1), path AS (SELECT row % 3 AS unit, row, col FROM nodes WHERE col BETWEEN 3 AND 9 AND row BETWEEN 3 AND 20 UNION ALL SELECT 9, row, col FROM nodes WHERE row = 5 AND col BETWEEN 2 AND 40), b AS (SELECT DISTINCT unit, row + i AS row, col + j AS col FROM path, range(-1, 2) t(i), range(-1, 2) u(j)) SELECT b.unit, bool_or(m.row IS NULL) AS touches FROM b LEFT JOIN members m ON m.unit = b.unit AND m.row = b.row AND m.col = b.col GROUP BY b.unit",
    "majority_agreement": "WITH o AS (SELECT o_orderkey % 4 + 3 AS cut, o_custkey % 6 AS k, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), best AS (SELECT cut, k, p AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY cut, k ORDER BY n DESC, p) AS q FROM o WHERE k < cut) WHERE q = 1), v AS (SELECT i, dominant, count(*) AS n FROM best, range(200) t(i) WHERE k / cut::DOUBLE <= 0.001::DOUBLE + i * (0.998::DOUBLE / 199) AND 0.001::DOUBLE + i * (0.998::DOUBLE / 199) < (k + 1) / cut::DOUBLE GROUP BY i, dominant), s AS (SELECT i, max(n) / sum(n) AS share FROM v GROUP BY i) SELECT round(avg(share), 6) AS agreement, avg(share) < 0.75 AS unstable FROM s",
    "value_counts": "SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type",
    "json_props": "SELECT event_type, count(k) AS n, round(sum(k), 6) AS total FROM (SELECT event_type, (props::JSON ->> '$.k')::DOUBLE AS k FROM events) GROUP BY event_type",
    "exclusion_anti": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS tramnomb FROM part) SELECT * FROM p WHERE coalesce(tramnomb, '') NOT IN (SELECT tramnomb FROM p WHERE tramnomb IS NOT NULL GROUP BY tramnomb ORDER BY tramnomb LIMIT 3)",
    "union_sources": "SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::VARCHAR AS region, 0::BIGINT AS source FROM nation UNION ALL SELECT r_regionkey::BIGINT, NULL, r_name, 1 FROM region",
    "track_names": "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) ELSE '2026-06-0' || (c_custkey % 9 + 1) || '_20-00_Tue' END AS label FROM customer) SELECT c_custkey, label, CASE WHEN label = 'building' THEN label ELSE label || ' - building' END AS stretch FROM t",
    "ascent_descent": f"WITH {FIXES} SELECT track, round(sum(dz) FILTER (dz > 0), 6) AS up_m, round(-sum(dz) FILTER (dz < 0), 6) AS down_m FROM rows_ GROUP BY track",
}


def _corridor_sql() -> str:
    from .catalog_lines import CHAINS

    return f"""WITH RECURSIVE {CHAINS}, deg AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM edges UNION ALL SELECT b FROM edges) GROUP BY n), per AS (SELECT component, count(*) AS nodes FROM deg JOIN part USING (n) GROUP BY component),
      len AS (SELECT component, count(*) AS edges, sum(length) / 1000 AS km FROM edges JOIN part ON n = a GROUP BY component)
      SELECT component, nodes, edges, round(km, 6) AS km, edges - nodes + 1 AS cycles, round(CASE WHEN nodes > 2 THEN (edges - nodes + 1) / (2 * nodes - 5) ELSE 0 END::DOUBLE, 6) AS alpha FROM per JOIN len USING (component) WHERE km >= 0.1"""


ORACLE_SQL["corridor_km"] = _corridor_sql()
