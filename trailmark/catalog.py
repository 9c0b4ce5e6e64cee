"""The queries of the engine's own operators, and the same results in SQL. Numbers that transcendental functions make are rounded
to six decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog_lines, catalog_routes
from .functions import cost, text
from .operators import hydrology, paths, raster
from .operators import trajectory as tr
from .plans.views import CELLS, FIXES, cells, fixes

SIZE = 30.0


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _rows(s: SparkSession, d: str) -> DataFrame:
    return tr.long_pieces(tr.pieces(fixes(s, d)))


def anatomy_device_stops(s, d):
    out = tr.anatomy(fixes(s, d)).select("track", "mode", "step_m", "lost_s", "total_s", "length_m", "up_m", "down_m", "stopped_s", F.col("n_stops").cast("long").alias("n_stops"), "median_stop_s", "longest_stop_s", "stopped_share")
    return _round(out, "step_m", "lost_s", "total_s", "length_m", "up_m", "down_m", "stopped_s", "median_stop_s", "longest_stop_s", "stopped_share")


ANATOMY = """whole AS (SELECT track, quantile_cont(dl, 0.5) AS step_m, coalesce(sum(dt) FILTER (dt > 300), 0) AS lost_s FROM cut GROUP BY track),
inside AS (SELECT track, sum(dt) AS total_s, sum(dl) AS length_m, coalesce(sum(dz) FILTER (dz > 0), 0) AS up_m, coalesce(-sum(dz) FILTER (dz < 0), 0) AS down_m FROM rows_ GROUP BY track),
held AS (SELECT track, sum(t1 - t0) AS stopped_s, count(*) AS n_stops, quantile_cont(t1 - t0, 0.5) AS median_stop_s, max(t1 - t0) AS longest_stop_s FROM stops GROUP BY track),
anatomy AS (SELECT whole.track, mode, step_m, lost_s, coalesce(total_s, 0) AS total_s, coalesce(length_m, 0) AS length_m, coalesce(up_m, 0) AS up_m, coalesce(down_m, 0) AS down_m, coalesce(stopped_s, 0) AS stopped_s, coalesce(n_stops, 0) AS n_stops, median_stop_s, longest_stop_s
  FROM whole LEFT JOIN inside USING (track) LEFT JOIN held USING (track) LEFT JOIN modes USING (track))"""


def gap_sessions(s, d):
    return _rows(s, d).groupBy("track", "piece").agg(F.count("*").alias("fixes"), F.min("t").alias("start_t"), F.max("t").alias("end_t"))


def mode_p95(s, d):
    rows = _rows(s, d)
    return _round(tr.piece_modes(rows, tr.device_stops(rows)), "p95")


def mode_rollup(s, d):
    return _round(tr.mode_subtotals(tr.anatomy(fixes(s, d))), "length_m", "total_s", "stopped_s")


def march_segments(s, d):
    rows = _rows(s, d)
    return tr.marches(rows, tr.device_stops(rows)).select("track", "piece", F.col("from").cast("long").alias("i0"), F.col("to").cast("long").alias("i1"))


def stop_dispersion(s, d):
    return tr.stops(_rows(s, d), radius=100.0, criterion="dispersion").select("track", "piece", "i0", "i1", "t0", "t1", "fixes")


def stop_union_merge(s, d):
    return tr.stops(_rows(s, d), radius=100.0).select("track", "piece", "i0", "i1", "t0", "t1", "fixes")


#: Radii that suit the view's fixes, which lie up to 300 m apart.
RADII, LEAST = (50.0, 100.0, 200.0), (60.0, 120.0, 300.0)


def sensitivity_grid(s, d):
    return _round(tr.sensitivity(fixes(s, d), tr.grid_of(RADII, LEAST)), "stopped_share")


def anatomy(s, d):
    out = tr.anatomy(fixes(s, d), lambda rows: tr.stops(rows, radius=100.0)).withColumns({c: F.col(c).cast("long") for c in ("n_stops", "fixes")})
    return _round(out, *[c for c in out.columns if c not in ("track", "mode", "n_stops", "fixes")])


def _stops_sql(radius: float, criterion: str, least: float = 120.0, name: str = "found") -> str:
    """CTEs up to `found` (track, piece, i0, i1, t0, t1, fixes): runs of standing still, the anchored scan as a walk from one fix to the next anchor, both as
    one mask, and merging as a fold over the stops in order."""
    r, t = f"{radius!r}::DOUBLE", f"{least!r}::DOUBLE"
    device = f"device AS (SELECT track, piece, min(k) AS a, max(k) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY track, piece, v <= 0 ORDER BY k) AS run FROM pts) WHERE v <= 0 GROUP BY track, piece, run HAVING count(*) > 1 AND max(t) - min(t) >= {t})"
    scan = f"""far AS (SELECT p.track, p.piece, p.k, min(q.k) - 1 AS j FROM pts p JOIN pts q ON q.track = p.track AND q.piece = p.piece AND q.k > p.k AND pow(q.x - p.x, 2) + pow(q.y - p.y, 2) > {radius * radius!r}::DOUBLE GROUP BY ALL),
reach_ AS (SELECT p.track, p.piece, p.k, p.t, p.n, coalesce(far.j, p.n - 1) AS j FROM pts p LEFT JOIN far USING (track, piece, k)),
tries AS (SELECT r.*, r.j > r.k AND e.t - r.t >= {t} AS ok FROM reach_ r JOIN pts e ON e.track = r.track AND e.piece = r.piece AND e.k = r.j),
walk(track, piece, k) AS (SELECT track, piece, 0::BIGINT FROM tries WHERE k = 0 UNION ALL SELECT w.track, w.piece, CASE WHEN ok THEN j + 1 ELSE w.k + 1 END FROM walk w JOIN tries USING (track, piece, k) WHERE CASE WHEN ok THEN j + 1 ELSE w.k + 1 END < n - 1),
spread AS (SELECT track, piece, k AS a, j AS b FROM walk JOIN tries USING (track, piece, k) WHERE ok AND k < n - 1)"""
    mask = f"""masked AS (SELECT p.*, EXISTS (SELECT 1 FROM (SELECT * FROM device UNION ALL SELECT * FROM spread) s WHERE s.track = p.track AND s.piece = p.piece AND p.k BETWEEN s.a AND s.b) AS f FROM pts p),
union_ AS (SELECT track, piece, min(k) AS a, max(k) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY track, piece, f ORDER BY k) AS run FROM masked) WHERE f GROUP BY track, piece, run HAVING count(*) > 1 AND max(t) - min(t) >= {t})"""
    source = {"device": "device", "dispersion": "spread", "both": "union_"}[criterion]
    return f"""pts AS (SELECT track, piece, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY track, piece) AS n, seq, t, x, y, v, sum(x) OVER w AS sx, sum(y) OVER w AS sy FROM rows_ WINDOW w AS (PARTITION BY track, piece ORDER BY seq)),
{device}, {scan}, {mask},
ordered AS (SELECT *, row_number() OVER (PARTITION BY track, piece ORDER BY a) AS q FROM {source}),
sized AS (SELECT o.*, pa.t AS ta, pb.t AS tb, pb.sx - pa.sx + pa.x AS sx, pb.sy - pa.sy + pa.y AS sy, pa.sx - pa.x AS bx, pa.sy - pa.y AS by_, pb.sx AS ex, pb.sy AS ey FROM ordered o JOIN pts pa ON pa.track = o.track AND pa.piece = o.piece AND pa.k = o.a JOIN pts pb ON pb.track = o.track AND pb.piece = o.piece AND pb.k = o.b),
fold(track, piece, q, a, b, tb, bx, by_, ex, ey) AS (SELECT track, piece, q, a, b, tb, bx, by_, ex, ey FROM sized WHERE q = 1
  UNION ALL SELECT f.track, f.piece, s.q, CASE WHEN m THEN f.a ELSE s.a END, s.b, s.tb, CASE WHEN m THEN f.bx ELSE s.bx END, CASE WHEN m THEN f.by_ ELSE s.by_ END, s.ex, s.ey
  FROM (SELECT f.*, s.q AS nq, s.ta - f.tb < {t} AND sqrt(pow((f.ex - f.bx) / (f.b - f.a + 1) - s.sx / (s.b - s.a + 1), 2) + pow((f.ey - f.by_) / (f.b - f.a + 1) - s.sy / (s.b - s.a + 1), 2)) <= {r} AS m FROM fold f JOIN sized s ON s.track = f.track AND s.piece = f.piece AND s.q = f.q + 1) f JOIN sized s ON s.track = f.track AND s.piece = f.piece AND s.q = f.nq),
{name} AS (SELECT g.track, g.piece, pa.seq AS i0, pb.seq AS i1, pa.t AS t0, pb.t AS t1, g.b - g.a + 1 AS fixes FROM (SELECT track, piece, a, max(b) AS b FROM fold GROUP BY track, piece, a) g JOIN pts pa ON pa.track = g.track AND pa.piece = g.piece AND pa.k = g.a JOIN pts pb ON pb.track = g.track AND pb.piece = g.piece AND pb.k = g.b)"""


def _sensitivity_sql() -> str:
    from .operators.trajectory import DEVICE_MERGE_M

    parts = []
    for criterion, radius, least in tr.grid_of(RADII, LEAST):
        inner = _stops_sql(DEVICE_MERGE_M if radius is None else radius, criterion, least)
        parts.append(f"SELECT '{criterion}' AS criterion, {'NULL' if radius is None else repr(radius)}::DOUBLE AS radius_m, {least!r}::DOUBLE AS min_s, * FROM (WITH RECURSIVE {inner} SELECT coalesce(sum(t1 - t0), 0) AS stopped, count(*) AS n_stops FROM found)")
    return f"WITH RECURSIVE {FIXES}, total AS (SELECT sum(dt) AS total_s FROM rows_), u AS ({' UNION ALL '.join(parts)}) SELECT criterion, radius_m, min_s, round(stopped / total_s, 6) AS stopped_share, n_stops FROM u, total"


def trecho_grouping(s, d):
    f = fixes(s, d)
    ends = f.groupBy("track").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min_by("x", "seq").alias("x0"), F.min_by("y", "seq").alias("y0"), F.max_by("x", "seq").alias("x1"), F.max_by("y", "seq").alias("y1"))
    return tr.stretches(ends).select("track", "start_t", "end_t", "stretch")


def resample_fixed_distance(s, d):
    points = tr.resample(_rows(s, d), ["track", "piece"])
    return _round(points.select("track", "piece", F.col("k").cast("long").alias("k"), "x", "y", "z", "t"), "x", "y", "z", "t")


RESAMPLED = """run AS (SELECT *, coalesce(sum(dl) OVER (PARTITION BY track, piece ORDER BY seq), 0) AS s FROM rows_),
ahead AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(t) OVER w AS t1 FROM run WINDOW w AS (PARTITION BY track, piece ORDER BY seq)),
points AS (SELECT track, piece, k, x + (x1 - x) * w AS x, y + (y1 - y) * w AS y, z + (z1 - z) * w AS z, t + (t1 - t) * w AS t FROM
  (SELECT *, (k * 30.0::DOUBLE - s) / (s1 - s) AS w FROM (SELECT *, unnest(range(ceil(s / 30)::BIGINT, ceil(s1 / 30)::BIGINT)) AS k FROM ahead WHERE s1 > s)))"""


def slope_speed_bins(s, d):
    speeds = tr.step_speeds(tr.resample(_rows(s, d), ["track", "piece"]), ["track", "piece"])
    return _round(tr.slope_bins(speeds.withColumn("g", F.round("g", 6))), "v").select("bin", F.col("n").cast("long").alias("n"), "v")


def consecutive_dedupe(s, d):
    return tr.without_repeats(fixes(s, d), ["track"], 60.0).select("track", F.col("seq").cast("long").alias("seq"), "x", "y")


def line_tortuosity(s, d):
    return _round(raster.line_tortuosity(fixes(s, d)), "length_m", "sinuosity", "turn_deg")


def cost_scalars(s, d):
    g = cells(s, d).withColumn("g", (F.col("col") - 25) / 50.0)
    out = g.select("row", "col", cost.slope_cost(F.col("g")).alias("phi"), cost.tobler(F.col("g")).alias("speed"), cost.tobler_cost(F.col("g")).alias("phi_t"), cost.drainage_cost(F.col("z")).alias("drain"), cost.wetness(F.col("z"), F.atan(F.abs("g"))).alias("twi"))
    return _round(out, "phi", "speed", "phi_t", "drain", "twi")


def horn_slope_aspect(s, d):
    out = raster.slope_aspect(cells(s, d), SIZE)
    # without a slope the aspect's sign hangs on rounding; full turns are one with none
    aspect = F.when(F.col("slope") > 1e-9, F.round(F.pmod(F.round("aspect", 6), F.lit(6.283185)), 6) + 0.0).otherwise(0.0)
    return _round(out.withColumn("aspect", aspect), "slope", "aspect")


def vrm(s, d):
    return _round(raster.ruggedness(raster.slope_aspect(cells(s, d), SIZE)), "vrm")


TERRAIN = """ends AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM cells), off AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)),
grad AS (SELECT c.row, c.col, sum(j * CASE WHEN i = 0 OR j = 0 THEN 2 ELSE 1 END * o.z) / 8 / 30.0::DOUBLE AS e, sum(-i * CASE WHEN i = 0 OR j = 0 THEN 2 ELSE 1 END * o.z) / 8 / 30.0::DOUBLE AS n
  FROM cells c, ends, off JOIN cells o ON o.row = greatest(r0, least(r1, c.row + i)) AND o.col = greatest(c0, least(c1, c.col + j)) GROUP BY c.row, c.col),
terrain AS (SELECT row, col, atan(sqrt(e * e + n * n)) AS slope, atan2(-e, -n) AS aspect FROM grad)"""


def vrm_mask_p99(s, d):
    rugged = raster.ruggedness(raster.slope_aspect(cells(s, d), SIZE)).withColumn("vrm", F.round("vrm", 9))
    return _round(raster.over_percentile(rugged, "vrm", 0.99), "vrm")


def percentile_normalise(s, d):
    return _round(raster.normalised(cells(s, d), "z"), "z")


def d8_direction(s, d):
    return raster.downstream(cells(s, d), SIZE).select("row", "col", F.col("to_row").cast("long").alias("to_row"), F.col("to_col").cast("long").alias("to_col"))


def flow_accumulation(s, d):
    high = hydrology.filled(cells(s, d), 64)
    return hydrology.accumulation(raster.downstream(high, SIZE), 64).withColumn("cells", F.col("cells").cast("long"))


def depression_fill(s, d):
    return _round(hydrology.filled(cells(s, d), 64), "z")


FILLED = """off AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE i <> 0 OR j <> 0), pairs AS (SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, b.z AS to_z, i, j, k FROM cells a, off JOIN cells b ON b.row = a.row + i AND b.col = a.col + j),
rim AS (SELECT c.row, c.col, z FROM cells c LEFT JOIN (SELECT row, col, count(*) AS n FROM pairs GROUP BY row, col) p ON p.row = c.row AND p.col = c.col WHERE coalesce(n, 0) < 8),
flood(row, col, h) USING KEY (row, col) AS (SELECT row, col, z FROM rim UNION SELECT to_row, to_col, min(greatest(p.to_z, f.h + 1e-4::DOUBLE)) FROM flood f JOIN pairs p ON p.row = f.row AND p.col = f.col LEFT JOIN recurring.flood o ON o.row = p.to_row AND o.col = p.to_col
  WHERE (p.to_row, p.to_col) NOT IN (SELECT (row, col) FROM rim) AND (o.h IS NULL OR greatest(p.to_z, f.h + 1e-4::DOUBLE) < o.h) GROUP BY to_row, to_col)"""


def dem_uncertainty_band(s, d):
    a = cells(s, d)
    return _round(raster.uncertainty(a, a.withColumn("z", F.col("z") + (F.col("row") * 3 + F.col("col")) % 60)), "median_m", "p90_m", "p99_m", "max_m", "over_50_pct")


def bilinear_sample(s, d):
    points = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 11 % 400 + 0.25).alias("fr"), (F.col("s_suppkey") * 7 % 49 + 0.75).alias("fc"))
    return _round(raster.bilinear(cells(s, d), points), "v")


def edges_8(s, d):
    return _round(raster.edges(cells(s, d), SIZE, raster.OFFSETS_8), "l", "g", "phi")


def edges_16_knight(s, d):
    return _round(raster.edges(cells(s, d), SIZE), "l", "g", "phi")


def _edges_sql(offsets: list[tuple[int, int]]) -> str:
    parts = []
    for i, j in offsets:
        length = f"{SIZE * (i * i + j * j) ** 0.5!r}::DOUBLE"
        joins, conds = "", [f"abs((b.z - a.z) / {length}) <= 0.45"]
        if abs(i) + abs(j) == 3:
            u, v = (i > 0) - (i < 0), (j > 0) - (j < 0)
            for k, (p, q) in enumerate(((u, 0), (u, v)) if abs(i) == 2 else ((0, v), (u, v))):
                joins += f" JOIN cells m{k} ON m{k}.row = a.row + {p} AND m{k}.col = a.col + {q}"
                one, two = SIZE * (p * p + q * q) ** 0.5, SIZE * ((i - p) ** 2 + (j - q) ** 2) ** 0.5
                conds += [f"abs((m{k}.z - a.z) / {one!r}::DOUBLE) <= 0.45", f"abs((b.z - m{k}.z) / {two!r}::DOUBLE) <= 0.45"]
        parts.append(f"SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, {length} AS l, (b.z - a.z) / {length} AS g FROM cells a JOIN cells b ON b.row = a.row + {i} AND b.col = a.col + {j}{joins} WHERE {' AND '.join(conds)}")
    horner = "280.5"
    for c in cost.MINETTI[1:]:
        horner = f"({horner}) * g + {c}"
    return f"WITH {CELLS}, e AS ({' UNION ALL '.join(parts)}) SELECT row, col, to_row, to_col, round(l, 6) AS l, round(g, 6) AS g, round(({horner.replace('280.5', '280.5::DOUBLE')}) / 2.5, 6) AS phi FROM e"


def nodes_within_radius(s, d):
    points = cells(s, d).select("row", "col", (F.col("col") * SIZE).alias("x"), (F.col("row") * SIZE).alias("y"))
    sites = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 53.0).alias("x"), (F.col("n_nationkey") * 47.0).alias("y"))
    return raster.within(points, sites, 100.0).select("row", "col")


def sites_nn_saturated(s, d):
    points = cells(s, d).select((F.col("row") * 50 + F.col("col")).alias("id"), (F.col("col") * SIZE).alias("x"), (F.col("row") * SIZE).alias("y"))
    sites = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 53.0).alias("x"), (F.col("n_nationkey") * 47.0).alias("y"))
    return _round(raster.site_proximity(points, sites, 500.0), "proximity")





def simplex_lattice(s, d):
    return paths.lattice(s, 3, 20).select(*[F.element_at("m", i + 1).alias(f"m{i}") for i in range(3)])








def mean_symmetric_distance(s, d):
    f = fixes(s, d).select(F.floor(F.col("track") / 2).alias("unit"), F.col("track"), (F.col("track") * 1000 + F.col("seq")).alias("seq"), "x", "y")
    return _round(paths.symmetric_distance(f.where("track % 2 = 0"), f.where("track % 2 = 1")), "distance_m")



def self_proximity(s, d):
    f = tr.steps(fixes(s, d)).withColumn("s", F.sum(F.coalesce("dl", F.lit(0.0))).over(Window.partitionBy("track").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return _round(paths.self_proximity(f.select(F.col("track").alias("unit"), "seq", "x", "y", "s")), "distance_m")


def registry_text(s, d):
    n = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    return n.select("page_id", text.folded(F.concat(F.lit(" Área Ñandú "), F.col("url"))).alias("folded"), text.category(F.concat(F.lit("Tramo Observado "), F.col("url"))).alias("category"), text.plain_words(F.col("url")).alias("words"), text.keyword_score(F.col("url"), {"example": 5, "page": 2, "com": -3}, F.lit("LineString")).alias("score"))


_Q = [anatomy_device_stops, gap_sessions, mode_p95, mode_rollup, march_segments, anatomy, stop_dispersion, stop_union_merge, sensitivity_grid, trecho_grouping, resample_fixed_distance, slope_speed_bins, consecutive_dedupe, line_tortuosity, cost_scalars, horn_slope_aspect, vrm, vrm_mask_p99, percentile_normalise, d8_direction, flow_accumulation, depression_fill, dem_uncertainty_band, bilinear_sample, edges_8, edges_16_knight, nodes_within_radius, sites_nn_saturated, simplex_lattice, mean_symmetric_distance, self_proximity, registry_text]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_r = lambda *names: ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)
_HORNER = "((((280.5::DOUBLE * g - 58.7) * g - 76.8) * g + 51.9) * g + 19.6) * g + 2.5"
ORACLE_SQL: dict[str, str] = {
    "anatomy_device_stops": f"WITH {FIXES}, {ANATOMY} SELECT track, mode, {_r('step_m', 'lost_s', 'total_s', 'length_m', 'up_m', 'down_m', 'stopped_s', 'median_stop_s', 'longest_stop_s')}, n_stops, round(CASE WHEN total_s > 0 THEN stopped_s / total_s END, 6) AS stopped_share FROM anatomy",
    "gap_sessions": f"WITH {FIXES} SELECT track, piece, count(*) AS fixes, min(t) AS start_t, max(t) AS end_t FROM rows_ GROUP BY track, piece",
    "mode_p95": f"WITH {FIXES} SELECT track, piece, round(p95, 6) AS p95, CASE WHEN p95 > 4.0 THEN 'vehiculo' ELSE 'pie' END AS mode FROM piece_modes",
    "mode_rollup": f"WITH {FIXES}, {ANATOMY} SELECT mode, count(*) AS tracks, round(sum(length_m), 6) AS length_m, round(sum(total_s), 6) AS total_s, round(sum(stopped_s), 6) AS stopped_s FROM anatomy GROUP BY ROLLUP (mode)",
    "march_segments": f"WITH {FIXES}, ends AS (SELECT track, piece, min(seq) AS a, max(seq) AS b FROM rows_ GROUP BY track, piece), m AS (SELECT e.track, e.piece, coalesce(lag(s.i1) OVER (PARTITION BY e.track, e.piece ORDER BY s.i0), a) AS i0, coalesce(s.i0, b) AS i1 FROM ends e LEFT JOIN stops s USING (track, piece) UNION ALL SELECT e.track, e.piece, max(s.i1), any_value(b) FROM ends e JOIN stops s USING (track, piece) GROUP BY e.track, e.piece) SELECT track, piece, i0::BIGINT AS i0, i1::BIGINT AS i1 FROM m WHERE i0 < i1",
    "trecho_grouping": f"WITH {FIXES}, ends AS (SELECT track, min(t) AS start_t, max(t) AS end_t, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1 FROM fixes GROUP BY track), n AS (SELECT *, CASE WHEN sqrt(pow(x0 - lag(x1) OVER w, 2) + pow(y0 - lag(y1) OVER w, 2)) <= 100 AND abs(start_t - lag(end_t) OVER w) <= 14400 THEN 0 ELSE 1 END AS new FROM ends WINDOW w AS (ORDER BY start_t, track)) SELECT track, start_t, end_t, (sum(new) OVER (ORDER BY start_t, track))::BIGINT AS stretch FROM n",
    "resample_fixed_distance": f"WITH {FIXES}, {RESAMPLED} SELECT track, piece, k, {_r('x', 'y', 'z', 't')} FROM points",
    "slope_speed_bins": f"WITH {FIXES}, {RESAMPLED}, sp AS (SELECT *, lead(z) OVER w - z AS dz, lead(t) OVER w - t AS dt FROM points WINDOW w AS (PARTITION BY track, piece ORDER BY k)), c AS (SELECT round(dz / 30, 6) AS g, 30.0::DOUBLE / dt AS v FROM sp WHERE dt > 0), b AS (SELECT floor((g + 0.45::DOUBLE) / 0.05::DOUBLE + 1e-9)::BIGINT AS bin, v FROM c WHERE abs(g) <= 0.45 AND v > 0) SELECT bin, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS v FROM b WHERE bin < 18 GROUP BY bin HAVING count(*) >= 25",
    "consecutive_dedupe": f"WITH {FIXES} SELECT track, seq, x, y FROM steps WHERE dl IS NULL OR dl > 60",
    "line_tortuosity": f"WITH {FIXES}, seg AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)), mv AS (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey FROM seg WHERE dx <> 0 OR dy <> 0 WINDOW w AS (PARTITION BY track ORDER BY seq)), turns AS (SELECT track, max(degrees(acos(least(1.0, greatest(-1.0, (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey))))))) AS turn_deg FROM mv WHERE ex IS NOT NULL GROUP BY track), l AS (SELECT track, sum(sqrt(dx * dx + dy * dy)) AS length_m, sqrt(pow(arg_min(x, seq) - arg_max(x, seq), 2) + pow(arg_min(y, seq) - arg_max(y, seq), 2)) AS d FROM seg GROUP BY track) SELECT track, round(length_m, 6) AS length_m, round(CASE WHEN d > 0 THEN length_m / d END, 6) AS sinuosity, round(turn_deg, 6) AS turn_deg FROM l LEFT JOIN turns USING (track)",
    "cost_scalars": f"WITH {CELLS}, q AS (SELECT *, (col - 25) / 50.0::DOUBLE AS g FROM cells) SELECT row, col, round(CASE WHEN abs(g) <= 0.45 THEN ({_HORNER}) / 2.5 END, 6) AS phi, round(1.662 * exp(-3.5 * abs(g + 0.05)), 6) AS speed, round(1.662 * exp(-3.5 * 0.05::DOUBLE) / (1.662 * exp(-3.5 * abs(g + 0.05))), 6) AS phi_t, round(log10(1 + greatest(z, 0)), 6) AS drain, round(ln(greatest(z, 1e-6) / (tan(atan(abs(g))) + 1e-3)), 6) AS twi FROM q",
    "horn_slope_aspect": f"WITH {CELLS}, {TERRAIN} SELECT row, col, round(slope, 6) AS slope, CASE WHEN slope > 1e-9 THEN round(round(CASE WHEN aspect < 0 THEN aspect + 2 * pi() ELSE aspect END, 6) % 6.283185::DOUBLE, 6) + 0.0::DOUBLE ELSE 0 END AS aspect FROM terrain",
    "vrm": f"WITH {CELLS}, {TERRAIN}, nv AS (SELECT row, col, sin(slope) * sin(aspect) AS x, sin(slope) * cos(aspect) AS y, cos(slope) AS w FROM terrain), sums AS (SELECT c.row, c.col, sum(o.x) AS x, sum(o.y) AS y, sum(o.w) AS w FROM nv c, ends, off JOIN nv o ON o.row = greatest(r0, least(r1, c.row + i)) AND o.col = greatest(c0, least(c1, c.col + j)) GROUP BY c.row, c.col) SELECT row, col, round(greatest(0, least(1, 1 - sqrt(x * x + y * y + w * w) / 9)), 6) AS vrm FROM sums",
    "vrm_mask_p99": f"WITH {CELLS}, {TERRAIN}, nv AS (SELECT row, col, sin(slope) * sin(aspect) AS x, sin(slope) * cos(aspect) AS y, cos(slope) AS w FROM terrain), sums AS (SELECT c.row, c.col, sum(o.x) AS x, sum(o.y) AS y, sum(o.w) AS w FROM nv c, ends, off JOIN nv o ON o.row = greatest(r0, least(r1, c.row + i)) AND o.col = greatest(c0, least(c1, c.col + j)) GROUP BY c.row, c.col), v AS (SELECT row, col, round(greatest(0, least(1, 1 - sqrt(x * x + y * y + w * w) / 9)), 9) AS vrm FROM sums) SELECT row, col, round(vrm, 6) AS vrm FROM v WHERE vrm > (SELECT quantile_cont(vrm, 0.99) FROM v)",
    "percentile_normalise": f"WITH {CELLS}, q AS (SELECT quantile_cont(z, 0.05) AS a, quantile_cont(z, 0.95) AS b FROM cells) SELECT row, col, round((least(greatest(z, a), b) - a) / (b - a) + 0.01, 6) AS z FROM cells, q",
    "d8_direction": f"WITH {CELLS}, off AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS k FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE i <> 0 OR j <> 0), m AS (SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.z - b.z) / (30.0::DOUBLE * sqrt(i * i + j * j)) DESC, k) AS n FROM cells a, off JOIN cells b ON b.row = a.row + i AND b.col = a.col + j WHERE a.z > b.z) SELECT c.row, c.col, to_row, to_col FROM cells c LEFT JOIN m ON c.row = m.row AND c.col = m.col AND n = 1",
    "dem_uncertainty_band": f"WITH {CELLS}, q AS (SELECT abs(z - (z + (row * 3 + col) % 60)) AS d FROM cells) SELECT round(quantile_cont(d, 0.5), 6) AS median_m, round(quantile_cont(d, 0.9), 6) AS p90_m, round(quantile_cont(d, 0.99), 6) AS p99_m, round(max(d), 6) AS max_m, round(avg(CASE WHEN d > 50 THEN 1.0 ELSE 0 END) * 100, 6) AS over_50_pct FROM q",
    "bilinear_sample": f"WITH {CELLS}, p AS (SELECT s_suppkey AS id, s_suppkey * 11 % 400 AS r, s_suppkey * 7 % 49 AS c FROM supplier) SELECT id, round(a.z * 0.75 * 0.25 + b.z * 0.75 * 0.75 + e.z * 0.25 * 0.25 + f.z * 0.25 * 0.75, 6) AS v FROM p LEFT JOIN cells a ON a.row = r AND a.col = c LEFT JOIN cells b ON b.row = r AND b.col = c + 1 LEFT JOIN cells e ON e.row = r + 1 AND e.col = c LEFT JOIN cells f ON f.row = r + 1 AND f.col = c + 1",
    "edges_8": _edges_sql(raster.OFFSETS_8),
    "edges_16_knight": _edges_sql(raster.OFFSETS_16),
    "nodes_within_radius": f"WITH {CELLS} SELECT row, col FROM cells WHERE EXISTS (SELECT 1 FROM nation WHERE pow(col * 30 - n_nationkey * 53, 2) + pow(row * 30 - n_nationkey * 47, 2) <= 10000)",
    "sites_nn_saturated": f"WITH {CELLS} SELECT row * 50 + col AS id, round(least(1.0, sqrt(min(pow(col * 30 - n_nationkey * 53, 2) + pow(row * 30 - n_nationkey * 47, 2))) / 500), 6) AS proximity FROM cells, nation GROUP BY row, col",
    "simplex_lattice": "SELECT a AS m0, b AS m1, 20 - a - b AS m2 FROM range(21) x(a), range(21) y(b) WHERE a + b <= 20",
    "mean_symmetric_distance": f"WITH {FIXES}, f AS (SELECT track // 2 AS unit, track, track * 1000 + seq AS id, x, y FROM fixes), a AS (SELECT * FROM f WHERE track % 2 = 0), b AS (SELECT * FROM f WHERE track % 2 = 1), ab AS (SELECT unit, avg(d) AS m FROM (SELECT a.unit, a.id, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a JOIN b USING (unit) GROUP BY a.unit, a.id) GROUP BY unit), ba AS (SELECT unit, avg(d) AS m FROM (SELECT b.unit, b.id, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM b JOIN a USING (unit) GROUP BY b.unit, b.id) GROUP BY unit) SELECT unit, round((ab.m + ba.m) / 2, 6) AS distance_m FROM ab JOIN ba USING (unit)",
    "self_proximity": f"WITH {FIXES}, v AS (SELECT track AS unit, x, y, coalesce(sum(dl) OVER (PARTITION BY track ORDER BY seq), 0) AS s FROM steps) SELECT a.unit, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS distance_m FROM v a JOIN v b ON a.unit = b.unit AND b.s - a.s >= 1000 GROUP BY a.unit",
    "registry_text": "SELECT page_id, lower('area nandu ' || translate(trim(url), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')) AS folded, CASE WHEN lower(url) LIKE '%proyectad%' THEN 'proyectado' ELSE 'observado' END AS category, regexp_replace(lower(url), '[^a-zñ]+', ' ', 'g') AS words, (CASE WHEN lower(url) LIKE '%example%' THEN 5 ELSE 0 END + CASE WHEN lower(url) LIKE '%page%' THEN 2 ELSE 0 END + CASE WHEN lower(url) LIKE '%com%' THEN -3 ELSE 0 END + 4)::INTEGER AS score FROM pages",
}

ORACLE_SQL |= {
    "anatomy": f"""WITH RECURSIVE {FIXES}, {_stops_sql(100.0, 'both')}, st AS (SELECT f.track, f.piece, f.i0, f.i1, f.t0, f.t1, avg(r.z) AS z FROM found f JOIN rows_ r ON r.track = f.track AND r.piece = f.piece AND r.seq BETWEEN f.i0 AND f.i1 GROUP BY ALL),
      pm AS (SELECT track, piece, quantile_cont(v, 0.95) AS p95 FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.track = r.track AND s.piece = r.piece AND r.seq BETWEEN s.i0 AND s.i1) GROUP BY track, piece),
      md AS (SELECT track, CASE WHEN bool_or(coalesce(p95 > 4.0, false)) THEN 'vehiculo' ELSE 'pie' END AS mode FROM (SELECT DISTINCT track FROM rows_) LEFT JOIN pm USING (track) GROUP BY track),
      wh AS (SELECT track, quantile_cont(dl, 0.5) AS step_m, coalesce(sum(dt) FILTER (dt > 300), 0) AS lost_s, count(*) AS fixes, min(z) AS low_m, max(z) AS high_m FROM cut GROUP BY track),
      ins AS (SELECT track, sum(dt) AS total_s, sum(dl) AS length_m, coalesce(sum(dz) FILTER (dz > 0), 0) AS up_m, coalesce(-sum(dz) FILTER (dz < 0), 0) AS down_m FROM rows_ GROUP BY track),
      hd AS (SELECT track, sum(t1 - t0) AS stopped_s, count(*) AS n_stops, quantile_cont(t1 - t0, 0.5) AS median_stop_s, max(t1 - t0) AS longest_stop_s, avg(z) AS stop_z FROM st GROUP BY track),
      a AS (SELECT wh.*, mode, coalesce(total_s, 0) AS total_s, coalesce(length_m, 0) AS length_m, coalesce(up_m, 0) AS up_m, coalesce(down_m, 0) AS down_m, coalesce(stopped_s, 0) AS stopped_s, coalesce(n_stops, 0) AS n_stops, median_stop_s, longest_stop_s, stop_z FROM wh LEFT JOIN ins USING (track) LEFT JOIN hd USING (track) LEFT JOIN md USING (track))
      SELECT track, mode, fixes, n_stops, {_r('step_m', 'lost_s', 'low_m', 'high_m', 'total_s', 'length_m', 'up_m', 'down_m', 'stopped_s', 'median_stop_s', 'longest_stop_s', 'stop_z')}, round((total_s - stopped_s)::DOUBLE, 6) AS march_s, round(CASE WHEN total_s > 0 THEN stopped_s / total_s END::DOUBLE, 6) AS stopped_share, round(CASE WHEN total_s > stopped_s THEN length_m / (total_s - stopped_s) * 3.6 END::DOUBLE, 6) AS march_kmh FROM a""",
    "stop_dispersion": f"WITH RECURSIVE {FIXES}, {_stops_sql(100.0, 'dispersion')} SELECT track::VARCHAR AS track, piece, i0, i1, t0, t1, fixes FROM found",
    "stop_union_merge": f"WITH RECURSIVE {FIXES}, {_stops_sql(100.0, 'both')} SELECT track::VARCHAR AS track, piece, i0, i1, t0, t1, fixes FROM found",
    "sensitivity_grid": _sensitivity_sql(),
    "depression_fill": f"WITH RECURSIVE {CELLS}, {FILLED} SELECT row, col, round(h, 6) AS z FROM flood",
    "flow_accumulation": f"""WITH RECURSIVE {CELLS}, {FILLED}, way AS (SELECT row, col, to_row, to_col FROM (SELECT p.row, p.col, to_row, to_col, row_number() OVER (PARTITION BY p.row, p.col ORDER BY (a.h - b.h) / (30.0::DOUBLE * sqrt(i * i + j * j)) DESC, k) AS n
      FROM pairs p JOIN flood a ON a.row = p.row AND a.col = p.col JOIN flood b ON b.row = to_row AND b.col = to_col WHERE a.h > b.h) WHERE n = 1),
      run(r0, c0, row, col) AS (SELECT row, col, row, col FROM cells UNION ALL SELECT r0, c0, to_row, to_col FROM run JOIN way USING (row, col)) SELECT row, col, count(*) AS cells FROM run GROUP BY row, col""",
}
QUERIES |= catalog_lines.QUERIES | catalog_routes.QUERIES
ORACLE_SQL |= catalog_lines.ORACLE_SQL | catalog_routes.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the time of each track goes."""
    return anatomy_device_stops(spark, sf_dir)
