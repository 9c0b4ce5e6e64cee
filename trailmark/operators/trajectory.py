"""Recorded tracks: gaps, stops, marches, modes, resampled steps.

Fixes are rows (track, seq, t in seconds, x, y, z, v) with seq ascending in time. What is relational is windows over a track; only
the order-dependent scan for stops by dispersion is a grouped kernel, over one piece of one track at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import cut_lineage

GAP_S, MIN_STOP_S, RADIUS_M, FOOT_MAX, STEP_M = 300.0, 120.0, 20.0, 4.0, 30.0
#: How near device stops lie that a sensitivity row without radius merges.
DEVICE_MERGE_M = 10.0

def _track():
    return Window.partitionBy("track").orderBy("seq")


def steps(fixes: DataFrame) -> DataFrame:
    """Differences to the fix before: dt, dl, dz."""
    dx, dy = F.col("x") - F.lag("x").over(_track()), F.col("y") - F.lag("y").over(_track())
    return fixes.withColumns({"dt": F.col("t") - F.lag("t").over(_track()), "dl": F.sqrt(dx * dx + dy * dy), "dz": F.col("z") - F.lag("z").over(_track())})


def pieces(fixes: DataFrame, gap: float = GAP_S) -> DataFrame:
    """steps with piece: a new one where more than gap seconds passed."""
    flagged = steps(fixes).withColumn("cut", F.coalesce(F.col("dt") > gap, F.lit(False)).cast("long"))
    return flagged.withColumn("piece", F.sum("cut").over(_track().rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def long_pieces(cut: DataFrame) -> DataFrame:
    """Without pieces of a single fix; differences never reach over a gap."""
    size = F.count("*").over(Window.partitionBy("track", "piece"))
    first = F.row_number().over(Window.partitionBy("track", "piece").orderBy("seq")) == 1
    kept = cut.withColumn("__n", size).withColumn("__first", first).where("__n > 1").drop("__n")
    inside = lambda c: F.when(~F.col("__first"), F.col(c))
    return kept.withColumns({c: inside(c) for c in ("dt", "dl", "dz")}).drop("__first")


def islands(rows: DataFrame, flag: Column, min_s: float) -> DataFrame:
    """Runs of consecutive flagged fixes of a piece, two or more, that last min_s or longer."""
    marked = rows.withColumn("__f", flag)
    piece = Window.partitionBy("track", "piece")
    run = F.row_number().over(piece.orderBy("seq")) - F.row_number().over(Window.partitionBy("track", "piece", "__f").orderBy("seq"))
    runs = marked.withColumn("__run", run).where("__f").groupBy("track", "piece", "__run")
    found = runs.agg(F.min("seq").alias("i0"), F.max("seq").alias("i1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("z").alias("z"), F.count("*").alias("fixes"))
    return found.where((F.col("fixes") > 1) & (F.col("t1") - F.col("t0") >= min_s)).drop("__run")


def device_stops(rows: DataFrame, min_s: float = MIN_STOP_S) -> DataFrame:
    """Stops where the receiver said that it stood still."""
    return islands(rows, F.coalesce(F.col("v") <= 0, F.lit(False)), min_s)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def scan_stops(t: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, radius: float, min_s: float, criterion: str) -> list[tuple[int, int]]:
    """Stops of one piece by device speed, by dispersion about the first fix, or by either; neighbours are merged."""
    lasting = lambda mask: [(a, b) for a, b in _runs(mask) if b > a and t[b] - t[a] >= min_s]
    mask = np.zeros(len(t), bool)
    found: list[tuple[int, int]] = []
    if criterion in ("device", "both"):
        found = lasting(v <= 0)
        for a, b in found:
            mask[a : b + 1] = True
    if criterion in ("dispersion", "both"):
        spread, i = [], 0
        while i < len(t) - 1:
            far = np.flatnonzero((x[i + 1 :] - x[i]) ** 2 + (y[i + 1 :] - y[i]) ** 2 > radius * radius)
            j = i + int(far[0]) if len(far) else len(t) - 1
            if j > i and t[j] - t[i] >= min_s:
                spread.append((i, j))
                i = j + 1
            else:
                i += 1
        for a, b in spread:
            mask[a : b + 1] = True
        found = spread if criterion == "dispersion" else lasting(mask)
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out:
            p, q = out[-1]
            apart = np.hypot(x[p : q + 1].mean() - x[a : b + 1].mean(), y[p : q + 1].mean() - y[a : b + 1].mean())
            if t[a] - t[q] < min_s and apart <= radius:
                out[-1] = (p, b)
                continue
        out.append((a, b))
    return out


STOPS = "track string, piece long, i0 long, i1 long, t0 double, t1 double, z double, x double, y double, radius double, fixes long"


def stops(rows: DataFrame, radius: float = RADIUS_M, min_s: float = MIN_STOP_S, criterion: str = "both") -> DataFrame:
    """Stops of every piece; a group is one piece of one track."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        t, x, y, v, z = (p[c].to_numpy(float) for c in ("t", "x", "y", "v", "z"))
        seq, out = p["seq"].to_numpy(), []
        for a, b in scan_stops(t, x, y, v, radius, min_s, criterion):
            cx, cy, own = x[a : b + 1].mean(), y[a : b + 1].mean(), z[a : b + 1]
            out.append((p["track"].iloc[0], p["piece"].iloc[0], seq[a], seq[b], t[a], t[b], np.nan if np.isnan(own).all() else np.nanmean(own), cx, cy, np.hypot(x[a : b + 1] - cx, y[a : b + 1] - cy).max(), b - a + 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STOPS.split(", ")])

    own = rows.select(F.col("track").cast("string").alias("track"), F.col("piece").cast("long").alias("piece"), "seq", *[F.col(c).cast("double").alias(c) for c in ("t", "x", "y", "v", "z")])
    return own.groupBy("track", "piece").applyInPandas(one, STOPS)


def marches(rows: DataFrame, stopped: DataFrame) -> DataFrame:
    """What lies between stops; a march shares its end fixes with them."""
    ends = rows.groupBy("track", "piece").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    order = Window.partitionBy("track", "piece").orderBy("i0")
    before = ends.join(stopped, ["track", "piece"], "left").withColumn("from", F.coalesce(F.lag("i1").over(order), F.col("a"))).withColumn("to", F.coalesce("i0", "b"))
    last = ends.join(stopped.groupBy("track", "piece").agg(F.max("i1").alias("from")), ["track", "piece"]).withColumn("to", F.col("b"))
    both = before.select("track", "piece", "from", "to").unionByName(last.select("track", "piece", "from", "to"))
    return both.where(F.col("from") < F.col("to"))


def outside(rows: DataFrame, stopped: DataFrame) -> DataFrame:
    """Fixes that are in no stop: a window carries the last stop's end on, no range join."""
    marks = stopped.select("track", "piece", F.col("i0").alias("seq"), F.col("i1").alias("until"))
    order = Window.partitionBy("track", "piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.join(marks, ["track", "piece", "seq"], "left").withColumn("until", F.max("until").over(order))
    return carried.where(F.col("until").isNull() | (F.col("seq") > F.col("until"))).drop("until")


def piece_modes(rows: DataFrame, stopped: DataFrame, limit: float = FOOT_MAX) -> DataFrame:
    """(track, piece, p95 of device speed on the march, mode)."""
    moving = outside(rows, stopped).groupBy("track", "piece").agg(F.percentile("v", F.lit(0.95)).alias("p95"))
    every = rows.select("track", "piece").distinct().join(moving, ["track", "piece"], "left")
    return every.withColumn("mode", F.when(F.col("p95") > limit, "vehiculo").otherwise("pie"))


def device_marks(rows: DataFrame, min_s: float = MIN_STOP_S) -> DataFrame:
    """rows with stop, the seq of the first fix of the device stop that a fix is in, or null: windows alone, no join."""
    piece = Window.partitionBy("track", "piece")
    still = rows.withColumn("__f", F.coalesce(F.col("v") <= 0, F.lit(False)))
    run = F.row_number().over(piece.orderBy("seq")) - F.row_number().over(Window.partitionBy("track", "piece", "__f").orderBy("seq"))
    own = Window.partitionBy("track", "piece", "__f", "__run")
    long = (F.count("*").over(own) > 1) & (F.max("t").over(own) - F.min("t").over(own) >= min_s)
    return still.withColumn("__run", run).withColumn("stop", F.when(F.col("__f") & long, F.min("seq").over(own))).drop("__f", "__run")


def marked(rows: DataFrame, stopped: DataFrame) -> DataFrame:
    """rows with stop, the first fix of the stop (track, piece, i0, i1) that a fix is in, or null: a window carries the last stop on."""
    marks = stopped.select("track", "piece", F.col("i0").alias("seq"), F.struct("i0", "i1").alias("__stop"))
    order = Window.partitionBy("track", "piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.join(marks, ["track", "piece", "seq"], "left").withColumn("__stop", F.max("__stop").over(order))
    return carried.withColumn("stop", F.when(F.col("seq") <= F.col("__stop.i1"), F.col("__stop.i0"))).drop("__stop")


def anatomy(fixes: DataFrame, stopped_of=None, gap: float = GAP_S, limit: float = FOOT_MAX) -> DataFrame:
    """Where the time of each track goes; stopped_of(rows) gives the stops of its pieces (by device, if not given). One aggregate over a track's
    fixes, and one over its stops and marches."""
    cut = pieces(fixes, gap)
    rows = long_pieces(cut)
    own = device_marks(rows) if stopped_of is None else marked(rows, stopped_of(rows))
    up, down = (F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)) for c in (F.col("dz"), -F.col("dz")))
    # a group is a stop, or what of a piece is in none
    parts = own.groupBy("track", "piece", "stop").agg(F.sum("dt").alias("dt"), F.sum("dl").alias("dl"), up.alias("up"), down.alias("down"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("z").alias("z"), F.percentile("v", F.lit(0.95)).alias("p95"))
    stop, lasted = F.col("stop").isNotNull(), F.col("t1") - F.col("t0")
    sums = parts.groupBy("track").agg(
        F.sum("dt").alias("total_s"), F.sum("dl").alias("length_m"), F.sum("up").alias("up_m"), F.sum("down").alias("down_m"),
        F.sum(F.when(stop, lasted)).alias("stopped_s"), F.count_if(stop).alias("n_stops"), F.percentile(F.when(stop, lasted), F.lit(0.5)).alias("median_stop_s"), F.max(F.when(stop, lasted)).alias("longest_stop_s"), F.avg(F.when(stop, F.col("z"))).alias("stop_z"),
        F.when(F.bool_or(~stop & (F.col("p95") > limit)), "vehiculo").otherwise("pie").alias("mode"),
    )
    whole = cut.groupBy("track").agg(
        F.percentile("dl", F.lit(0.5)).alias("step_m"), F.coalesce(F.sum(F.when(F.col("dt") > gap, F.col("dt"))), F.lit(0.0)).alias("lost_s"),
        F.count("*").alias("fixes"), F.min("z").alias("low_m"), F.max("z").alias("high_m"),
    )
    out = whole.join(sums, "track", "left").fillna(0, ["total_s", "length_m", "up_m", "down_m", "stopped_s", "n_stops"])
    march = F.col("total_s") - F.col("stopped_s")
    return out.withColumns({"march_s": march, "stopped_share": F.when(F.col("total_s") > 0, F.col("stopped_s") / F.col("total_s")), "march_kmh": F.when(march > 0, F.col("length_m") / march * 3.6)})


def mode_subtotals(summary: DataFrame) -> DataFrame:
    """Sums by mode and over all, in one pass."""
    return summary.rollup("mode").agg(F.count("*").alias("tracks"), F.sum("length_m").alias("length_m"), F.sum("total_s").alias("total_s"), F.sum("stopped_s").alias("stopped_s"))


def grid_of(radii: tuple[float, ...] = (10.0, 20.0, 40.0), least: tuple[float, ...] = (60.0, 120.0, 300.0)) -> list[tuple[str, float | None, float]]:
    """The criteria, radii and least seconds that a sensitivity table has: 21 rows by default."""
    return [("device", None, t) for t in least] + [(c, r, t) for c in ("dispersion", "both") for r in radii for t in least]


def sensitivity(fixes: DataFrame, grid: list[tuple[str, float | None, float]]) -> DataFrame:
    """Stopped share and number of stops for each (criterion, radius, least seconds), in one job: pieces are cut once, and a piece's stops are
    found under all parameters where it is."""
    rows = long_pieces(pieces(fixes))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        t, x, y, v = (p[c].to_numpy(float) for c in ("t", "x", "y", "v"))
        out = []
        for k, (criterion, radius, min_s) in enumerate(grid):
            found = scan_stops(t, x, y, v, DEVICE_MERGE_M if radius is None else radius, min_s, criterion)
            out.append((k, float(sum(t[b] - t[a] for a, b in found)), len(found), float(t[-1] - t[0])))
        return pd.DataFrame(out, columns=["k", "stopped_s", "n", "total_s"])

    own = rows.select(F.col("track").cast("string").alias("track"), F.col("piece").cast("long").alias("piece"), "seq", *[F.col(c).cast("double").alias(c) for c in ("t", "x", "y", "v")])
    sums = own.groupBy("track", "piece").applyInPandas(one, "k int, stopped_s double, n long, total_s double").groupBy("k").agg(F.sum("stopped_s").alias("stopped_s"), F.sum("n").alias("n_stops"), F.sum("total_s").alias("total_s"))
    names = fixes.sparkSession.createDataFrame([(k, c, r, float(t)) for k, (c, r, t) in enumerate(grid)], "k int, criterion string, radius_m double, min_s double")
    return sums.join(F.broadcast(names), "k").select("criterion", "radius_m", "min_s", (F.col("stopped_s") / F.col("total_s")).alias("stopped_share"), "n_stops")  # a parameter's rows


def resample(rows: DataFrame, key: list[str], step: float = STEP_M, values: tuple[str, ...] = ("x", "y", "z", "t")) -> DataFrame:
    """Points every step metres along each polyline, linearly between its vertices; the end is left out. Each segment makes the
    points that lie on it, so nothing is joined."""
    order = Window.partitionBy(*key).orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    run = rows.withColumn("dl", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn("s", F.sum("dl").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = run.withColumns({f"__{c}": F.lead(c).over(order) for c in ("s", *values)}).where(F.col("__s") > F.col("s"))
    first, last = F.ceil(F.col("s") / step), F.ceil(F.col("__s") / step) - 1
    made = ahead.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    w = (F.col("k") * step - F.col("s")) / (F.col("__s") - F.col("s"))
    return made.select(*key, "k", *[(F.col(c) + (F.col(f"__{c}") - F.col(c)) * w).alias(c) for c in values])


def step_speeds(points: DataFrame, key: list[str], step: float = STEP_M, rows: DataFrame | None = None) -> DataFrame:
    """Slope and speed between resampled points. With the rows that they come from also device: the receiver's speed, linear between the fixes around
    the middle of the step's time."""
    order = Window.partitionBy(*key).orderBy("k")
    pair = points.withColumns({"dz": F.lead("z").over(order) - F.col("z"), "dt": F.lead("t").over(order) - F.col("t")}).where("dt > 0")
    out = pair.select(*key, "k", (F.col("dz") / step).alias("g"), (F.lit(step) / F.col("dt")).alias("v"), "x", "y", "z", "t", (F.col("t") + F.col("dt") / 2).alias("mid"))
    if rows is None:
        return out.drop("mid")
    # fixes and middles in one order of time: the fix before and the fix after are carried on
    both = out.select(*key, F.col("mid").alias("at"), "k").withColumn("fix", F.lit(None).cast("struct<t:double,v:double>"))
    both = both.unionByName(rows.select(*key, F.col("t").alias("at"), F.lit(None).cast("bigint").alias("k"), F.struct(F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v")).alias("fix")))
    time = Window.partitionBy(*key).orderBy("at", F.col("k").isNotNull())
    around = both.withColumns({"a": F.last("fix", True).over(time.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("fix", True).over(time.rowsBetween(0, Window.unboundedFollowing))}).where("k is not null")
    device = F.when(F.col("b.t") > F.col("a.t"), F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("at") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(F.coalesce("a.v", "b.v"))
    return out.drop("mid").join(around.select(*key, F.col("k").cast("bigint").alias("k"), device.alias("device")), [*key, "k"])


def slope_bins(speeds: DataFrame, least: int = 25, g_max: float = 0.45, width: float = 0.05) -> DataFrame:
    """Median speed by slope class, for classes of least steps or more."""
    classed = speeds.where((F.abs("g") <= g_max) & (F.col("v") > 0)).withColumn("bin", F.floor((F.col("g") + g_max) / width + 1e-9).cast("long")).where(f"bin < {round(2 * g_max / width)}")
    return classed.groupBy("bin").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.5)).alias("v")).where(F.col("n") >= least)


def stretches(tracks: DataFrame, jump_m: float = 100.0, pause_s: float = 4 * 3600.0) -> DataFrame:
    """Consecutive tracks (start_t, end_t and the coordinates of both ends) that go on from one another get one number, in order of
    start_t. Tracks are dealt by ranges of time; only a row for each range meets the others."""
    dealt = cut_lineage(tracks.repartitionByRange("start_t", "track").withColumn("__p", F.spark_partition_id()))
    order = Window.partitionBy("__p").orderBy("start_t", "track")
    end = F.struct("x1", "y1", "end_t")
    last = dealt.groupBy("__p").agg(F.max_by(end, F.struct("start_t", "track")).alias("__last"))
    before = last.select("__p", F.lag("__last").over(Window.orderBy("__p")).alias("__last"))  # a row a range
    joined = dealt.join(F.broadcast(before), "__p").withColumn("__e", F.coalesce(F.lag(end).over(order), F.col("__last")))
    jump = F.hypot(F.col("x0") - F.col("__e.x1"), F.col("y0") - F.col("__e.y1"))
    new = F.coalesce(~((jump <= jump_m) & (F.abs(F.col("start_t") - F.col("__e.end_t")) <= pause_s)), F.lit(True)).cast("long")
    counted = cut_lineage(joined.withColumn("__n", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__e", "__last"))
    sums = counted.groupBy("__p").agg(F.max("__n").alias("__k"))
    offset = sums.select("__p", F.coalesce(F.sum("__k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # a row a range
    return counted.join(F.broadcast(offset), "__p").withColumn("stretch", F.col("__n") + F.col("__o")).drop("__p", "__n", "__o")


def track_ends(fixes: DataFrame) -> DataFrame:
    """What stretches needs of each track."""
    return fixes.groupBy("track").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min_by("x", "seq").alias("x0"), F.min_by("y", "seq").alias("y0"), F.max_by("x", "seq").alias("x1"), F.max_by("y", "seq").alias("y1"))


#: What recorders put into names.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def track_label(name: Column) -> Column:
    """What stands behind a name's last underscore, without weekdays; the whole name where nothing is left."""
    rest = F.regexp_replace(F.element_at(F.split(name, "_"), -1), "|".join(WEEKDAYS), "")
    plain = F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ _-]+|[ _-]+$", "")
    return F.when(plain == "", name).otherwise(plain)


def stretch_label(first: Column, last: Column) -> Column:
    """A stretch's name from those of its first and last track."""
    a, b = track_label(first), track_label(last)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" - "), b))


def as_lines(fixes: DataFrame, tolerance: float, on_foot: bool = True, jump_m: float = 100.0, pause_s: float = 4 * 3600.0) -> DataFrame:
    """(stretch, label, seq, x, y): the tracks, only those on foot unless told otherwise, joined to stretches in order of time, without repeated
    vertices, simplified, and without lines shorter than the tolerance. A track's mode is judged as a whole. t must count from one origin."""
    from .lines import lengths, simplify

    rows = fixes
    if on_foot:
        whole = fixes.withColumn("piece", F.lit(0).cast("long"))
        feet = piece_modes(whole, device_stops(whole)).where("mode = 'pie'").select("track")
        rows = fixes.join(feet, "track", "left_semi")
    named = cut_lineage(stretches(track_ends(rows), jump_m, pause_s).select("track", "stretch", "start_t"))
    order = Window.partitionBy("stretch").orderBy("start_t", "track", "seq")
    joined = rows.join(named, "track").withColumn("seq", F.row_number().over(order) - 1).select(F.col("stretch").cast("string").alias("stretch"), "seq", "x", "y")
    plain = without_repeats(simplify(without_repeats(joined, ["stretch"]), "stretch", tolerance), ["stretch"])
    long = lengths(plain, ["stretch"]).where(F.col("length") >= tolerance).select("stretch")
    labels = named.groupBy("stretch").agg(F.min_by("track", F.struct("start_t", "track")).alias("a"), F.max_by("track", F.struct("start_t", "track")).alias("b"))
    labels = labels.select(F.col("stretch").cast("string").alias("stretch"), stretch_label(F.col("a").cast("string"), F.col("b").cast("string")).alias("label"))
    return plain.join(long, "stretch", "left_semi").join(labels, "stretch").select("stretch", "label", "seq", "x", "y")


def without_repeats(rows: DataFrame, key: list[str], eps: float = 0.01) -> DataFrame:
    """Vertices farther than eps from the one before them in the input."""
    order = Window.partitionBy(*key).orderBy("seq")
    apart = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    return rows.withColumn("__d", apart).where((F.col("__d") > eps) | F.col("__d").isNull()).drop("__d")
