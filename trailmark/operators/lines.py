"""Polylines as rows (key..., seq, x, y): places along them, cuts, distances to them, noding and merging, simplification.

Distances use squares: what may lie within a radius meets by an equi-join on square numbers. A nearest neighbour without a given radius is
searched in rounds of growing radius over the points that are left, so nothing is ever compared with everything."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import components, cut_lineage


def segments(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, seq, x, y, x1, y1, s, s1): each vertex with the next one and the lengths up to both; zero-length ones are left out."""
    order = Window.partitionBy(*key).orderBy("seq")
    ahead = rows.select(*key, "seq", "x", "y").withColumns({"x1": F.lead("x").over(order), "y1": F.lead("y").over(order)})
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    long = ahead.withColumn("l", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    run = long.withColumn("s1", F.sum("l").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("l > 0").withColumn("s", F.col("s1") - F.col("l")).drop("l")


def lengths(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, length); 0 for a single vertex."""
    order = Window.partitionBy(*key).orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    return rows.withColumn("__l", F.sqrt(dx * dx + dy * dy)).groupBy(*key).agg(F.coalesce(F.sum("__l"), F.lit(0.0)).alias("length"))


def places(rows: DataFrame, key: list[str], at: DataFrame) -> DataFrame:
    """at (key, ..., s) with x, y of the place at length s along its line, held at the line's ends."""
    seg = segments(rows, key)
    last = seg.groupBy(*key).agg(F.max("s1").alias("__end"))
    clamped = at.join(last, key).withColumn("__s", F.least(F.greatest(F.col("s"), F.lit(0.0)), F.col("__end")))
    own = seg.select(*key, F.col("x").alias("__x"), F.col("y").alias("__y"), "x1", "y1", F.col("s").alias("__a"), F.col("s1").alias("__b"))
    inside = (F.col("__s") >= F.col("__a")) & ((F.col("__s") < F.col("__b")) | (F.col("__s") == F.col("__end")) & (F.col("__b") == F.col("__end")))
    w = (F.col("__s") - F.col("__a")) / (F.col("__b") - F.col("__a"))
    joined = clamped.join(own, key).where(inside)
    return joined.select(*at.columns, (F.col("__x") + (F.col("x1") - F.col("__x")) * w).alias("x"), (F.col("__y") + (F.col("y1") - F.col("__y")) * w).alias("y"))


def equidistant(rows: DataFrame, key: list[str], count: Column | None = None, step: float | None = None) -> DataFrame:
    """(key, k, s, x, y): count vertices at equal lengths, both ends included; or so many that they are at most step apart. Each segment makes
    the ones that lie on it; a line of no length repeats its vertex count times."""
    total = lengths(rows, key)
    n = count if count is not None else F.greatest(F.lit(2), F.ceil(F.col("length") / step).cast("int") + 1)
    sizes = total.withColumn("n", n.cast("int"))
    seg = segments(rows, key).join(sizes, key)
    gap = F.col("length") / (F.col("n") - 1)
    ends = Window.partitionBy(*key)
    seg = seg.withColumns({"first": F.ceil(F.col("s") / gap - 1e-9), "last": F.when(F.col("s1") == F.max("s1").over(ends), F.col("n") - 1).otherwise(F.ceil(F.col("s1") / gap - 1e-9) - 1)})
    made = seg.where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") * gap - F.col("s")) / (F.col("s1") - F.col("s"))))
    out = made.select(*key, F.col("k").cast("long").alias("k"), (F.col("k") * gap).alias("s"), (F.col("x") + (F.col("x1") - F.col("x")) * w).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * w).alias("y"))
    still = rows.groupBy(*key).agg(F.min_by("x", "seq").alias("x"), F.min_by("y", "seq").alias("y")).join(sizes.where("length = 0"), key)
    still = still.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))))
    return out.unionByName(still.select(*key, "k", F.lit(0.0).alias("s"), "x", "y"))


def sections(rows: DataFrame, key: list[str], cuts: DataFrame) -> DataFrame:
    """cuts (key, part, s0, s1): the vertices (key, part, seq, x, y) of each line between two lengths, the cut places included."""
    seg = segments(rows, key)
    joined = seg.withColumnRenamed("s1", "t").join(cuts, key)
    over = joined.where((F.col("t") > F.col("s0")) & (F.col("s") < F.col("s1")))
    place = lambda s: F.struct(F.greatest(F.lit(0.0), s).alias("s"), (F.col("x") + (F.col("x1") - F.col("x")) * (s - F.col("s")) / (F.col("t") - F.col("s"))).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * (s - F.col("s")) / (F.col("t") - F.col("s"))).alias("y"))
    both = over.withColumn("p", F.explode(F.array(place(F.greatest("s", "s0")), place(F.least("t", "s1")))))
    points = both.groupBy(*key, "part", F.col("p.s").alias("at")).agg(F.min("p.x").alias("x"), F.min("p.y").alias("y"))
    order = Window.partitionBy(*key, "part").orderBy("at")
    return points.withColumn("seq", F.row_number().over(order) - 1).select(*key, "part", "seq", "x", "y")


def equal_parts(rows: DataFrame, key: list[str], n: int, least: float = 500.0) -> DataFrame:
    """Lines cut into n parts of equal length, numbered from 1; parts shorter than least are an error, as a comparison of them says
    nothing."""
    total = lengths(rows, key)
    shortest = total.agg(F.min("length")).first()[0]
    if n < 1 or (shortest is not None and shortest / n < least):
        raise ValueError(f"{n} parts of a line of {shortest or 0:.0f} m are shorter than {least:g} m each")
    cuts = total.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(*key, "part", (F.col("length") * (F.col("part") - 1) / n).alias("s0"), (F.col("length") * F.col("part") / n).alias("s1"))
    return sections(rows, key, cuts)


def to_segment(px: Column, py: Column, x: Column, y: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Squared distance of a point to a segment, and the nearest place as a share of the segment."""
    dx, dy = x1 - x, y1 - y
    square = dx * dx + dy * dy
    w = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x) * dx + (py - y) * dy) / square))).otherwise(0.0)
    a, b = x + w * dx - px, y + w * dy - py
    return a * a + b * b, w


def _squares(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def near_segments(points: DataFrame, seg: DataFrame, key: list[str], radius: float) -> DataFrame:
    """points (key, pid, x, y) with the segments of their key within radius: (key, pid, d2, w, and all of the segment's columns)."""
    names = [c for c in seg.columns if c not in key]
    own = seg.withColumns({"bx": F.explode(_squares(F.least("x", "x1") - radius, F.greatest("x", "x1") + radius, radius))}).withColumn("by", F.explode(_squares(F.least("y", "y1") - radius, F.greatest("y", "y1") + radius, radius)))
    at = points.select(*key, "pid", F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"bx": F.floor(F.col("px") / radius).cast("long"), "by": F.floor(F.col("py") / radius).cast("long")})
    joined = at.join(own, [*key, "bx", "by"])
    d2, w = to_segment(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))
    return joined.withColumns({"d2": d2, "w": w}).where(F.col("d2") <= radius * radius).select(*key, "pid", "px", "py", "d2", "w", *names)


def nearest_segment(points: DataFrame, seg: DataFrame, key: list[str], radius: float, rounds: int = 24) -> DataFrame:
    """For each point (key, pid, x, y) whose key has segments (seq, x, y, x1, y1, s, s1) the nearest one: (key, pid, d, seq, s: the length
    along the line at the foot). Ties go to the first segment. Points without a segment within the radius go on with a radius four times as
    large."""
    seg = cut_lineage(seg)
    left, found = cut_lineage(points.join(seg.select(*key).distinct(), key, "left_semi") if key else points), None
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            break
        near = near_segments(left, seg, key, radius)
        best = near.groupBy(*key, "pid").agg(F.min_by(F.struct("d2", "seq", (F.col("s") + F.col("w") * (F.col("s1") - F.col("s"))).alias("s")), F.struct("d2", "seq")).alias("b"))
        best = cut_lineage(best.select(*key, "pid", F.sqrt("b.d2").alias("d"), "b.seq", "b.s"))
        found = best if found is None else found.unionByName(best)
        left = cut_lineage(left.join(best.select(*key, "pid"), [*key, "pid"], "left_anti"))
        radius *= 4
    if found is None:
        return points.limit(0).select(*key, "pid", F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("s"))
    return found


def nearest_point(points: DataFrame, targets: DataFrame, key: list[str], radius: float) -> DataFrame:
    """For each point (key, pid, x, y) the nearest of targets (key, seq, x, y): (key, pid, d, seq)."""
    seg = targets.select(*key, "seq", "x", "y", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(0.0).alias("s"), F.lit(0.0).alias("s1"))
    return nearest_segment(points, seg, key, radius).drop("s")


def profile(observed: DataFrame, modelled: DataFrame, key: list[str], step: float = 30.0) -> DataFrame:
    """(key, seq, s, x, y, d): places of the observed line about step apart, with their distance to the modelled line."""
    count = F.greatest(F.lit(2), F.floor(F.col("length") / step).cast("int") + 1)
    points = equidistant(observed, key, count).withColumnRenamed("k", "pid")
    near = nearest_segment(points, segments(modelled, key), key, step * 4).select(*key, "pid", "d")
    return points.join(near, [*key, "pid"]).withColumnRenamed("pid", "seq")


def turns(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, turn): the largest angle in degrees between a segment and the next, of those that have a length."""
    order = Window.partitionBy(*key).orderBy("seq")
    seg = segments(rows, key).withColumns({"dx": F.col("x1") - F.col("x"), "dy": F.col("y1") - F.col("y")})
    both = seg.withColumns({"ex": F.lead("dx").over(order), "ey": F.lead("dy").over(order)}).where("ex is not null")
    cos = (F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) / (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")))
    return both.groupBy(*key).agg(F.max(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))).alias("turn"))


# ---------------------------------------------------------------- noding and merging


def noded(seg: DataFrame, square: float, key: list[str] | None = None) -> DataFrame:
    """Segments (key, id, x, y, x1, y1) cut where they cross or touch one another: distinct pieces (key, piece, x, y, x1, y1), whichever way they
    ran. Only segments of a key that share a square of the given size are compared; coordinates count to six decimals."""
    key = key or []
    r = lambda c: F.round(c, 6)
    own = cut_lineage(seg.select(*key, "id", *[r(F.col(c)).alias(c) for c in ("x", "y", "x1", "y1")]).where("x <> x1 or y <> y1"))
    spread = own.withColumn("bx", F.explode(_squares(F.least("x", "x1"), F.greatest("x", "x1"), square))).withColumn("by", F.explode(_squares(F.least("y", "y1"), F.greatest("y", "y1"), square)))
    other = spread.select(*key, "bx", "by", F.col("id").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x", "y", "x1", "y1")])
    pairs = spread.join(other, [*key, "bx", "by"]).where("id <> other").select(*key, "id", "x", "y", "x1", "y1", "ox", "oy", "ox1", "oy1").distinct()
    dx, dy, ex, ey = F.col("x1") - F.col("x"), F.col("y1") - F.col("y"), F.col("ox1") - F.col("ox"), F.col("oy1") - F.col("oy")
    cross, square_ = dx * ey - dy * ex, dx * dx + dy * dy
    fx, fy, gx, gy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y"), F.col("ox1") - F.col("x"), F.col("oy1") - F.col("y")
    along = lambda px, py: (px * dx + py * dy) / square_
    touches = lambda px, py: F.abs(px * dy - py * dx) / F.sqrt(square_) < 1e-6
    crossing = F.abs(cross) > 1e-12
    t, u = (fx * ey - fy * ex) / F.nullif(cross, F.lit(0.0)), (fx * dy - fy * dx) / F.nullif(cross, F.lit(0.0))
    at = F.array(F.when(crossing & (u >= -1e-9) & (u <= 1 + 1e-9), t), F.when(touches(fx, fy), along(fx, fy)), F.when(touches(gx, gy), along(gx, gy)))
    cuts = pairs.select(*key, "id", F.explode(at).alias("t")).where("t > 1e-9 and t < 1 - 1e-9").groupBy(*key, "id").agg(F.collect_set("t").alias("t"))
    whole = own.join(cuts, [*key, "id"], "left").withColumn("t", F.array_sort(F.concat(F.array(F.lit(0.0)), F.coalesce("t", F.array().cast("array<double>")), F.array(F.lit(1.0)))))
    place = lambda t: F.struct(r(F.col("x") + (F.col("x1") - F.col("x")) * t).alias("x"), r(F.col("y") + (F.col("y1") - F.col("y")) * t).alias("y"))
    parts = whole.select(*key, F.transform("t", place).alias("p")).select(*key, F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))).alias("e"))
    ends = parts.select(*key, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).where("a <> b").distinct()
    numbered = ends.withColumn("piece", F.monotonically_increasing_id())
    return cut_lineage(numbered.select(*key, "piece", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1")))


def merged(pieces: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(piece, chain): pieces (key, piece, x, y, x1, y1) that meet where no third one of their key does are one chain, named by its smallest
    piece."""
    both = F.array(F.struct("x", "y"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    ends = pieces.select(*(key or []), "piece", F.explode(both).alias("at"))
    two = ends.groupBy(*(key or []), "at").agg(F.count("*").alias("n"), F.min("piece").alias("a"), F.max("piece").alias("b")).where("n = 2 and a < b").select("a", "b")
    named = components(two)
    return pieces.select("piece").join(named.withColumnRenamed("node", "piece"), "piece", "left").select("piece", F.coalesce("component", "piece").alias("chain"))


def chains(seg: DataFrame, square: float, key: list[str] | None = None) -> DataFrame:
    """Chains (key, chain, x0, y0, x1, y1, length) of noded and merged segments: their free ends (of a ring one place twice) and
    lengths."""
    key = key or []
    pieces = noded(seg, square, key)
    own = cut_lineage(pieces.join(merged(pieces, key), "piece"))
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    total = own.groupBy(*key, "chain").agg(F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"), F.min(F.struct("x", "y")).alias("any"))
    ends = own.select("chain", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("at")).groupBy("chain", "at").agg(F.count("*").alias("n"))
    free = ends.where("n % 2 = 1").groupBy("chain").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    both = total.join(free, "chain", "left").withColumns({"a": F.coalesce("a", "any"), "b": F.coalesce("b", "any")})
    return both.select(*key, "chain", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "length")


def by_name(seg: DataFrame, key: str, square: float, merge: bool = True) -> DataFrame:
    """(key, pieces, km, longest_km) of the lines of each name, longest first: noded and merged, or as they are (recorded tracks, which cross
    themselves on purpose). seg (key, id, x, y, x1, y1); unmerged, an id is one line."""
    if merge:
        made = chains(seg, square, [key])
    else:
        dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
        made = seg.groupBy(key, "id").agg(F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"))
    return made.groupBy(key).agg(F.count("*").alias("pieces"), (F.sum("length") / 1000).alias("km"), (F.max("length") / 1000).alias("longest_km")).orderBy(F.desc("longest_km"), key)


# ---------------------------------------------------------------- simplification


def simplified_indices(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that stay when all others lie within tolerance of the line between those that stay around them: the farthest vertex of
    a stretch beyond the tolerance stays and parts the stretch."""
    stay = np.zeros(len(x), bool)
    stay[[0, -1]] = True
    open_ = [(0, len(x) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        w = np.clip((px * dx + py * dy) / square, 0, 1) if square > 0 else np.zeros(len(px))
        d = np.hypot(px - w * dx, py - w * dy)
        k = int(d.argmax())
        if d[k] > tolerance:
            stay[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(stay)


def simplify(rows: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, seq, x, y) without the vertices that tolerance makes needless; a group is one line."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        return p.iloc[simplified_indices(p["x"].to_numpy(), p["y"].to_numpy(), tolerance)] if len(p) > 2 else p

    own = rows.select(F.col(key).cast("string").alias(key), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return own.groupBy(key).applyInPandas(one, f"{key} string, seq long, x double, y double")


# ---------------------------------------------------------------- curves


def even(p: np.ndarray, n: int) -> np.ndarray:
    """n vertices at equal lengths along a polyline."""
    step = np.hypot(*np.diff(p, axis=0).T) if len(p) > 1 else np.zeros(0)
    s = np.concatenate([[0.0], np.cumsum(step)])
    at = np.linspace(0.0, s[-1], n)
    return np.column_stack([np.interp(at, s, p[:, k]) for k in (0, 1)]) if s[-1] > 0 else np.repeat(p[:1], n, axis=0)


def frechet(p: np.ndarray, q: np.ndarray) -> float:
    """Discrete Fréchet distance. A cell of the table needs its left, upper and upper left neighbours, so all cells of an antidiagonal are made
    at once."""
    n, m = len(p), len(q)
    d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    flipped = d[:, ::-1]
    before = last = np.full(n + 1, np.inf)  # by row; entry i + 1 belongs to row i
    for k in range(n + m - 1):
        low, high = max(0, k - m + 1), min(n - 1, k)
        i = np.arange(low, high + 1)
        reach = np.minimum(np.minimum(last[i], last[i + 1]), before[i]) if k else np.array([-np.inf])
        now = np.full(n + 1, np.inf)
        now[i + 1] = np.maximum(reach, flipped[i, m - 1 - (k - i)])
        before, last = last, now
    return float(last[n])


def frechet_distance(a: DataFrame, b: DataFrame, key: str, vertices: int = 250) -> DataFrame:
    """(key, frechet) of the lines (key, seq, x, y) that both sides have, brought to the same number of vertices first."""

    def one(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({key: [], "frechet": []})
        lines = [even(t.sort_values("seq")[["x", "y"]].to_numpy(float), vertices) for t in (p, q)]
        return pd.DataFrame({key: [p[key].iloc[0]], "frechet": [frechet(*lines)]})

    own = lambda t: t.select(F.col(key).cast("string").alias(key), "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return own(a).groupBy(key).cogroup(own(b).groupBy(key)).applyInPandas(one, f"{key} string, frechet double")


def mean_nearest(p: np.ndarray, q: np.ndarray, block: int = 1024) -> float:
    """Mean distance of the points of p to the nearest of q."""
    return float(np.concatenate([np.sqrt(((p[i : i + block, None] - q[None]) ** 2).sum(axis=2).min(axis=1)) for i in range(0, len(p), block)]).mean())


def mean_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Mean over both directions; infinite where a side is empty."""
    return (mean_nearest(p, q) + mean_nearest(q, p)) / 2 if len(p) and len(q) else math.inf
