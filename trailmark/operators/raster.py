"""Raster cells as rows (row, col, z): neighbourhoods by shifted equi-joins on computed keys."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import G_MAX, minetti
from ..functions.geo import lon_lat

OFFSETS_8 = [(i, j) for i, j in product((-1, 0, 1), repeat=2) if (i, j) != (0, 0)]
OFFSETS_16 = OFFSETS_8 + [(i, j) for i, j in product((-2, -1, 1, 2), repeat=2) if abs(i) != abs(j)]


def stencil(cells: DataFrame, value: str = "z") -> DataFrame:
    """(row, col, value, di, dj, v): each cell with its 3x3 neighbourhood, indexes clamped at the grid's edge."""
    ends = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    offsets = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cells.crossJoin(F.broadcast(ends)).withColumn("o", F.explode(offsets))  # one row of ends
    spread = spread.select("row", "col", value, "o.di", "o.dj", F.greatest(F.col("r0"), F.least(F.col("r1"), F.col("row") + F.col("o.di"))).alias("__r"), F.greatest(F.col("c0"), F.least(F.col("c1"), F.col("col") + F.col("o.dj"))).alias("__c"))
    other = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("v"))
    return spread.join(other, ["__r", "__c"]).drop("__r", "__c")


def slope_aspect(cells: DataFrame, size: float) -> DataFrame:
    """Slope and aspect by the third-order finite difference; weights of absent neighbours are shared out."""
    near = stencil(cells)
    weight = F.when((F.col("di") == 0) | (F.col("dj") == 0), 2.0).otherwise(1.0)
    east, north = F.col("dj") * weight, -F.col("di") * weight
    sums = near.groupBy("row", "col").agg(F.sum(east * F.col("v")).alias("e"), F.sum(F.abs(east)).alias("we"), F.sum(north * F.col("v")).alias("n"), F.sum(F.abs(north)).alias("wn"))
    de, dn = F.col("e") / F.col("we") / size, F.col("n") / F.col("wn") / size
    return sums.select("row", "col", F.atan(F.sqrt(de * de + dn * dn)).alias("slope"), F.pmod(F.atan2(-de, -dn), F.lit(6.283185307179586)).alias("aspect"))


def ruggedness(terrain: DataFrame) -> DataFrame:
    """Vector ruggedness over 3x3 cells: one less the length of the mean unit normal."""
    normals = terrain.select("row", "col", F.struct((F.sin("slope") * F.sin("aspect")).alias("x"), (F.sin("slope") * F.cos("aspect")).alias("y"), F.cos("slope").alias("w")).alias("z"))
    sums = stencil(normals).groupBy("row", "col").agg(*[F.sum(f"v.{c}").alias(c) for c in "xyw"], F.count("*").alias("n"))
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyw"), F.lit(0.0)))
    return sums.select("row", "col", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - r / F.col("n"))).alias("vrm"))


def percentiles(rows: DataFrame, value: str, shares: list[float], bins: int = 4096, most_rounds: int = 8) -> list[float | None]:
    """Exact percentiles, linear between the two values around the place, without gathering the values in one task: counts in equal bins, then
    again in the bins that hold the places, until what is left in them is few enough to be sorted."""
    own = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    wanted = sorted({r for p in shares for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    values: dict[int, float] = {}
    open_ = [(low, high, 0, n, wanted)]  # of a range of values: its ends, how many values are below it and in it, ranks in it
    for _ in range(most_rounds):
        found = [x for x in open_ if x[0] == x[1]]
        values |= {r: x[0] for x in found for r in x[4]}
        open_ = [x for x in open_ if x[0] < x[1]]
        if not open_ or sum(x[3] for x in open_) <= bins * 16:
            break
        parts = None
        for k, (a, b, *_) in enumerate(open_):  # at most two ranges a percentile
            one = own.where((F.col("v") >= a) & (F.col("v") <= b)).select(F.lit(k).alias("k"), F.least(F.lit(bins - 1), F.floor((F.col("v") - a) / (b - a) * bins)).alias("bin"), "v")
            parts = one if parts is None else parts.unionByName(one)
        counts = parts.groupBy("k", "bin").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k", "bin").collect()  # bins rows a range
        narrower = []
        for k, (_, _, below, _, ranks) in enumerate(open_):
            for r in counts:
                if r["k"] == k:
                    inside = [x for x in ranks if below <= x < below + r["c"]]
                    if inside:
                        narrower.append((r["a"], r["b"], below, r["c"], inside))
                    below += r["c"]
        open_ = narrower
    for a, b, below, _, ranks in open_:
        rest = sorted(r[0] for r in own.where((F.col("v") >= a) & (F.col("v") <= b)).collect()) if a < b else [a] * (max(ranks) - below + 1)  # at most 16 * bins values
        values |= {r: rest[r - below] for r in ranks}
    out = []
    for p in shares:
        at = p * (n - 1)
        x, y = values[math.floor(at)], values[math.ceil(at)]
        out.append(x + (y - x) * (at - math.floor(at)))
    return out


def over_percentile(cells: DataFrame, value: str, p: float) -> DataFrame:
    """Cells whose value is over its percentile p."""
    (cut,) = percentiles(cells, value, [p])
    return cells.where(F.col(value) > F.lit(cut))


def normalised(cells: DataFrame, value: str, low: float = 0.05, high: float = 0.95, epsilon: float = 0.01) -> DataFrame:
    """value clipped at its percentiles and scaled to [epsilon, 1 + epsilon]; a constant surface is epsilon."""
    a, b = percentiles(cells, value, [low, high])
    scaled = (F.least(F.greatest(F.col(value), F.lit(a)), F.lit(b)) - F.lit(a)) / F.lit(b - a) if a is not None and b > a else F.lit(0.0)
    return cells.withColumn(value, F.when(F.col(value).isNotNull(), scaled + epsilon))


def downstream(cells: DataFrame, size: float) -> DataFrame:
    """(row, col, to_row, to_col): the steepest way down, the first in row order of equal ones; null at outlets."""
    moves = None
    for k, (i, j) in enumerate(OFFSETS_8):
        one = cells.select((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.col("z").alias("low"), F.lit(k).alias("k"), F.lit(size * (i * i + j * j) ** 0.5).alias("l"))
        moves = one if moves is None else moves.unionByName(one)
    best = cells.join(moves, ["row", "col"]).withColumn("drop", (F.col("z") - F.col("low")) / F.col("l")).where("drop > 0").groupBy("row", "col").agg(F.max_by("k", F.struct("drop", -F.col("k"))).alias("k"))
    di, dj = (F.element_at(F.array(*[F.lit(o[n]) for o in OFFSETS_8]), F.col("k") + 1) for n in (0, 1))
    return cells.select("row", "col").join(best, ["row", "col"], "left").select("row", "col", F.when(F.col("k").isNotNull(), F.col("row") + di).alias("to_row"), F.when(F.col("k").isNotNull(), F.col("col") + dj).alias("to_col"))


def uncertainty(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vertical disagreement of two surfaces, in one row."""
    d = a.select("row", "col", F.col("z").alias("za")).join(b.select("row", "col", F.col("z").alias("zb")), ["row", "col"]).withColumn("d", F.abs(F.col("za") - F.col("zb")))
    found = percentiles(d, "d", [0.5, 0.9, 0.99])
    return d.agg(*[F.lit(v).cast("double").alias(n) for n, v in zip(("median_m", "p90_m", "p99_m"), found, strict=True)], F.max("d").alias("max_m"), (F.avg((F.col("d") > 50).cast("double")) * 100).alias("over_50_pct"))


def bilinear(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points (id, fr, fc in cell centres) with v, null outside or beside a missing cell: one join, a row for each corner with weight,
    so the last row and column are inside."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = points.withColumn("o", F.explode(corners)).withColumns({"row": (F.floor("fr") + F.col("o.i")).cast("long"), "col": (F.floor("fc") + F.col("o.j")).cast("long")})
    wr, wc = F.col("fr") - F.floor("fr"), F.col("fc") - F.floor("fc")
    w = F.when(F.col("o.i") == 1, wr).otherwise(1 - wr) * F.when(F.col("o.j") == 1, wc).otherwise(1 - wc)
    found = spread.withColumn("w", w).where("w > 0").join(cells.select(F.col("row").cast("long"), F.col("col").cast("long"), "z"), ["row", "col"], "left")
    return found.groupBy("id").agg(F.when(F.count("z") == F.count("*"), F.sum(F.col("w") * F.col("z"))).alias("v"))


def aligned(target: DataFrame, source: DataFrame, west: float, north: float, size: float, epsg: int | None = None) -> DataFrame:
    """(row, col, z): a surface on another grid. target (row, col, x, y) are the cells wanted, with their centres; source (row, col, z) lies on a grid
    with its north-western corner at (west, north), in the same coordinates, or in degrees where the zone epsg of the target's is given. Cells outside,
    or beside a missing one, are left out."""
    x, y = (F.col("x"), F.col("y")) if epsg is None else lon_lat(F.col("x"), F.col("y"), epsg)
    points = target.select(F.struct("row", "col").alias("id"), x.alias("px"), y.alias("py"))
    at = points.select("id", ((F.lit(north) - F.col("py")) / size - 0.5).alias("fr"), ((F.col("px") - west) / size - 0.5).alias("fc"))
    return bilinear(source, at).where("v is not null").select("id.row", "id.col", F.col("v").alias("z"))


def off_grid(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """Cells that lie outside a grid: of a surface prepared for another box."""
    return cells.where(~(F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1)))


def edges(cells: DataFrame, size: float, offsets: list[tuple[int, int]] | None = None, g_max: float = G_MAX) -> DataFrame:
    """Directed edges (row, col, to_row, to_col, l, g, phi) between neighbours not steeper than g_max. A knight's move also needs
    both cells that it passes over, and each of its four legs within g_max. Each cell asks once for all the cells that its moves need, so there
    is one join, and its answers meet in a map at the cell."""
    moves = offsets or OFFSETS_16
    passed = {}
    for i, j in moves:
        if abs(i) + abs(j) == 3:
            s, t = (i > 0) - (i < 0), (j > 0) - (j < 0)
            passed[i, j] = ((s, 0), (s, t)) if abs(i) == 2 else ((0, t), (s, t))
    needed = sorted({*moves, *(v for pair in passed.values() for v in pair)})
    own = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))
    asks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(needed)])
    given = own.withColumn("o", F.explode(asks)).select((F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), F.col("o.k").alias("k"), "z")
    answers = given.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in range(len(needed))])
    around = own.join(answers.hint("merge"), ["row", "col"])  # both are as long as the grid; Spark takes a few columns of it for small and would broadcast them
    z = {move: F.col(f"z{k}") for k, move in enumerate(needed)}
    steps = []
    for i, j in moves:
        length = size * (i * i + j * j) ** 0.5
        g = (z[i, j] - F.col("z")) / length
        fine = F.abs(g) <= g_max
        for a, b in passed.get((i, j), ()):
            one, two = size * (a * a + b * b) ** 0.5, size * ((i - a) ** 2 + (j - b) ** 2) ** 0.5
            fine = fine & (F.abs((z[a, b] - F.col("z")) / one) <= g_max) & (F.abs((z[i, j] - z[a, b]) / two) <= g_max)
        steps.append(F.when(fine, F.struct((F.col("row") + i).alias("to_row"), (F.col("col") + j).alias("to_col"), F.lit(length).alias("l"), g.alias("g"))))
    made = around.select("row", "col", F.explode(F.array(*steps)).alias("e")).where("e is not null").select("row", "col", "e.*")
    return made.withColumn("phi", minetti(F.col("g")) / 2.5)


def repeated_edges(found: DataFrame) -> DataFrame:
    """Edges that stand more than once, which no cost graph may have."""
    return found.groupBy("row", "col", "to_row", "to_col").count().where("count > 1")


def within(points: DataFrame, vertices: DataFrame, radius: float) -> DataFrame:
    """points (x, y) within radius of a vertex: an equi-join on square buckets, so only near pairs are compared."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = vertices.select(F.col("x").alias("vx"), F.col("y").alias("vy")).withColumn("o", F.explode(near)).select("vx", "vy", (F.floor(F.col("vx") / radius).cast("long") + F.col("o.i")).alias("bx"), (F.floor(F.col("vy") / radius).cast("long") + F.col("o.j")).alias("by")).distinct()
    dx, dy = F.col("x") - F.col("vx"), F.col("y") - F.col("vy")
    keyed = points.withColumns({"bx": F.floor(F.col("x") / radius).cast("long"), "by": F.floor(F.col("y") / radius).cast("long")})
    return keyed.join(spread, (keyed["bx"] == spread["bx"]) & (keyed["by"] == spread["by"]) & (dx * dx + dy * dy <= radius * radius), "left_semi").drop("bx", "by")


def without_near(sites: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """sites (x, y) farther than radius from each of the places: those at the ends of a line say where it was to go, not why."""
    near = within(sites, places, radius)
    return sites.join(near.select("x", "y").distinct(), ["x", "y"], "left_anti").select(*sites.columns)


def site_proximity(points: DataFrame, sites: DataFrame, saturation: float = 5000.0) -> DataFrame:
    """(id, proximity) of points (id, x, y): distance to the nearest site over saturation, at most 1. Only sites in neighbouring squares of that size
    can be nearer than it."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = sites.select(F.col("x").alias("sx"), F.col("y").alias("sy")).distinct().withColumn("o", F.explode(near)).select("sx", "sy", (F.floor(F.col("sx") / saturation) + F.col("o.i")).cast("long").alias("bx"), (F.floor(F.col("sy") / saturation) + F.col("o.j")).cast("long").alias("by"))
    keyed = points.select("id", "x", "y", F.floor(F.col("x") / saturation).cast("long").alias("bx"), F.floor(F.col("y") / saturation).cast("long").alias("by"))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    found = keyed.join(spread, ["bx", "by"], "left").groupBy("id").agg(F.min(dx * dx + dy * dy).alias("d2"))
    return found.select("id", F.coalesce(F.least(F.lit(1.0), F.sqrt("d2") / saturation), F.lit(1.0)).alias("proximity"))


def corridor_mask(cells: DataFrame, seg: DataFrame, size: float, radius: float, water: DataFrame | None = None, most_water: float = 0.5) -> DataFrame:
    """Cells (row, col) that the buffer of radius (a cell at least) around segments (x, y, x1, y1) touches, without those of water (row, col). It is an
    error if there are none, or if water would take more than most_water of them: then the lines or the water are in other coordinates."""
    from .lines import _squares, to_segment
    from .network import cut_lineage

    own = cells.select("row", "col", (F.col("col") * size).alias("px"), (F.col("row") * size).alias("py"))
    reach = radius + size
    spread = seg.select("x", "y", "x1", "y1").withColumn("bx", F.explode(_squares(F.least("x", "x1") - reach, F.greatest("x", "x1") + reach, reach))).withColumn("by", F.explode(_squares(F.least("y", "y1") - reach, F.greatest("y", "y1") + reach, reach)))
    joined = own.withColumns({"bx": F.floor(F.col("px") / reach).cast("long"), "by": F.floor(F.col("py") / reach).cast("long")}).join(spread, ["bx", "by"])
    half = size / 2
    corners = [to_segment(F.col("px") + a * half, F.col("py") + b * half, F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))[0] for a in (-1, 1) for b in (-1, 1)]
    off = lambda c, p: F.greatest(F.abs(F.col(c) - F.col(p)) - half, F.lit(0.0))
    ends = [F.pow(off(x, "px"), 2) + F.pow(off(y, "py"), 2) for x, y in (("x", "y"), ("x1", "y1"))]
    inside = cut_lineage(joined.where(F.least(*corners, *ends) <= radius * radius).select("row", "col").distinct())
    n = inside.count()
    if not n:
        raise ValueError("the lines' corridor touches no cell")
    if water is None:
        return inside
    dry = cut_lineage(inside.join(water.select("row", "col"), ["row", "col"], "left_anti"))
    if n - dry.count() > most_water * n:
        raise ValueError("water would take most of the corridor")
    return dry


def cut_off(vertices: DataFrame, key: str, box: tuple[float, float, float, float], margin: float) -> DataFrame:
    """(key, cut): whether a line's vertex comes within margin of the box's sides: then one of its ends is where the box stops."""
    x0, y0, x1, y1 = box
    away = F.least(F.abs(F.col("x") - x0), F.abs(F.col("x") - x1), F.abs(F.col("y") - y0), F.abs(F.col("y") - y1))
    return vertices.groupBy(key).agg((F.min(away) <= margin).alias("cut"))


def line_tortuosity(rows: DataFrame) -> DataFrame:
    """Per track length, sinuosity (null where the ends meet) and largest turn in degrees."""
    order = Window.partitionBy("track").orderBy("seq")
    seg = rows.withColumns({"dx": F.col("x") - F.lag("x").over(order), "dy": F.col("y") - F.lag("y").over(order)})
    ends = seg.groupBy("track").agg(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("length_m"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    moving = seg.where("dx <> 0 or dy <> 0").withColumns({"ex": F.lead("dx").over(order), "ey": F.lead("dy").over(order)})
    cos = (F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) / (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")))
    turns = moving.where("ex is not null").groupBy("track").agg(F.max(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))).alias("turn_deg"))
    straight: Column = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return ends.join(turns, "track", "left").select("track", "length_m", F.when(straight > 0, F.col("length_m") / straight).alias("sinuosity"), "turn_deg")
