"""How large a study's box has to be: bounds of lines, what growing the box costs in cells and memory, registry rows that aren't lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import graph_gigabytes
from ..functions.geo import lon_lat, utm
from ..operators.network import cut_lineage

#: Times the corridor that a box reaches beyond the lines in it.
AIR = 1.1


def bounds(rows: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1) of vertices (key, x, y)."""
    return rows.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def running_bounds(boxes: DataFrame, order: list[str]) -> DataFrame:
    """boxes with the bounds of each and all before it in the order. The boxes are as many as there are names."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return boxes.withColumns({"n": F.count("*").over(upto), **{f"all_{c}": (F.min if c[1] == "0" else F.max)(c).over(upto) for c in ("x0", "y0", "x1", "y1")}})


def with_air(corridor: float, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    air = corridor * AIR
    return x0 - air, y0 - air, x1 + air, y1 + air


def degrees_outward(x0: Column, y0: Column, x1: Column, y1: Column, epsg: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a box in metres: of its corners, rounded outward to thousandths."""
    corners = [lon_lat(x, y, epsg) for x in (x0, x1) for y in (y0, y1)]
    lons, lats = [c[0] for c in corners], [c[1] for c in corners]
    down, up = (lambda c: F.floor(c * 1000) / 1000), (lambda c: F.ceil(c * 1000) / 1000)
    return down(F.least(*lons)), down(F.least(*lats)), up(F.greatest(*lons)), up(F.greatest(*lats))


def grid_size(west: Column, south: Column, east: Column, north: Column, epsg: int, size: float) -> tuple[Column, Column]:
    """Columns and rows of the grid that covers a box in degrees, snapped outward to the cell size."""
    corners = [utm(lon, lat, epsg) for lon in (west, east) for lat in (south, north)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    span = lambda v: (F.ceil(F.greatest(*v) / size) - F.floor(F.least(*v) / size)).cast("long")
    return span(xs), span(ys)


def growth(boxes: DataFrame, now: tuple[float, float, float, float], corridor: float, epsg: int, size: float, components: int) -> DataFrame:
    """boxes (name, x0, y0, x1, y1 in metres) with cells_alone, the cells of a box grown for each alone, and, from the cheapest on, the box in degrees that
    holds all so far, its cells, the factor over the cells of the box now and the graph's memory."""
    cells = lambda w, s, e, n: (lambda c, r: c * r)(*grid_size(w, s, e, n, epsg, size))
    joined = lambda d: (F.least(d[0], F.lit(now[0])), F.least(d[1], F.lit(now[1])), F.greatest(d[2], F.lit(now[2])), F.greatest(d[3], F.lit(now[3])))
    names = ("west", "south", "east", "north")
    # the projections' series are long: each is computed from a table, not from the other's expression
    placed = lambda df, ends: cut_lineage(df.withColumns(dict(zip(names, joined(degrees_outward(*with_air(corridor, *[F.col(c) for c in ends]), epsg)), strict=True))))
    alone = cut_lineage(placed(boxes, ("x0", "y0", "x1", "y1")).withColumn("cells_alone", cells(*[F.col(n) for n in names])))
    run = running_bounds(alone.drop(*names), ["cells_alone", "name"])
    out = cut_lineage(placed(run, ("all_x0", "all_y0", "all_x1", "all_y1")).withColumn("cells", cells(*[F.col(n) for n in names])))
    return out.withColumns({"factor": F.col("cells") / cells(*[F.lit(float(v)) for v in now]), "graph_gb": graph_gigabytes(F.col("cells"), components)}).drop("all_x0", "all_y0", "all_x1", "all_y1")


def spread(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, diagonal, length, ratio, label): the diagonal of a name's bounds over the length of its lines (key, length): a name whose pieces lie
    far apart for their length (over 5) is a label of the registry and no road. Infinite where there is no length."""
    box = bounds(rows, key).select(key, F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("diagonal"))
    ratio = F.when(F.col("length") > 0, F.col("diagonal") / F.col("length")).otherwise(float("inf"))
    return box.join(totals, key).withColumn("ratio", ratio).withColumn("label", F.col("ratio") > 5)


def inside(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Segments (..., x, y, x1, y1) cut to a box: the share of each that lies inside, by the ends of its stretch between the four sides;
    those outside go."""
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    low, high, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, F.col("x") - box[0]), (dx, box[2] - F.col("x")), (-dy, F.col("y") - box[1]), (dy, box[3] - F.col("y"))):
        t = q / F.nullif(p, F.lit(0.0))
        low, high = F.when(p < 0, F.greatest(low, t)).otherwise(low), F.when(p > 0, F.least(high, t)).otherwise(high)
        out = out | ((p == 0) & (q < 0))
    cut = rows.withColumns({"__a": low, "__b": high}).where(~out & (F.col("__a") < F.col("__b")))
    place = lambda t: (F.col("x") + t * dx, F.col("y") + t * dy)
    (xa, ya), (xb, yb) = place(F.col("__a")), place(F.col("__b"))
    return cut.withColumns({"__x": xa, "__y": ya, "__x1": xb, "__y1": yb}).drop("x", "y", "x1", "y1", "__a", "__b").withColumnsRenamed({"__x": "x", "__y": "y", "__x1": "x1", "__y1": "y1"})


def outside_length(rows: DataFrame, key: str, box: tuple[float, float, float, float], least: float) -> DataFrame:
    """(key, outside): how much of a line's length lies outside a box, where it is more than least, most first."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2))
    total = rows.groupBy(key).agg(F.sum(length).alias("all"))
    within = inside(rows, box).groupBy(key).agg(F.sum(length).alias("in"))
    out = total.join(within, key, "left").select(key, (F.col("all") - F.coalesce("in", F.lit(0.0))).alias("outside"))
    return out.where(F.col("outside") > least).orderBy(F.desc("outside"), key)


def source_summary(rows: DataFrame) -> DataFrame:
    """(features, parts, km, longest_km, little) of segments (feature, part, x, y, x1, y1): little where there are under 15 km."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2))
    parts = rows.groupBy("feature", "part").agg(F.sum(length).alias("m"))
    out = parts.agg(F.count_distinct("feature").alias("features"), F.count("*").alias("parts"), F.coalesce(F.sum("m") / 1000, F.lit(0.0)).alias("km"), F.coalesce(F.max("m") / 1000, F.lit(0.0)).alias("longest_km"))
    return out.withColumn("little", F.col("km") < 15)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, count), the most frequent first; null is a value."""
    return rows.groupBy(F.col(column).cast("string").alias("value")).count().orderBy(F.desc("count"), "value")
