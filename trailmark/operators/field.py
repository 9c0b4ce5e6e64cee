"""From two lines to a field plan: zones where they part, what they cost on the spot, stations, days, short codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lines
from .raster import bilinear

#: Shares of a line at which stations of its kind stand.
FRACTIONS = (0.25, 0.5, 0.75)


def separation_zones(profile: DataFrame, over: float = 250.0, least: float = 500.0) -> DataFrame:
    """Runs of profile (unit, seq, s, d) with d over `over` and at least `least` long: seq i and j one sample outside the run where
    there is one, k its farthest sample (the first of equal ones), and the ends and largest d."""
    order = Window.partitionBy("unit").orderBy("seq")
    marked = profile.withColumns({"high": F.col("d") > over, "before": F.lag("seq").over(order), "after": F.lead("seq").over(order)})
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy("unit", "high").orderBy("seq"))
    runs = marked.withColumn("run", run).where("high").groupBy("unit", "run").agg(
        F.min("s").alias("s0"), F.max("s").alias("s1"), F.max("d").alias("d"), F.max_by("seq", F.struct("d", -F.col("seq"))).alias("k"),
        F.min_by(F.coalesce("before", "seq"), "seq").alias("i"), F.max_by(F.coalesce("after", "seq"), "seq").alias("j"),
    )
    return runs.where(F.col("s1") - F.col("s0") >= least).drop("run")


def zone_ends(zones: DataFrame, profile: DataFrame) -> DataFrame:
    """Zones numbered along their unit, with the places one sample outside: (unit, zone, sa, ax, ay, sb, bx, by, d)."""
    at = lambda n: profile.select("unit", F.col("seq").alias(n), F.col("s").alias(f"s{'a' if n == 'i' else 'b'}"), F.col("x").alias(f"{'a' if n == 'i' else 'b'}x"), F.col("y").alias(f"{'a' if n == 'i' else 'b'}y"))
    numbered = zones.withColumn("zone", F.row_number().over(Window.partitionBy("unit").orderBy("s0")))
    return numbered.join(at("i"), ["unit", "i"]).join(at("j"), ["unit", "j"]).select("unit", "zone", "sa", "ax", "ay", "sb", "bx", "by", "d")


def zone_lines(ends: DataFrame, observed: DataFrame, modelled: DataFrame, radius: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(unit, part, seq, x, y) of both lines inside each zone, part its number: the observed one between its ends, and the modelled one between
    the places nearest to them, whichever way it runs."""
    cuts = ends.select("unit", F.col("zone").alias("part"), F.col("sa").alias("s0"), F.col("sb").alias("s1"))
    spots = ends.select("unit", F.explode(F.array(F.struct((F.col("zone") * 2).alias("pid"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct((F.col("zone") * 2 + 1).alias("pid"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("unit", "e.*")
    feet = lines.nearest_segment(spots, lines.segments(modelled, ["unit"]), ["unit"], radius)
    spans = feet.groupBy("unit", F.floor(F.col("pid") / 2).cast("int").alias("part")).agg(F.min("s").alias("s0"), F.max("s").alias("s1"))
    return lines.sections(observed, ["unit"], cuts), lines.sections(modelled, ["unit"], spans)


def measured_zones(ends: DataFrame, own: DataFrame, other: DataFrame, costs: DataFrame) -> DataFrame:
    """A row a zone: from_km, to_km, both lines' km, separation and the local ratio: what following the observed line costs over the least cost
    between the same ends; costs (unit, zone, band, free)."""
    km = lambda rows, name: lines.lengths(rows, ["unit", "part"]).select("unit", F.col("part").alias("zone"), (F.col("length") / 1000).alias(name))
    rows = ends.join(km(own, "observed_km"), ["unit", "zone"], "left").join(km(other, "modelled_km"), ["unit", "zone"], "left").join(costs, ["unit", "zone"], "left")
    return rows.select("unit", "zone", (F.col("sa") / 1000).alias("from_km"), (F.col("sb") / 1000).alias("to_km"), F.coalesce("observed_km", F.lit(0.0)).alias("observed_km"), F.coalesce("modelled_km", F.lit(0.0)).alias("modelled_km"), F.col("d").alias("apart_m"), F.when(F.col("free") > 0, F.col("band") / F.col("free")).alias("ratio"))


def chosen_zones(zones: DataFrame, unit_ratios: DataFrame, most: int = 4, longest_km: float = 20.0) -> DataFrame:
    """zones (unit, zone, observed_km, ratio) to go to, with priority and control: of those that can be walked the ones with the largest ratio, and, if
    none of them is in the unit (unit, ratio) that the model explains best, the longest of that unit, to see what agreement looks like."""
    short = zones.where(F.col("observed_km") <= longest_km)
    top = short.orderBy(F.desc_nulls_last("ratio"), "unit", "zone").limit(most).withColumn("rank", F.lit(0))
    best = unit_ratios.where("ratio is not null").orderBy("ratio", "unit").limit(1).select(F.col("unit").alias("best"))
    longest = short.join(F.broadcast(best), F.col("unit") == F.col("best")).orderBy(F.desc("observed_km"), "zone").limit(1)  # one row
    control = longest.join(top.select(F.col("unit").alias("u")), F.col("best") == F.col("u"), "left_anti").drop("best").withColumn("rank", F.lit(1))
    both = top.unionByName(control).join(F.broadcast(best), F.lit(True), "left")
    number = F.row_number().over(Window.orderBy("rank", F.desc_nulls_last("ratio"), "unit", "zone"))  # most + 1 rows
    return both.withColumn("priority", number).withColumn("control", F.coalesce(F.col("unit") == F.col("best"), F.lit(False))).drop("rank", "best")


def stations(goals: DataFrame, ends: DataFrame, own: DataFrame, other: DataFrame, observed: DataFrame, heights: DataFrame | None = None, size: float = 1.0) -> DataFrame:
    """(unit, zone, code, kind, note, x, y, away_m, height): where to stand in each zone of goals (unit, zone, priority, ...): its two ends (C), three places on the
    observed line (A) and three on the modelled one (B), with the distance to the observed line. heights: cells (row, col, z)."""
    codes = zone_codes(goals.select("unit", "zone", "priority").withColumns({"seq": F.col("priority"), "name": F.col("unit")})).select("unit", "zone", "code")
    tops = ends.join(codes, ["unit", "zone"])
    corner = tops.select("unit", "zone", "code", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("the lines part").alias("note"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(2).alias("n"), F.lit("the lines meet again").alias("note"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("unit", "zone", "code", F.lit("C").alias("kind"), "e.*")
    found = corner
    for kind, rows, first in (("A", own, 3), ("B", other, 3 + len(FRACTIONS))):
        total = lines.lengths(rows, ["unit", "part"]).where("length > 0")
        spots = total.withColumn("f", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(FRACTIONS)]))).select("unit", "part", F.col("f.i").alias("i"), (F.col("length") * F.col("f.x")).alias("s"))
        placed = lines.places(rows, ["unit", "part"], spots).join(codes.withColumnRenamed("zone", "part"), ["unit", "part"])
        note = F.lit("on the observed line" if kind == "A" else "on the modelled line")
        found = found.unionByName(placed.select("unit", F.col("part").alias("zone"), "code", F.lit(kind).alias("kind"), (F.col("i") + first).alias("n"), note.alias("note"), "x", "y"))
    found = found.withColumn("code", F.concat("code", F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")))
    keyed = found.withColumn("pid", F.xxhash64("unit", "zone", "n"))
    away = lines.nearest_segment(keyed.select("unit", "pid", "x", "y"), lines.segments(observed, ["unit"]), ["unit"], 100.0).select("unit", "pid", F.col("d").alias("away_m"))
    out = keyed.join(away, ["unit", "pid"], "left")
    if heights is None:
        return out.withColumn("height", F.lit(None).cast("double")).drop("pid", "n")
    sampled = bilinear(heights, out.select(F.col("pid").alias("id"), (F.col("y") / size).alias("fr"), (F.col("x") / size).alias("fc")))
    return out.join(sampled.select(F.col("id").alias("pid"), F.when(F.col("v") >= -1000, F.col("v")).alias("height")), "pid", "left").drop("pid", "n")


def day_plan(ends: DataFrame, own: DataFrame, other: DataFrame, observed: DataFrame, heights: DataFrame | None = None, size: float = 1.0, step: float = 30.0) -> DataFrame:
    """(unit, zone, km, climb_m, descent_m, off_km, walk_km, days): what walking a zone takes: along the observed line with its ups and downs, and out and back to
    the places on the modelled line."""
    total = lines.lengths(own, ["unit", "part"]).withColumn("km", F.col("length") / 1000)
    if heights is None:
        climbs = total.select("unit", "part", F.lit(0.0).alias("climb_m"), F.lit(0.0).alias("descent_m"))
    else:
        count = F.greatest(F.lit(2), F.floor(F.col("length") / step).cast("int") + 1)
        spots = lines.equidistant(own, ["unit", "part"], count).withColumn("id", F.xxhash64("unit", "part", "k"))
        high = spots.join(bilinear(heights, spots.select("id", (F.col("y") / size).alias("fr"), (F.col("x") / size).alias("fc"))), "id")
        rise = F.col("v") - F.lag("v").over(Window.partitionBy("unit", "part").orderBy("k"))
        climbs = high.withColumn("r", rise).groupBy("unit", "part").agg(F.coalesce(F.sum(F.when(F.col("r") > 0, F.col("r"))), F.lit(0.0)).alias("climb_m"), F.coalesce(-F.sum(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)).alias("descent_m"))
    longs = lines.lengths(other, ["unit", "part"]).where("length > 0")
    spots = longs.withColumn("f", F.explode(F.array(*map(F.lit, FRACTIONS)))).select("unit", "part", "f", (F.col("length") * F.col("f")).alias("s"))
    placed = lines.places(other, ["unit", "part"], spots).withColumn("pid", F.xxhash64("part", "f"))
    off = lines.nearest_segment(placed.select("unit", "pid", "x", "y"), lines.segments(observed, ["unit"]), ["unit"], 100.0)
    off = placed.join(off.select("unit", "pid", "d"), ["unit", "pid"]).groupBy("unit", "part").agg((2 * F.sum("d") / 1000).alias("off_km"))
    out = total.join(climbs, ["unit", "part"], "left").join(off, ["unit", "part"], "left").fillna(0.0, ["climb_m", "descent_m", "off_km"]).withColumn("walk_km", F.col("km") + F.col("off_km"))
    out = ends.select("unit", F.col("zone").alias("part")).join(out, ["unit", "part"])
    return out.select("unit", F.col("part").alias("zone"), "km", "climb_m", "descent_m", "off_km", "walk_km", field_days(F.col("walk_km"), F.col("climb_m")).alias("days"))


def field_days(km: Column, climb: Column, km_a_day: float = 14.0, climb_a_day: float = 1200.0) -> Column:
    """Days for a zone: by distance or by climb, whichever asks for more, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(km / km_a_day, climb / climb_a_day))).cast("long")


def zone_codes(zones: DataFrame) -> DataFrame:
    """zones (seq, name) with code: two letters of each of the first two words, ZON without any; repeats are numbered from 2 by seq."""
    words = F.filter(F.split(F.upper("name"), "[^0-9A-Z]+"), lambda w: w != "")
    base = F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 2)), "")
    based = zones.withColumn("base", F.when(base == "", "ZON").otherwise(base))
    n = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    return based.withColumn("code", F.when(n == 1, F.col("base")).otherwise(F.concat("base", n.cast("string")))).drop("base")
