"""Lines of sight over raster cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import bilinear

# Refraction coefficient and mean radius of the earth in metres.
REFRACTION, EARTH = 0.13, 6371000.0


def _heights(cells: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """points (id, x, y) with their height z; those outside the cells are left out."""
    sampled = bilinear(cells, points.select("id", (F.col("y") / size).alias("fr"), (F.col("x") / size).alias("fc"))).where("v is not null")
    return points.join(sampled, "id").select("id", "x", "y", F.col("v").alias("z"))


def visible_share(cells: DataFrame, nodes: DataFrame, sites: DataFrame, size: float, radius: float, eye: float = 1.65, target: float = 0.0) -> DataFrame:
    """(id, visible, share): of the sites that lie on the raster, how many each node sees within radius; x and y count from the
    centre of cell (0, 0), y with the rows. Terrain between the ends hides where it stands over the line of sight, curvature and
    refraction included; missing terrain hides nothing, nor do the ends themselves; nodes off the raster see nothing.

    Sites and nodes meet by squares of the radius. A pair is a row and its samples are a stage's rows, of which only the
    corners' heights are looked up, so neither a node's nor a site's pairs gather in one task."""
    samples = max(2, math.ceil(radius / (size / 2)))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    site = _heights(cells, sites, size).select(F.col("id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("z") + target).alias("sz"))
    total = site.agg(F.count("*").alias("total"))
    spread = site.withColumn("o", F.explode(near)).select("site", "sx", "sy", "sz", (F.floor(F.col("sx") / radius) + F.col("o.i")).alias("bx"), (F.floor(F.col("sy") / radius) + F.col("o.j")).alias("by"))
    eyes = _heights(cells, nodes, size).withColumns({"z": F.col("z") + eye, "bx": F.floor(F.col("x") / radius), "by": F.floor(F.col("y") / radius)})
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    pairs = eyes.join(spread, ["bx", "by"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)
    rays = pairs.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("s", F.col("s") / (samples + 1))
    rays = rays.select(F.struct("id", "site", "s").alias("key"), "d2", "s", "z", "sz", ((F.col("sy") + F.col("s") * dy) / size).alias("fr"), ((F.col("sx") + F.col("s") * dx) / size).alias("fc"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    wr, wc = F.col("fr") - F.floor("fr"), F.col("fc") - F.floor("fc")
    w = F.when(F.col("o.i") == 1, wr).otherwise(1 - wr) * F.when(F.col("o.j") == 1, wc).otherwise(1 - wc)
    lifted = (1 - REFRACTION) * F.col("d2") * F.col("s") * (1 - F.col("s")) / (2 * EARTH)
    line = F.col("sz") + (F.col("z") - F.col("sz")) * F.col("s")
    spots = rays.withColumn("o", F.explode(corners)).select("key", (line - lifted).alias("limit"), w.alias("w"), (F.floor("fr") + F.col("o.i")).alias("row"), (F.floor("fc") + F.col("o.j")).alias("col")).where("w > 0")
    ground = spots.join(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").alias("h")), ["row", "col"], "left")
    sample = ground.groupBy("key").agg(F.max("limit").alias("limit"), F.when(F.count("h") == F.count("*"), F.sum(F.col("w") * F.col("h"))).alias("h"))
    seen = sample.groupBy(F.col("key.id").alias("id"), F.col("key.site").alias("site")).agg(F.max(F.coalesce(F.col("h") > F.col("limit"), F.lit(False)).cast("int")).alias("hidden"))
    counts = seen.groupBy("id").agg(F.count_if(F.col("hidden") == 0).alias("visible"))
    out = nodes.select("id").join(counts, "id", "left").crossJoin(F.broadcast(total))  # one row of total
    return out.select("id", F.coalesce("visible", F.lit(0)).alias("visible"), F.when(F.col("total") > 0, F.coalesce("visible", F.lit(0)) / F.col("total")).alias("share"))
