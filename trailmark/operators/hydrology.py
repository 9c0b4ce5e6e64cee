"""Water on a raster of any size: filled depressions and upstream cells, tile by tile.

A tile is a square of cells that one task holds as an array. What crosses a tile's edge comes from the tiles beside it, as of the round before;
rounds go on until no value changes, so the result is that of the whole surface. Both recurrences settle inside a tile
by sweeps over the whole array."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import cut_lineage
from .raster import OFFSETS_8

STEP = 1e-4


def _tile(c: str | Column, size: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def outlets(cells: DataFrame) -> DataFrame:
    """cells with outlet: whether one of the eight neighbours is missing, as it is at the raster's frame."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in OFFSETS_8])
    beside = cells.select("row", "col").withColumn("o", F.explode(moves)).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    counts = beside.groupBy("row", "col").agg(F.count("*").alias("n"))
    return cells.join(counts, ["row", "col"], "left").withColumn("outlet", F.coalesce(F.col("n") < 8, F.lit(True))).drop("n")


def settle(z: np.ndarray, height: np.ndarray, fixed: np.ndarray, step: float = STEP) -> np.ndarray:
    """Heights of the array's inner cells once each that isn't fixed stands at its own z or a step over its lowest neighbour, whichever is
    higher, from heights that are no lower. z is nan where there is no cell; the rim is given."""
    inner = (slice(1, -1), slice(1, -1))
    free = ~np.isnan(z[inner]) & ~fixed[inner]
    while True:
        low = np.full(free.shape, np.inf)
        for i, j in OFFSETS_8:
            np.minimum(low, height[1 + i : height.shape[0] - 1 + i, 1 + j : height.shape[1] - 1 + j], out=low)
        new = np.where(free, np.fmin(height[inner], np.fmax(z[inner], low + step)), height[inner])
        if np.array_equal(new, height[inner]):
            return height
        height[inner] = new


def filled(cells: DataFrame, tile: int = 128, step: float = STEP, most_rounds: int = 10_000) -> DataFrame:
    """(row, col, z) with depressions filled up to where they spill, a step higher from cell to cell; outlets keep their heights."""
    state = outlets(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z")))
    state = cut_lineage(state.withColumns({"h": F.when(F.col("outlet"), F.col("z")).otherwise(float("inf")), "tr": _tile("row", tile), "tc": _tile("col", tile)}))
    schema = "row long, col long, z double, outlet boolean, h double, tr long, tc long, changed boolean"

    def one(p: pd.DataFrame) -> pd.DataFrame:
        own = p[p["own"]]
        r0, c0 = int(own["tr"].iloc[0]) * tile - 1, int(own["tc"].iloc[0]) * tile - 1
        z, height, fixed = np.full((tile + 2, tile + 2), np.nan), np.full((tile + 2, tile + 2), np.inf), np.zeros((tile + 2, tile + 2), bool)
        r, c = p["row"].to_numpy() - r0, p["col"].to_numpy() - c0
        z[r, c], height[r, c], fixed[r, c] = p["z"], p["h"], p["outlet"]
        settle(z, height, fixed, step)
        r, c = own["row"].to_numpy() - r0, own["col"].to_numpy() - c0
        return own.drop(columns="own").assign(h=height[r, c], changed=height[r, c] != own["h"].to_numpy())

    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in OFFSETS_8])
    for _ in range(most_rounds):
        edge = state.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1)))
        rim = edge.where("h < double('infinity')").withColumn("o", F.explode(moves)).withColumns({"nr": _tile(F.col("row") + F.col("o.i"), tile), "nc": _tile(F.col("col") + F.col("o.j"), tile)})
        rim = rim.where("nr <> tr or nc <> tc").select("row", "col", "z", "outlet", "h", F.col("nr").alias("tr"), F.col("nc").alias("tc")).distinct().join(state.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        both = state.select("row", "col", "z", "outlet", "h", "tr", "tc").withColumn("own", F.lit(True)).unionByName(rim.withColumn("own", F.lit(False)))
        state = cut_lineage(both.groupBy("tr", "tc").applyInPandas(one, schema))
        if state.where("changed").limit(1).count() == 0:
            return state.select("row", "col", F.col("h").alias("z"))
    raise RuntimeError("the heights did not settle")


def accumulation(flow: DataFrame, tile: int = 128, most_rounds: int = 10_000) -> DataFrame:
    """(row, col, cells): the cells upstream of each, itself included, from (row, col, to_row, to_col), null at outlets. Flow has no
    cycles."""
    keep = flow.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "to_row", "to_col")])
    state = cut_lineage(keep.withColumns({"cells": F.lit(0.0), "tr": _tile("row", tile), "tc": _tile("col", tile)}))
    schema = "row long, col long, to_row long, to_col long, cells double, tr long, tc long, changed boolean"

    def one(p: pd.DataFrame) -> pd.DataFrame:
        r, c = p["row"].to_numpy() - p["tr"].to_numpy() * tile, p["col"].to_numpy() - p["tc"].to_numpy() * tile
        at = np.full((tile, tile), -1)
        at[r, c] = np.arange(len(p))
        tr, tc = p["to_row"].to_numpy(float) - p["tr"].to_numpy() * tile, p["to_col"].to_numpy(float) - p["tc"].to_numpy() * tile
        inside = (tr >= 0) & (tr < tile) & (tc >= 0) & (tc < tile)  # nan is outside
        to = np.full(len(p), -1)
        to[inside] = at[tr[inside].astype(int), tc[inside].astype(int)]
        goes = np.flatnonzero(to >= 0)
        base = 1.0 + p["inflow"].to_numpy()
        count = base
        while True:
            new = base + np.bincount(to[goes], count[goes], len(p))
            if np.array_equal(new, count):
                break
            count = new
        return p.drop(columns="inflow").assign(cells=count, changed=count != p["cells"].to_numpy())

    for _ in range(most_rounds):
        over = state.where((_tile("to_row", tile) != F.col("tr")) | (_tile("to_col", tile) != F.col("tc")))
        inflow = over.groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("cells").alias("inflow"))
        given = state.drop("changed").join(inflow, ["row", "col"], "left").fillna(0.0, ["inflow"])
        state = cut_lineage(given.groupBy("tr", "tc").applyInPandas(one, schema))
        if state.where("changed").limit(1).count() == 0:
            return state.select("row", "col", "cells")
    raise RuntimeError("the counts did not settle")


def specific_area(cells: Column, size: float) -> Column:
    """Catchment area per width of a cell."""
    return cells * size


def is_channel(cells: Column, least_m2: float, size: float) -> Column:
    """Whether a cell's catchment is at least so many square metres."""
    return F.coalesce(cells * (size * size) >= least_m2, F.lit(False))
