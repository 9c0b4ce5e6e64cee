"""Embedding near-duplicates: int8 tile products with rigorous error bounds, full precision where the bound leaves doubt.

Rows of equal label and equal components are one class, under a number of its own. The classes of a label stand in tiles of about
tile rows, so a hot label is only more tiles. Tiles follow cells: a label of more than one tile gives each unit vector to the nearest of as many
pivots (vectors with the smallest hashes, PIVOTS at most), and a cell's vectors are dealt over its tiles by a hash. A tile knows its pivot and the largest
angle to it; by the triangle inequality on angles a pair of tiles is left out where the pivots' angle less both radii is over the
threshold's angle. The other pairs of tiles are groups of bounded size. In a group each unit vector u is s * q + e with int8 q, and

    |u.v - s_u s_v q_u.q_v| <= |e_u| |v| + |s_u q_u| |e_v| <= |e_u| + (1 + |e_u|) |e_v|

so pairs whose quantised cosine plus that bound stays under the threshold are out, and the rest is computed in double precision, after
each vector is divided by its largest component, so that no square overflows or vanishes. A pair of tiles returns a count for each
class and a spanning forest, never its pairs.

Cases: rows with a null label or id, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different length don't link; equal rows link with each other; rows that repeat an id with other vectors are classes
of their own and one node of the components; a row with null id keeps itself; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_or, discard, join_counted, small, tidy, written
from .components import connected_components, roots

PIVOTS = 64


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component; the cosine stays."""
    return v / np.abs(v).max(axis=1)[:, None]


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt(np.square(v).sum(axis=1))[:, None]


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale of each row, and the length of what the rounding left (with room for the arithmetic itself)."""
    scale = np.abs(units).max(axis=1) / 127.0
    q = np.rint(units / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(np.square(units - scale[:, None] * q).sum(axis=1)) + 1e-12


def candidate_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs with cosine >= threshold, and how many were computed in full precision. same: left is right, i < j only."""
    left, right = scaled(left), scaled(right)
    ln, rn = np.sqrt(np.square(left).sum(axis=1)), np.sqrt(np.square(right).sum(axis=1))
    lu = left / ln[:, None]
    ru = lu if same else right / rn[:, None]
    (lq, ls, le), (rq, rs, re) = quantise(lu), quantise(ru)
    rf = rq.astype(np.float32).T  # products of int8 are exact in float32 up to 1,000 components; blocks of them are added in double
    found_i, found_j, computed = [], [], 0
    for a in range(0, len(left), 512):
        lf = lq[a : a + 512].astype(np.float32)
        dots = np.zeros((len(lf), len(right)))
        for k in range(0, left.shape[1], 1000):
            dots += lf[:, k : k + 1000] @ rf[k : k + 1000]
        own = le[a : a + 512, None]
        i, j = np.nonzero(dots * ls[a : a + 512, None] * rs + own + (1 + own) * re + 1e-9 >= threshold)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        computed += len(i)
        for k in range(0, len(i), 65536):
            x, y = i[k : k + 65536], j[k : k + 65536]
            ok = np.einsum("ij,ij->i", left[x], right[y]) / (ln[x] * rn[y]) >= threshold
            found_i.append(x[ok])
            found_j.append(y[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j]), computed


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _cells(classes: DataFrame, tile: int) -> DataFrame:
    """classes with cell (the nearest pivot of their label and dimension, -1 in a label of one tile) and angle to it."""
    rows = classes.join(small(written(classes.groupBy("label", "dim").agg(F.count("*").alias("size")), "sizes")), ["label", "dim"])
    large = rows.where(F.col("size") > tile).select("dim", "c", F.xxhash64("c").alias("h"))
    # about 8 * PIVOTS classes of a dimension, of which the smallest hashes are taken
    share = small(written(large.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(8 * PIVOTS)).alias("every")), "shares"))
    found = large.join(share, "dim").where(F.pmod("h", "every") == 0).groupBy("dim").agg(F.slice(F.array_sort(F.collect_set(F.struct("h", "c"))), 1, PIVOTS).alias("o"))
    wanted = found.select("dim", F.explode("o.c").alias("c"))
    pivots = {}
    for r in classes.join(F.broadcast(wanted), ["dim", "c"]).select("dim", "v").collect():  # PIVOTS rows a dimension
        pivots.setdefault(r[0], []).append(r[1])
    pivots = {d: units(np.array(sorted(v), float)) for d, v in pivots.items()}
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def near(batches):
        for b in batches:
            size, dim = b.column(5).to_numpy(), b.column(1).to_numpy()
            cell, angle = np.full(len(size), -1, np.int32), np.zeros(len(size))
            for d in np.unique(dim[size > tile]):
                at = np.flatnonzero((size > tile) & (dim == d))
                if d in shared.value:
                    cos = np.clip(units(_matrix(b.column(4).take(pa.array(at)), len(at))) @ shared.value[d].T, -1, 1)
                    # as many pivots as the label has tiles: smaller cells would only be more pairs of them
                    cos = np.where(np.arange(cos.shape[1]) < np.ceil(size[at] / tile)[:, None], cos, -1)
                    cell[at] = cos.argmax(axis=1)
                    angle[at] = np.arccos(cos.max(axis=1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(cell), pa.array(angle)], names=["label", "dim", "c", "m", "v", "cell", "angle"])

    kind = classes.schema["label"].dataType.simpleString()
    return rows.select("label", "dim", "c", "m", "v", "size").mapInArrow(tidy(near), f"label {kind}, dim int, c long, m long, v array<double>, cell int, angle double"), pivots


def link_embeddings(rows: DataFrame, threshold: float = 0.93, tile: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row vec_id, n_links, component_id, kept."""
    given = columns_or(rows, vec_id=id_col, v=vector_col, label=label_col).withColumn("v", F.col("v").cast("array<double>"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = given.where(fine).withColumns({"h1": F.xxhash64(F.lit(1), "v"), "h2": F.xxhash64(F.lit(2), "v")})
    # numbers of classes are fixed by the writing
    classes = written(valid.groupBy("label", "h1", "h2", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumns({"dim": F.size("v"), "c": F.monotonically_increasing_id()}), "classes")
    placed, pivots = _cells(classes, tile)
    placed = written(placed, "cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"), F.max("angle").alias("radius"))
    cells = written(cells, "tiles")
    apart = {(d, i, j): float(np.arccos(np.clip(p[i] @ p[j], -1, 1))) for d, p in pivots.items() for i in range(len(p)) for j in range(len(p))}
    reach = float(np.arccos(min(1.0, threshold))) + 1e-6  # room for the arithmetic of the angles
    a, b = (cells.select("label", "dim", F.col("cell").alias(f"cell{x}"), F.col("tiles").alias(f"tiles{x}"), F.col("radius").alias(f"radius{x}")) for x in "ab")
    pairs = a.join(b, ["label", "dim"]).where("cella <= cellb")
    if apart:  # PIVOTS squared rows a dimension
        table = classes.sparkSession.createDataFrame([(int(d), i, j, x) for (d, i, j), x in apart.items()], "dim int, cella int, cellb int, apart double")
        pairs = pairs.join(F.broadcast(table), ["dim", "cella", "cellb"], "left").where(F.coalesce(F.col("apart"), F.lit(0.0)) - F.col("radiusa") - F.col("radiusb") <= reach)
    sides = pairs.select("label", "dim", "cella", "cellb", "tilesa", "tilesb")
    # a class goes once to each tile that its own is held against
    own = placed.join(small(cells.select("label", "dim", "cell", "tiles")), ["label", "dim", "cell"]).withColumn("t", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")).select("label", "dim", "cell", "t", "c", "m", "v")
    lefts = sides.select("label", "dim", F.col("cella").alias("cell"), "cella", "cellb", F.col("tilesb").alias("others"), F.lit(False).alias("is_right"))
    rights = sides.where("cella < cellb").select("label", "dim", F.col("cellb").alias("cell"), "cella", "cellb", F.col("tilesa").alias("others"), F.lit(True).alias("is_right"))
    dealt = own.join(small(written(lefts.unionByName(rights), "sides")), ["label", "dim", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    within = F.col("cella") == F.col("cellb")
    dealt = dealt.select(
        "label", "dim", "cella", "cellb", "c", "m", "v",
        F.when(within, F.least("t", "other")).when(F.col("is_right"), F.col("other")).otherwise(F.col("t")).alias("i"),
        F.when(within, F.greatest("t", "other")).when(F.col("is_right"), F.col("t")).otherwise(F.col("other")).alias("j"),
        F.when(within, F.col("t") > F.col("other")).otherwise(F.col("is_right")).alias("right"),
    )

    def links(table: pa.Table) -> pa.Table:
        c, m, right = (table.column(x).to_numpy() for x in ("c", "m", "right"))
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        same = all(table.column(x)[0].as_py() == table.column(y)[0].as_py() for x, y in (("cella", "cellb"), ("i", "j")))
        x, y, _ = candidate_pairs(flat[a], flat[a] if same else flat[b], threshold, same)
        x, y = a[x], (a if same else b)[y]
        add = np.bincount(x, m[y], len(c)) + np.bincount(y, m[x], len(c))
        nodes, root = roots(c[x], c[y])
        hit = np.flatnonzero(add)
        return pa.table({"c": c[hit], "n_add": add[hit].astype(np.int64), "root": root[np.searchsorted(nodes, c[hit])].astype(np.int64)})

    found = written(dealt.groupBy("label", "dim", "cella", "cellb", "i", "j").applyInArrow(links, "c long, n_add long, root long"), "links")
    # classes' links in terms of their smallest ids; an id of several classes is one node
    names = written(classes.select("c", "rep", "label", "h1", "h2", "m"), "names")
    edges = found.where("c <> root").join(names.select("c", F.col("rep").alias("a")), "c").join(names.select(F.col("c").alias("root"), F.col("rep").alias("b")), "root").select("a", "b")
    members = join_counted(valid.select("vec_id", "label", "h1", "h2"), names, ["label", "h1", "h2"], "m").select("vec_id", "c", "rep", "m")
    members = written(members, "members")
    several = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("vec_id", "a")
    more = members.join(small(written(several, "several")), "vec_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    comps = connected_components(edges.unionByName(more))
    counts = found.groupBy("c").agg(F.sum("n_add").alias("n"))
    known = names.join(counts, "c", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = written(known.select("c", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    linked = join_counted(members.select("vec_id", "c"), known, ["c"], "m").select("vec_id", "n_links", "component_id")
    alone = given.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = written(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "embedding-links")
    discard(classes, placed, cells, found, names, members, known)
    return out
