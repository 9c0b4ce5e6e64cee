"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label.copy())  # hook the old roots too
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return nodes, nodes[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges, an edge from each node to its smallest: memory of the nodes so far, solved anew when as many edges
    again have come."""
    a = b = np.zeros(0, np.int64)
    waiting, n = [], 0

    def solved() -> tuple[np.ndarray, np.ndarray]:
        x, y = roots(np.concatenate([a, *(w[0] for w in waiting)]), np.concatenate([b, *(w[1] for w in waiting)]))
        return x[x != y], y[x != y]

    for x in batches:
        waiting.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += x.num_rows
        if n > max(len(a), 1 << 18):
            a, b = solved()
            waiting, n = [], 0
    a, b = solved()
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected_components(edges: DataFrame, one_task: int = 1_000_000, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a, b), component the smallest id reached; nodes without edges aren't in it.

    Each partition first keeps a forest. Up to one_task edges then meet in one task; more go through large-star and small-star
    rounds, each written to the shared folder, until nothing changes."""
    given = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    now = written(given.mapInArrow(_forest, "a long, b long"), "edges")
    size = now.count()
    if size <= one_task:
        return now.coalesce(1).mapInArrow(_forest, "a long, b long").transform(_with_roots)
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_counted(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        lower = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lower")
        small = join_counted(large, lower, ["a"], "n").select(F.greatest("b", "m").alias("x"), "a", "m")
        before, now = now, written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "star")
        discard(before, least, large, lower)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("the components did not settle")
    return _with_roots(now)


def _with_roots(star: DataFrame) -> DataFrame:
    tops = star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
