"""Networks of lines: nodes within a tolerance, components, measures and edge betweenness.

Chains are rows (chain, x0, y0, x1, y1, length); end 2 * chain is a chain's first, 2 * chain + 1 its last."""

from __future__ import annotations

import heapq
import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the session's checkpoint folder; only where a local master has none set one of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and re.match(r"local(\[|$)", sc.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="trailmark-"))
    return df.checkpoint()


def _with_least(rows: DataFrame, least: DataFrame, hot: int = 10_000) -> DataFrame:
    """rows (u, v) with m of their u. Hubs, of which there are few, are broadcast, so that none's rows meet in one task."""
    hubs = least.where(F.col("n") > hot)
    many = hubs.count()
    if not many or many > 1_000_000:
        return rows.join(least.select("u", "m"), "u")
    return rows.join(F.broadcast(hubs.select("u", "m")), "u").unionByName(rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= hot).select("u", "m"), "u"))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the smallest node that each reaches: every root takes the smallest label beside its tree, and labels are
    followed to their end, until both ends of each edge agree."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return nodes, nodes[root]


def components(links: DataFrame, one_task: int = 500_000, most_rounds: int = 60) -> DataFrame:
    """(node, component) of links (a, b): component is the smallest node that can be reached. Up to one_task edges are solved in one task; more go
    through rounds of large and small stars, each two aggregations, until nothing changes. Nodes without a link to another node are not in
    the result unless linked to themselves."""
    own = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    if edges.count() <= one_task:

        def solve(batches):
            got = list(batches)
            if got:
                rows = pd.concat(got)
                nodes, low = least_reached(rows["u"].to_numpy(), rows["v"].to_numpy())
                yield pd.DataFrame({"node": nodes, "component": low})

        return edges.coalesce(1).mapInPandas(solve, "node long, component long").unionByName(own.select(F.col("node").cast("long"), F.col("component").cast("long"))).groupBy("node").agg(F.min("component").alias("component"))
    last = None
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = cut_lineage(_with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = _with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
    else:
        raise RuntimeError("the components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).unionByName(own).groupBy("node").agg(F.min("component").alias("component"))


def end_nodes(chains: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(end, node): ends at the same place to six decimals are one node, and with a tolerance so are places at most that far apart,
    directly or through others. A node is its smallest end. Only places in neighbouring squares are compared."""
    ends = chains.select(F.explode(F.array(F.struct((2 * F.col("chain")).alias("end"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct((2 * F.col("chain") + 1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e")).select("e.*")
    ends = ends.select(F.col("end").cast("long").alias("end"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    places = ends.groupBy("x", "y").agg(F.min("end").alias("node"))
    named = ends.join(places, ["x", "y"]).select("end", "node")
    if tolerance <= 0:
        return named
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = places.withColumns({"bx": F.floor(F.col("x") / tolerance), "by": F.floor(F.col("y") / tolerance)})
    other = here.withColumn("o", F.explode(near)).select((F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("node").alias("b"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    links = here.join(other, ["bx", "by"]).where((F.col("node") < F.col("b")) & (dx * dx + dy * dy <= tolerance * tolerance)).select(F.col("node").alias("a"), "b")
    joined = components(links).withColumnRenamed("component", "root")
    return named.join(joined, "node", "left").select("end", F.coalesce("root", "node").alias("node"))


def graph(chains: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Edges (chain, a, b, length) between nodes; loops are dropped."""
    node = end_nodes(chains, tolerance)
    first = node.where("end % 2 = 0").select(F.expr("end div 2").alias("chain"), F.col("node").alias("a"))
    last = node.where("end % 2 = 1").select(F.expr("end div 2").alias("chain"), F.col("node").alias("b"))
    return chains.select("chain", "length").join(first, "chain").join(last, "chain").where("a <> b").select("chain", "a", "b", "length")


def measures(edges: DataFrame) -> DataFrame:
    """Per component its nodes, edges, length, independent cycles, largest degree, and cycles over those possible (0 up to two nodes)."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    part = components(edges.select("a", "b"))
    nodes = degree.join(part, "node").groupBy("component").agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 1).alias("dead_ends"))
    lines = edges.join(part, edges["a"] == part["node"]).groupBy("component").agg(F.count("*").alias("edges"), F.sum("length").alias("length"))
    both = nodes.join(lines, "component").withColumn("cycles", F.col("edges") - F.col("nodes") + 1)
    return both.withColumn("alpha", F.when(F.col("nodes") > 2, F.col("cycles") / (2 * F.col("nodes") - 5)).otherwise(0.0))


def corridors(edges: DataFrame, least_km: float = 100.0) -> DataFrame:
    """(component, nodes, edges, km, cycles, alpha) of the components that are long enough to be a corridor, longest first. Without cycles a
    corridor is a tree: there is one way between any two places."""
    return measures(edges).withColumn("km", F.col("length") / 1000).where(F.col("km") >= least_km).select("component", "nodes", "edges", "km", "cycles", "alpha").orderBy(F.desc("km"), "component")


def tree_share(found: DataFrame) -> DataFrame:
    """Of corridors: their number, that of trees among them, kilometres of both, and the share of kilometres without alternatives."""
    tree = F.col("cycles") <= 0
    sums = found.agg(F.count("*").alias("corridors"), F.count_if(tree).alias("trees"), F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"), F.coalesce(F.sum(F.when(tree, F.col("km"))), F.lit(0.0)).alias("tree_km"))
    return sums.withColumn("no_choice", F.when(F.col("km") > 0, F.col("tree_km") / F.col("km")).otherwise(0.0))


def summary(edges: DataFrame, large_km: float = 100.0) -> DataFrame:
    """One row of what can be said of a network: sizes, kilometres by component, degrees, independent cycles."""
    part = cut_lineage(measures(edges).withColumn("km", F.col("length") / 1000))
    total = part.agg(
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.count("*").alias("components"), F.coalesce(F.sum("cycles"), F.lit(0)).alias("cycles"),
        F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"), F.coalesce(F.max("km"), F.lit(0.0)).alias("largest_km"), F.coalesce(F.percentile("km", F.lit(0.5)), F.lit(0.0)).alias("median_km"),
        F.count_if(F.col("km") >= large_km).alias("large"), F.coalesce(F.sum(F.when(F.col("km") >= large_km, F.col("km"))), F.lit(0.0)).alias("large_km"),
        F.coalesce(F.max("max_degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum("dead_ends"), F.lit(0)).alias("dead_ends"),
        F.max(F.struct("nodes", "edges")).alias("most"),
    )
    five = part.orderBy(F.desc("km"), "component").limit(5).agg(F.sort_array(F.collect_list("km"), asc=False).alias("five_km"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = total.withColumns({
        "largest_share": share("largest_km", "km"), "large_share": share("large_km", "km"), "mean_degree": F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0),
        "dead_end_share": share("dead_ends", "nodes"), "most_nodes": F.coalesce("most.nodes", F.lit(0)), "most_edges": F.coalesce("most.edges", F.lit(0)),
    })
    out = out.withColumn("most_share", share("most_nodes", "nodes")).drop("most", "large_km", "dead_ends")
    return out.crossJoin(F.broadcast(five))  # one row each


def corridor_betweenness(edges: DataFrame, least_km: float = 100.0, sources: int | None = 400) -> DataFrame:
    """betweenness inside each corridor of two edges or more. Chains outside aren't in the result: there is no network to measure them in."""
    inside = cut_lineage(edges.join(components(edges.select("a", "b")), edges["a"] == F.col("node")).drop("node"))
    big = inside.groupBy("component").agg(F.sum("length").alias("m"), F.count("*").alias("n")).where((F.col("m") >= least_km * 1000) & (F.col("n") > 1)).select("component")
    return betweenness(inside.join(big, "component", "left_semi").select("chain", "a", "b", "length"), sources)


def by_feature(middles: DataFrame, chain_segments: DataFrame, values: DataFrame, radius: float) -> DataFrame:
    """(feature, chain, value): for each feature's middle (feature, x, y) the nearest chain of chain_segments (chain, x, y, x1, y1) and its value
    in values (chain, value), null where it has none."""
    from .lines import nearest_segment

    seg = chain_segments.select(F.col("chain").alias("seq"), "x", "y", "x1", "y1", F.lit(0.0).alias("s"), F.lit(0.0).alias("s1"))
    near = nearest_segment(middles.select(F.col("feature").alias("pid"), "x", "y"), seg, [], radius)
    return near.select(F.col("pid").alias("feature"), F.col("seq").alias("chain")).join(values, "chain", "left").select("feature", "chain", "value")


def by_stretch(features: DataFrame, least: int = 1) -> DataFrame:
    """features (name, km, value) by name: most and median value, kilometres and number, the most central names first."""
    named = features.where("value is not null").withColumn("name", F.coalesce("name", F.lit("(sin nombre)")))
    sums = named.groupBy("name").agg(F.max("value").alias("most"), F.percentile("value", F.lit(0.5)).alias("median"), F.sum("km").alias("km"), F.count("*").alias("features"))
    return sums.where(F.col("features") >= least).orderBy(F.desc("most"), F.desc("median"), "name")


def tolerance_rows(chains: DataFrame, middles: DataFrame, chain_segments: DataFrame, tolerances: list[float], radius: float, least_km: float = 100.0, sources: int | None = 400) -> DataFrame:
    """For each tolerance: summary, number of corridors, features with a betweenness in a corridor, those that also had one at the tolerance
    before, and the rank correlations of the features' betweenness with the tolerance before, over all components and in corridors. One
    tolerance is one job over the whole network; the list is a parameter."""
    rows, before = [], {}
    for tolerance in tolerances:
        edges = cut_lineage(graph(chains, tolerance))
        row = summary(edges, least_km).first().asDict() | {"tolerance_m": float(tolerance), "corridors": corridors(edges, least_km).count()}  # a row of numbers
        for name, found in (("all", betweenness(edges, sources)), ("corridors", corridor_betweenness(edges, least_km, sources))):
            own = cut_lineage(by_feature(middles, chain_segments, found.select("chain", F.col("betweenness").alias("value")), radius).where("value is not null").select("feature", "value"))
            common, rho = 0, None
            if name in before:
                pairs = cut_lineage(own.join(before[name].withColumnRenamed("value", "old"), "feature").select(F.lit(0).alias("key"), F.col("value").alias("x"), F.col("old").alias("y")))
                common = pairs.count()
                rho = next((r["rho"] for r in spearman(pairs).collect()), None) if common > 2 else None  # one key
            row |= {f"features_{name}": own.count(), f"common_{name}": common, f"rho_{name}": rho}
            before[name] = own
        rows.append(row)
    numbers = {"rho_all": "double", "rho_corridors": "double", "five_km": "array<double>"}
    kinds = [f"{k} {numbers.get(k) or ('double' if isinstance(v, float) else 'long')}" for k, v in rows[0].items()]
    return chains.sparkSession.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows], ", ".join(kinds))


def verdict(rows: list[dict], no_choice: float = 0.0) -> str:
    """fragments, unstable or stable: what rows of tolerance_rows, the first at tolerance 0, let one say. Under a quarter of the kilometres in
    large components there is no network; an order that tolerance changes (rank correlation under 0.7, or under 50 features) isn't to be
    reported; `trees` is added where over 0.3 of a corridor's kilometres offer no choice of way."""
    known = [r for r in rows if r["rho_corridors"] is not None]
    if max(r["large_share"] for r in rows) < 0.25:
        out = "fragments"
    elif not known or min(r["rho_corridors"] for r in known) < 0.7 or min(r["common_corridors"] for r in known) < 50:
        out = "unstable"
    else:
        out = "stable"
    return out + (", trees" if no_choice > 0.3 else "")


def gained(observed: dict, both: dict) -> bool:
    """Whether lines that were inferred add structure: the largest component grows by 1.3, or a tenth of the kilometres joins large ones."""
    grows = both["largest_km"] / observed["largest_km"] if observed["largest_km"] else float("inf")
    return grows >= 1.3 or both["large_share"] - observed["large_share"] >= 0.1


def edge_shares(a: np.ndarray, b: np.ndarray, length: np.ndarray, sources: list[int]) -> np.ndarray:
    """For each edge, over shortest paths from the sources to every node, the share of paths that use it (ties share equally);
    parallel edges of the same length count as paths of their own."""
    near: dict[int, list[tuple[int, int, float]]] = {}
    for k, (u, v, w) in enumerate(zip(a.tolist(), b.tolist(), length.tolist(), strict=True)):
        near.setdefault(u, []).append((v, k, w))
        near.setdefault(v, []).append((u, k, w))
    total = np.zeros(len(a))
    for s in sources:
        best, paths, via, done, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
        closed = set()
        while heap:
            g, u = heapq.heappop(heap)
            if u in closed:
                continue
            closed.add(u)
            done.append(u)
            for v, k, w in near.get(u, ()):
                if v in closed:
                    continue
                d = g + w
                if v not in best or d < best[v]:
                    best[v], paths[v], via[v] = d, paths[u], [(u, k)]
                    heapq.heappush(heap, (d, v))
                elif d == best[v]:
                    paths[v] += paths[u]
                    via[v].append((u, k))
        owed = dict.fromkeys(done, 0.0)
        for v in reversed(done):
            for u, k in via[v]:
                c = paths[u] / paths[v] * (1 + owed[v])
                total[k] += c
                owed[u] += c
    return total


def betweenness(edges: DataFrame, sources: int | None = 400, batch: int = 50) -> DataFrame:
    """(component, chain, betweenness) within each component, over its n (n - 1) ordered pairs. Components of more than `sources` nodes
    are estimated from that many of them, picked by hash (a sampling operator; None: exact). Batches of sources are the parallel
    unit, and a task holds one component's edges. Lengths must be positive."""
    part = cut_lineage(components(edges.select("a", "b")))
    inside = edges.join(part, edges["a"] == part["node"]).select("component", "chain", "a", "b", "length")
    n = part.groupBy("component").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("node"), "node")) - 1
    picked = part.withColumn("rank", rank)
    if sources is not None:
        picked = picked.where(F.col("rank") < sources)
    picked = picked.select(F.col("component").alias("c"), (F.col("rank") / batch).cast("long").alias("batch"), F.col("node").alias("source"))
    batches = picked.select(F.col("c").alias("c2"), F.col("batch").alias("part")).distinct()
    copies = inside.join(batches, F.col("component") == F.col("c2")).drop("c2")

    def one(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("chain")
        share = edge_shares(e["a"].to_numpy(), e["b"].to_numpy(), e["length"].to_numpy(), s["source"].tolist())
        return pd.DataFrame({"component": e["component"].to_numpy(), "chain": e["chain"].to_numpy(), "share": share})

    parts = copies.groupBy("component", "part").cogroup(picked.groupBy("c", "batch")).applyInPandas(one, "component long, chain long, share double")
    used = F.col("n") if sources is None else F.least(F.col("n"), F.lit(sources))
    return parts.groupBy("component", "chain").agg(F.sum("share").alias("share")).join(n, "component").select("component", "chain", (F.col("share") / used / (F.col("n") - 1)).alias("betweenness"))


def spearman(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation of two columns by `key`, ties at their mean rank. Ranks come from counts of distinct values, so a key's window
    holds its values and not its rows."""
    pairs = pairs.select("key", F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").groupBy("key", "x", "y").agg(F.count("*").alias("n"))
    for c in ("x", "y"):
        counts = pairs.groupBy("key", c).agg(F.sum("n").alias("k"))
        upto = F.sum("k").over(Window.partitionBy("key").orderBy(c))
        pairs = pairs.join(counts.select("key", c, (upto - (F.col("k") - 1) / 2).alias(f"r{c}")), ["key", c])
    mean = pairs.groupBy("key").agg((F.sum("n") + 1).alias("m"))  # twice the mean rank, on both sides
    off = pairs.join(mean, "key").select("key", "n", (F.col("rx") - F.col("m") / 2).alias("a"), (F.col("ry") - F.col("m") / 2).alias("b"))
    sums = off.groupBy("key").agg(F.sum(F.col("n") * F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("n") * F.col("b") * F.col("b")).alias("bb"))
    return sums.select("key", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).alias("rho"))
