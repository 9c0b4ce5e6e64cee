"""Least-cost paths over cost graphs: units and bands as joins, searches as grouped kernels, sweeps over weights and what they tell.

A cost graph is rows (src, dst, l, phi array, row, col): directed edges with length, a relative cost for each component, and the cell of src. A
unit is a line to compare with; its graph is what lies around it. A group of a kernel is one unit's graph with a batch of weights or draws: the
graph is read into arrays once, and only the edges' costs change from one search to the next."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lines
from .nulls import null_surface


class Network:
    """A directed graph in arrays; edges are sorted by their source."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.order = np.argsort(src, kind="stable")
        self.nodes = np.unique(np.concatenate([src, dst]))
        self.src, self.dst = (np.searchsorted(self.nodes, x[self.order]) for x in (src, dst))
        self.first = np.searchsorted(self.src, np.arange(len(self.nodes) + 1)).tolist()
        self.to = self.dst.tolist()

    def at(self, node: int) -> int | None:
        k = int(np.searchsorted(self.nodes, node))
        return k if k < len(self.nodes) and self.nodes[k] == node else None

    def search(self, cost: np.ndarray, start: int, goal: int | None = None) -> tuple[list[float], list[int]]:
        """Least cost from start to each node by position, and the node before it; it stops at goal. cost is in the order of the edges given."""
        c, to, first = cost[self.order].tolist(), self.to, self.first
        best, before = [float("inf")] * len(self.nodes), [-1] * len(self.nodes)
        best[start] = 0.0
        heap = [(0.0, start)]
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            g, u = pop(heap)
            if g > best[u]:
                continue
            if u == goal:
                break
            for k in range(first[u], first[u + 1]):
                v, total = to[k], g + c[k]
                if total < best[v]:
                    best[v], before[v] = total, u
                    push(heap, (total, v))
        return best, before

    def path(self, cost: np.ndarray, start: int, goal: int) -> tuple[float, np.ndarray]:
        """Least cost between two nodes by name, and the nodes by position; infinite and empty where there is no way."""
        a, b = self.at(start), self.at(goal)
        if a is None or b is None:
            return float("inf"), np.zeros(0, np.int64)
        best, before = self.search(cost, a, b)
        if best[b] == float("inf"):
            return best[b], np.zeros(0, np.int64)
        way = [b]
        while way[-1] != a:
            way.append(before[way[-1]])
        return best[b], np.array(way[::-1])


def dijkstra(src: np.ndarray, dst: np.ndarray, cost: np.ndarray, start: int) -> tuple[dict[int, float], dict[int, int]]:
    """Least cost from start to each node it reaches, and the node before it."""
    net = Network(np.asarray(src), np.asarray(dst))
    best, before = net.search(np.asarray(cost, float), net.at(start))
    names = net.nodes.tolist()
    return {names[i]: g for i, g in enumerate(best) if g < float("inf")}, {names[i]: names[p] for i, p in enumerate(before) if p >= 0}


class _Unit:
    """A unit's graph from the rows of its edges."""

    def __init__(self, e: pa.Table, size: float):
        src = e.column("src").to_numpy()
        self.net = Network(src, e.column("dst").to_numpy())
        self.l = e.column("l").to_numpy()
        self.phi = e.column("phi").combine_chunks().flatten().to_numpy().reshape(len(src), -1) if len(src) else np.zeros((0, 1))
        self.cell = np.zeros((len(self.net.nodes), 2))
        self.cell[np.searchsorted(self.net.nodes, src)] = np.column_stack([e.column("row").to_numpy(), e.column("col").to_numpy()])
        self.size = size

    def xy(self, way: np.ndarray) -> np.ndarray:
        return self.cell[way][:, ::-1] * self.size


def _points(value) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in value or []], float).reshape(-1, 2)


def check_weights(w: list[float], k: int) -> list[float]:
    """w, if it is k parts that are not negative and sum to 1."""
    if len(w) != k or min(w) < 0 or abs(sum(w) - 1) > 1e-9:
        raise ValueError(f"weights must be {k} parts, none negative, that sum to 1")
    return w


SWEPT = "unit string, weight_id long, cost double, d double, length double, path array<long>"


def sweep(edges: DataFrame, ends: DataFrame, weights: DataFrame, batch: int = 32, size: float = 1.0) -> DataFrame:
    """For every unit and weight vector the least cost, the path, its length, and its mean distance d to the observed line. edges (unit, src, dst,
    l, phi array, row, col), ends (unit, start, goal, and observed, an array of places (x, y)), weights (weight_id, w array). Batches of
    weights are the parallel unit; an unreachable goal costs infinity, is infinitely far and has no path."""
    if "observed" not in ends.columns:
        ends = ends.withColumn("observed", F.array().cast("array<struct<x:double,y:double>>"))
    groups = ends.select("unit", "start", "goal", "observed").crossJoin(F.broadcast(weights.select("weight_id", "w"))).withColumn("batch", F.floor(F.col("weight_id") / batch))  # weights are a parameter
    copies = edges.join(groups.select("unit", "batch").distinct(), "unit").select(F.col("unit").alias("u"), F.col("batch").alias("b"), "src", "dst", "l", "phi", "row", "col")

    def one(e: pa.Table, g: pa.Table) -> pa.Table:
        unit, out = _Unit(e, size) if e.num_rows else None, []
        for r in g.to_pylist():
            cost, way = unit.net.path(unit.l * (unit.phi @ np.asarray(check_weights(r["w"], unit.phi.shape[1]))), r["start"], r["goal"]) if unit else (float("inf"), np.zeros(0, np.int64))
            xy = unit.xy(way) if len(way) else np.zeros((0, 2))
            length = float(np.hypot(*np.diff(xy, axis=0).T).sum()) if len(xy) > 1 else 0.0
            out.append((r["unit"], r["weight_id"], cost, lines.mean_distance(xy, _points(r["observed"])), length, unit.net.nodes[way].tolist() if len(way) else []))
        names = [c.split()[0] for c in SWEPT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    pairs = groups.select(*[F.col(c).alias(f"_{c}") for c in groups.columns]).toDF(*groups.columns)  # both sides come from groups
    return copies.groupBy("u", "b").cogroup(pairs.groupBy("unit", "batch")).applyInArrow(one, SWEPT)


def null_paths(edges: DataFrame, ends: DataFrame, draws: int, exponent: float, weights: list[float], seed: int = 0, batch: int = 25, size: float = 1.0, epsilon: float = 0.01) -> DataFrame:
    """Paths over random terrain of the surface's spectrum: (unit, m, d, cost): the distance of draw m's path to the observed line, and what that
    path costs under the real weights; null without a path. An edge of a draw costs its length times the mean of the field at its
    ends. A draw's seed is (seed, unit, m), so a retried task draws the same."""
    groups = ends.select("unit", "start", "goal", "observed").crossJoin(F.broadcast(edges.sparkSession.range(draws).withColumnRenamed("id", "m"))).withColumn("batch", F.floor(F.col("m") / batch))  # draws is a parameter
    copies = edges.join(groups.select("unit", "batch").distinct(), "unit").select(F.col("unit").alias("u"), F.col("batch").alias("b"), "src", "dst", "l", "phi", "row", "col")

    def one(e: pa.Table, g: pa.Table) -> pa.Table:
        unit, out = _Unit(e, size) if e.num_rows else None, []
        for r in g.to_pylist():
            d = cost = None
            if unit:
                at = (unit.cell - unit.cell.min(axis=0)).astype(int)
                field = null_surface(at[:, 0].max() + 1, at[:, 1].max() + 1, exponent, [seed, int.from_bytes(r["unit"].encode()[:7], "big"), r["m"]], epsilon)[at[:, 0], at[:, 1]]
                ends_of = (field[unit.net.src] + field[unit.net.dst]) / 2
                drawn = np.empty(len(unit.l))
                drawn[unit.net.order] = unit.l[unit.net.order] * ends_of
                _, way = unit.net.path(drawn, r["start"], r["goal"])
                if len(way):
                    d = lines.mean_distance(unit.xy(way), _points(r["observed"]))
                    cost = along(unit.net, unit.l * (unit.phi @ np.asarray(weights)), way)
            out.append((r["unit"], r["m"], d, cost))
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["unit", "m", "d", "cost"])

    pairs = groups.select(*[F.col(c).alias(f"_{c}") for c in groups.columns]).toDF(*groups.columns)
    return copies.groupBy("u", "b").cogroup(pairs.groupBy("unit", "batch")).applyInArrow(one, "unit string, m long, d double, cost double")


def along(net: Network, cost: np.ndarray, way: np.ndarray) -> float:
    """Sum of the edges' costs along nodes by position; nan where a hop is no edge."""
    key = net.src * np.int64(len(net.nodes)) + net.dst
    order = np.argsort(key)
    hops = way[:-1] * np.int64(len(net.nodes)) + way[1:]
    at = np.minimum(np.searchsorted(key[order], hops), len(key) - 1)
    return float(cost[net.order][order[at]].sum()) if (key[order[at]] == hops).all() else float("nan")


# ---------------------------------------------------------------- units and bands


def around(nodes: DataFrame, vertices: DataFrame, radius: float) -> DataFrame:
    """(unit, node, d): the nodes (node, x, y) within radius of a vertex of each unit's line (unit, x, y), with the distance to the nearest. They
    meet by squares of the radius."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = vertices.select("unit", F.col("x").alias("vx"), F.col("y").alias("vy")).distinct().withColumn("o", F.explode(near))
    spread = spread.select("unit", "vx", "vy", (F.floor(F.col("vx") / radius) + F.col("o.i")).cast("long").alias("bx"), (F.floor(F.col("vy") / radius) + F.col("o.j")).cast("long").alias("by"))
    dx, dy = F.col("x") - F.col("vx"), F.col("y") - F.col("vy")
    keyed = nodes.select("node", "x", "y", F.floor(F.col("x") / radius).cast("long").alias("bx"), F.floor(F.col("y") / radius).cast("long").alias("by"))
    return keyed.join(spread, ["bx", "by"]).groupBy("unit", "node").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("d")).where(F.col("d") <= radius)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) that each unit's nodes (unit, node) have among themselves, with unit."""
    a, b = (members.select(F.col("unit").alias(f"u{x}"), F.col("node").alias(x)) for x in ("src", "dst"))
    return edges.join(a, "src").join(b.withColumnRenamed("udst", "unit"), "dst").where("usrc = unit").drop("usrc")


def nearest_node(members: DataFrame, nodes: DataFrame, places: DataFrame) -> DataFrame:
    """For places (unit, name, row, col) the node of their unit in the same cell, or the one fewest cells away, of equal ones the first: (unit, name,
    node)."""
    own = members.join(nodes.select("node", F.col("row").alias("r"), F.col("col").alias("c")).hint("merge"), "node")  # all nodes of the grid, which Spark would broadcast
    d2 = F.pow(F.col("r") - F.col("row"), 2) + F.pow(F.col("c") - F.col("col"), 2)
    return own.join(F.broadcast(places), "unit").groupBy("unit", "name").agg(F.min_by("node", F.struct(d2, "node")).alias("node"))  # two places a unit


def with_component(edges: DataFrame, k: int, values: DataFrame, key: list[str] | None = None) -> DataFrame:
    """edges with component k set to the mean of its ends' values (key, node, value)."""
    key = key or []
    a, b = (values.select(*key, F.col("node").alias(x), F.col("value").alias(f"v{x}")) for x in ("src", "dst"))
    joined = edges.join(a, [*key, "src"]).join(b, [*key, "dst"])
    mean = (F.col("vsrc") + F.col("vdst")) / 2
    return joined.withColumn("phi", F.transform("phi", lambda x, i: F.when(i == k, mean).otherwise(x))).drop("vsrc", "vdst").select(*edges.columns)


def units(nodes: DataFrame, edges: DataFrame, observed: DataFrame, radius: float, size: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each unit (unit, seq, x, y) is analysed with: its nodes, its edges, and ends (unit, start, goal, observed): the nodes nearest to the line's
    ends and places on the line at most a cell apart. nodes (node, row, col, x, y)."""
    members = around(nodes, observed, radius)
    marks = observed.groupBy("unit").agg(F.min_by(F.struct("x", "y"), "seq").alias("start"), F.max_by(F.struct("x", "y"), "seq").alias("goal"))
    cell = lambda c: F.floor(F.col(c) / size + 0.5).cast("long")  # noqa: E731  cells are centred on multiples of size
    ends = marks.select("unit", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("p")) for n in ("start", "goal")])).alias("e"))
    ends = ends.select("unit", F.col("e.name").alias("name"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y")).select("unit", "name", cell("y").alias("row"), cell("x").alias("col"))
    found = nearest_node(members, nodes, ends).groupBy("unit").agg(*[F.max(F.when(F.col("name") == n, F.col("node"))).alias(n) for n in ("start", "goal")])
    dense = lines.equidistant(observed, ["unit"], step=size).groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("observed"))
    return members, induced(edges, members), found.join(dense, "unit")


def band_costs(nodes: DataFrame, edges: DataFrame, observed: DataFrame, ends: DataFrame, weights: list[float], widths: list[int], size: float) -> DataFrame:
    """(unit, width, cost): the least cost between the unit's ends inside a band of so many cells on both sides of its line; null where the band
    doesn't connect them. The distance to the line is taken once, over places half a cell apart; a narrower band is a filter."""
    dense = lines.equidistant(observed, ["unit"], step=size / 2)
    near = around(nodes, dense, max(widths) * size)
    spread = near.withColumn("width", F.explode(F.array(*map(F.lit, widths)))).where(F.col("d") <= F.col("width") * size)
    named = spread.select(F.concat_ws("|", "unit", "width").alias("unit"), "node")
    places = ends.select("unit", "start", "goal").withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    # a band may lack the unit's own end nodes: the nearest of its nodes stand for them
    where = places.select(F.concat_ws("|", "unit", "width").alias("unit"), F.explode(F.array(F.struct(F.lit("start").alias("name"), F.col("start").alias("n")), F.struct(F.lit("goal").alias("name"), F.col("goal").alias("n")))).alias("e"))
    where = where.select("unit", F.col("e.name").alias("name"), F.col("e.n").alias("node")).join(nodes.select("node", "row", "col"), "node").select("unit", "name", "row", "col")
    own = nearest_node(named, nodes, where).groupBy("unit").agg(*[F.max(F.when(F.col("name") == n, F.col("node"))).alias(n) for n in ("start", "goal")])
    one = edges.sparkSession.createDataFrame([(0, [float(x) for x in weights])], "weight_id long, w array<double>")
    found = sweep(induced(edges, named), own, one, size=size).select(F.col("unit").alias("band"), F.when(F.col("cost") < float("inf"), F.col("cost")).alias("cost"))
    keys = places.select("unit", "width", F.concat_ws("|", "unit", "width").alias("band"))
    return keys.join(found, "band", "left").select("unit", "width", "cost")


def band_ratios(bands: DataFrame, optima: DataFrame) -> DataFrame:
    """(unit, optimum, ratio_<width>..., first_width, first_ratio, drop, steady): the cost of following the line over the free optimum (unit, cost), by
    width of the band; of the narrowest that connects; and by how much it falls from the narrowest to the widest: an excess that a
    wider band takes away (over a fifth) was winding of the line, not a detour."""
    rows = bands.join(optima.select("unit", F.col("cost").alias("optimum")), "unit").withColumn("ratio", F.when(F.col("optimum") > 0, F.col("cost") / F.col("optimum")))
    widths = sorted(r[0] for r in bands.select("width").distinct().collect())  # a parameter's values
    out = rows.groupBy("unit", "optimum").agg(
        *[F.max(F.when(F.col("width") == w, F.col("ratio"))).alias(f"ratio_{w}") for w in widths],
        F.min(F.when(F.col("ratio").isNotNull(), F.col("width"))).alias("first_width"), F.min_by("ratio", F.when(F.col("ratio").isNotNull(), F.col("width"))).alias("first_ratio"),
        F.max_by("ratio", F.when(F.col("ratio").isNotNull(), F.col("width"))).alias("last_ratio"), F.count("ratio").alias("n"),
    )
    drop = F.when((F.col("n") > 1) & (F.col("first_ratio") > 0), (F.col("first_ratio") - F.col("last_ratio")) / F.col("first_ratio"))
    return out.withColumn("drop", drop).withColumn("steady", F.col("drop") <= 0.2).drop("last_ratio", "n")


def parts_of(edges: DataFrame) -> DataFrame:
    """(unit, node, component): the parts into which each unit's graph falls, whichever way its edges run."""
    from .network import components

    named = edges.select("unit", "src", "dst")
    ids = named.select("unit", F.col("src").alias("node")).unionByName(named.select("unit", F.col("dst").alias("node"))).distinct()
    numbers = ids.select("unit").distinct().withColumn("no", F.row_number().over(Window.orderBy("unit")).cast("long"))  # a row a unit
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("node"))
    numbered = lines.cut_lineage(ids.join(F.broadcast(numbers), "unit").select("unit", "node", (F.col("no") * F.lit(1 << 40) + rank).alias("id")))
    a, b = (numbered.select("unit", F.col("node").alias(x), F.col("id").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
    found = components(named.join(a, ["unit", "src"]).join(b, ["unit", "dst"]).select("a", "b")).withColumnRenamed("node", "id")
    return numbered.join(found, "id").select("unit", "node", "component")


def touches_edge(path: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unit, touches): whether a cell of the unit's path (unit, node) has a neighbour that isn't one of the unit's nodes: then the width of
    the neighbourhood decides the path."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    beside = path.join(nodes.select("node", "row", "col"), "node").withColumn("o", F.explode(moves)).select("unit", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).distinct()
    inside = members.select("unit", "node").join(nodes.select("node", "row", "col"), "node").select("unit", "row", "col")
    out = beside.join(inside, ["unit", "row", "col"], "left_anti").groupBy("unit").agg(F.lit(True).alias("touches"))
    return path.select("unit").distinct().join(out, "unit", "left").fillna(False, ["touches"])


def cost_along(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of edge costs over (unit, seq, node); null where a hop is no edge, 0 with fewer than two nodes."""
    hop = path.withColumn("dst", F.lead("node").over(Window.partitionBy("unit").orderBy("seq")))
    # paths, edges and units grow with the grid, whatever Spark takes them for: none is broadcast
    priced = hop.where("dst is not null").join(edges.select("unit", F.col("src").alias("node"), "dst", "cost").hint("merge"), ["unit", "node", "dst"], "left")
    sums = priced.groupBy("unit").agg(F.when(F.count("*") == F.count("cost"), F.sum("cost")).alias("cost"), F.lit(True).alias("hops"))
    return path.select("unit").distinct().join(sums.hint("merge"), "unit", "left").select("unit", F.when(F.col("hops"), F.col("cost")).otherwise(0.0).alias("cost"))


# ---------------------------------------------------------------- weights


def lattice_size(k: int, n: int) -> int:
    """Number of weight vectors of k parts in n-ths."""
    import math

    return math.comb(n + k - 1, k - 1)


def lattice(spark, k: int, n: int) -> DataFrame:
    """All weight vectors of k parts in n-ths that sum to 1."""
    rows = spark.range(n + 1).select(F.array(F.col("id")).alias("m"), F.col("id").alias("s"))
    for _ in range(k - 2):
        rows = rows.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), n - F.col("s")))).select(F.concat("m", F.array("id")).alias("m"), (F.col("s") + F.col("id")).alias("s"))
    full = F.concat("m", F.array(n - F.col("s"))) if k > 1 else F.array(F.lit(n).cast("long"))
    rows = rows.select(full.alias("m")) if k > 1 else spark.range(1).select(full.alias("m"))
    return rows.select("m", F.transform("m", lambda x: x / F.lit(float(n))).alias("w"))


def model_weights(spark, names: list[str], own: list[str], n: int) -> DataFrame:
    """(weight_id, w): the lattice of a model's components, 0 for the others of names; numbered in the lattice's order."""
    at = [own.index(c) if c in own else None for c in names]
    rows = lattice(spark, len(own), n)
    full = F.array(*[F.col("w")[i] if i is not None else F.lit(0.0) for i in at])
    return rows.withColumn("weight_id", F.row_number().over(Window.orderBy("m")) - 1).select(F.col("weight_id").cast("long").alias("weight_id"), full.alias("w"))  # the lattice is a parameter's size


def optimum(swept: DataFrame) -> DataFrame:
    """Of (unit, weight_id, d, ...) each unit's row of the smallest finite d, of equal ones the first weights."""
    fine = swept.where("d is not null and not isnan(d) and d < double('infinity')")
    kept = [c for c in swept.columns if c != "unit"]
    best = fine.groupBy("unit").agg(F.min_by(F.struct(*kept), F.struct("d", "weight_id")).alias("b"))
    return best.select("unit", *[F.col(f"b.{c}").alias(c) for c in kept])


def near_optimal(costs: DataFrame, tau: float) -> DataFrame:
    """Weights whose d is within (1 + tau) of their unit's least."""
    least = F.min(F.when(F.col("d") < float("inf"), F.col("d"))).over(Window.partitionBy("unit"))
    return costs.withColumn("least", least).where(F.col("d") <= (1 + tau) * F.col("least")).drop("least")


def extension(near: DataFrame, weights: DataFrame) -> DataFrame:
    """(unit, component, low, high, centre): range and mean of each component's weight over a unit's near-optimal vectors."""
    parts = near.select("unit", "weight_id").join(F.broadcast(weights.select("weight_id", F.posexplode("w").alias("component", "v"))), "weight_id")  # weights are a parameter
    return parts.groupBy("unit", "component").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("centre"))


def jaccard_profile(costs: DataFrame, taus: list[float]) -> DataFrame:
    """Jaccard index of the near-optimal sets of each pair of units, by tau."""
    grid = F.explode(F.array(*map(F.lit, taus)))
    least = F.min(F.when(F.col("d") < float("inf"), F.col("d"))).over(Window.partitionBy("unit"))
    marks = costs.withColumn("least", least).withColumn("tau", grid).withColumn("inside", (F.col("d") <= (1 + F.col("tau")) * F.col("least")).cast("long"))
    a, b = (marks.select("weight_id", "tau", F.col("unit").alias(f"unit_{x}"), F.col("inside").alias(x)) for x in "ab")
    both = a.join(b, ["weight_id", "tau"]).where("unit_a < unit_b")
    return both.groupBy("unit_a", "unit_b", "tau").agg((F.sum(F.col("a") * F.col("b")) / F.nullif(F.sum(F.greatest("a", "b")), F.lit(0))).alias("jaccard"))


def empirical_p(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """(1 + nulls at most as large) / (nulls + 1) by unit."""
    fine = nulls.where("d is not null and not isnan(d) and d < double('infinity')").withColumnRenamed("d", "dm")
    counts = observed.join(fine, "unit", "left").groupBy("unit").agg(F.count("dm").alias("n"), F.count_if(F.col("dm") <= F.col("d")).alias("k"))
    return counts.select("unit", F.when(F.col("n") > 0, (1 + F.col("k")) / (F.col("n") + 1)).alias("p"))


def cost_null(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """(unit, ratio, p25, median, p75, p, n): a unit's cost ratio (unit, ratio) among those of random paths (unit, ratio)."""
    fine = nulls.where("ratio is not null and not isnan(ratio) and ratio < double('infinity')").withColumnRenamed("ratio", "r")
    rows = observed.where("ratio is not null and not isnan(ratio)").join(fine, "unit")
    return rows.groupBy("unit", "ratio").agg(*[F.percentile("r", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], ((F.count_if(F.col("r") <= F.col("ratio")) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("n"))


def blocked_validation(costs: DataFrame) -> DataFrame:
    """Of (unit, block, weight_id, d) the weight that is best on the mean of a unit's other blocks, and its d on the block held out:
    sums over all blocks less the own one, so nothing is joined."""
    others = Window.partitionBy("unit", "weight_id")
    n, total = F.count("d").over(others), F.sum("d").over(others)
    fit = costs.withColumn("fit", F.when(n > 1, (total - F.col("d")) / (n - 1))).where("fit is not null")
    best = fit.groupBy("unit", "block").agg(F.min_by(F.struct("weight_id", "fit", "d"), F.struct("fit", "weight_id")).alias("b"))
    return best.select("unit", "block", "b.weight_id", "b.fit", F.col("b.d").alias("held_out"))


def model_summary(held: DataFrame) -> DataFrame:
    """(model, median, mean, n) over the held-out blocks (model, unit, block, held_out)."""
    return held.groupBy("model").agg(F.percentile("held_out", F.lit(0.5)).alias("median"), F.avg("held_out").alias("mean"), F.count("*").alias("n"))


def paired_wins(held: DataFrame, plain: str = "reference", other: str = "extended") -> DataFrame:
    """(pairs, wins, evidence): the held-out blocks that both models have, in how many the other one is strictly nearer, and whether those
    are more than half: a model with more components fits its own data better in any case."""
    sides = held.groupBy("unit", "block").agg(*[F.max(F.when(F.col("model") == m, F.col("held_out"))).alias(n) for m, n in ((plain, "a"), (other, "b"))]).where("a is not null and b is not null")
    return sides.agg(F.count("*").alias("pairs"), F.count_if(F.col("b") < F.col("a")).alias("wins")).withColumn("evidence", 2 * F.col("wins") > F.col("pairs"))


def majority_agreement(sections: DataFrame, positions: int = 200) -> DataFrame:
    """(agreement, unstable): sections (cut, start, stop, dominant) of a line cut in different ways, start and stop as shares of it. At each of so
    many places, the share of the cuts that agree with the most frequent dominant one; their mean; unstable under 0.75."""
    spots = sections.sparkSession.range(positions).select((0.001 + F.col("id") * (0.998 / (positions - 1))).alias("at"), F.col("id").alias("spot"))
    votes = sections.join(F.broadcast(spots), (F.col("start") <= F.col("at")) & (F.col("at") < F.col("stop")))  # positions is a parameter
    counts = votes.groupBy("spot", "dominant").agg(F.count("*").alias("n")).groupBy("spot").agg((F.max("n") / F.sum("n")).alias("share"))
    return counts.agg(F.avg("share").alias("agreement")).withColumn("unstable", F.col("agreement") < 0.75)


# ---------------------------------------------------------------- curves


def self_proximity(vertices: DataFrame, least_arc: float = 1000.0, radius: float = 50.0, rounds: int = 24) -> DataFrame:
    """Per unit the least distance between vertices (unit, seq, x, y, s) that lie least_arc or more apart along the line; lines shorter than that
    are left out. Pairs meet by squares of a radius that grows for the units where none is found."""
    left = lines.cut_lineage(vertices.select("unit", F.col("seq").alias("pid"), "x", "y", "s").join(vertices.groupBy("unit").agg((F.max("s") - F.min("s")).alias("l")).where(F.col("l") >= least_arc).select("unit"), "unit", "left_semi"))
    out = None
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            break
        seg = left.select("unit", F.col("pid").alias("seq"), "x", "y", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("s").alias("os"))
        near = lines.near_segments(left, seg, ["unit"], radius).join(left.select("unit", "pid", "s"), ["unit", "pid"]).where(F.col("os") - F.col("s") >= least_arc)
        best = lines.cut_lineage(near.groupBy("unit").agg(F.sqrt(F.min("d2")).alias("distance_m")))
        out = best if out is None else out.unionByName(best)
        left = lines.cut_lineage(left.join(best.select("unit"), "unit", "left_anti"))
        radius *= 4
    return out if out is not None else vertices.limit(0).select("unit", F.lit(0.0).alias("distance_m"))


def symmetric_distance(a: DataFrame, b: DataFrame, radius: float = 100.0) -> DataFrame:
    """Mean over both directions of the distance to the other line's nearest vertex, by unit. Lines (unit, seq, x, y)."""

    def way(p: DataFrame, q: DataFrame) -> DataFrame:
        return lines.nearest_point(p.select("unit", F.col("seq").alias("pid"), "x", "y"), q, ["unit"], radius).groupBy("unit").agg(F.avg("d").alias("m"))

    return way(a, b).withColumnRenamed("m", "m1").join(way(b, a).withColumnRenamed("m", "m2"), "unit").select("unit", ((F.col("m1") + F.col("m2")) / 2).alias("distance_m"))


def straightness(length: Column, ends: Column) -> Column:
    """Length over the distance of the ends; infinite where they meet."""
    return F.when(ends > 0, length / ends).otherwise(float("inf"))
