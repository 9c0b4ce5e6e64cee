"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes (64 bits) of its distinct shingles of `width` words. Equal sets are one class with a number of its own; only
one row of it goes on. For a threshold num/den, a set of n tokens that has a partner shares at least ceil(num n / den) tokens with
it, so, in any order that all sets keep, the first n - ceil(num n / den) + k tokens of both share at least k. Here the order is
that of the hashes and k(n) = 2 + n // 30 (extended prefixes). Then

* tokens that few pairs of classes share are rare: they are indexed alone;
* the others are frequent: two sets that share no rare token of their prefixes share k frequent ones or more. Sets with fewer drop out.
  Ordered rarest first, the j-th token that two such sets share stands among the first f - k + j of each one's f frequent tokens. So a frequent
  token is indexed in combinations with a token behind it, and combinations that many pairs still share are extended by one more, as
  long as the prefixes guarantee so many shared tokens, where that makes fewer rows than the pairs that it replaces, at most GROWTH rows of one at first and
  no more rows later. Else its pairs are made, if they are at most MANY a row or no more than the rows would be; what then
  still has many is compared tile by tile, as the last resort: once for keys that much the same classes have, and without tiles of one component
  or of too different sizes.

Links found early make most pairs needless, since what is asked for is the components: each class is first held against the
class of the smallest id that shares most tokens with it, and later only pairs of different components are made. Pairs are verified on whole
texts: rows of a pair's first side stream past the other's set; a side that many pairs have is dealt over several tasks. Two filters come before. Counts:
shared prefix tokens, frequent ones taken as all shared, against the least overlap less what may lie beyond the prefixes. Sketches of 2,048
parity bits: they differ in no more bits than the sets in tokens.

Cases: null and empty texts have no tokens, n_shingles 0, and link with nothing; with fewer than width words the whole sequence is
the one token; rows with a null id keep a null component and link with nothing; rows of equal id are one node, whose links are those of all
its texts; an empty table gives no rows; other columns are ignored; texts of any length are read whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Codes, broadcast_rows, columns_or, discard, join_counted, small, tidy, worker_cache, written
from .components import connected_components

_P = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, width: int, bound: int = 150_000):
        self.width, self.bound = width, bound
        self.clear()

    def clear(self) -> None:
        self.codes, self.hashes = Codes(), np.zeros(1 << 12, np.uint64)

    def tokens(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.codes) > self.bound:
            self.clear()
        known = len(self.codes)
        at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        fresh = self.codes.order[known:]
        if fresh:
            if len(self.codes) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self.codes), np.uint64)])
            self.hashes[known : known + len(fresh)] = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
        h = self.hashes[at]
        many = min(self.width, len(h))
        s = np.full(len(h) - many + 1, np.uint64(many))
        for k in range(many):
            s = s * _P + h[k : len(h) - many + 1 + k]
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        return np.unique(s)


def shingler(width: int) -> Shingler:
    return worker_cache(("shingler", width), lambda: Shingler(width))


def extension(n):
    """Tokens that two extended prefixes must share, for a set of n (a number or a column)."""
    return F.lit(2) + F.floor(n / 30) if isinstance(n, Column) else 2 + n // 30


def prefix_length(n: int, num: int, den: int) -> int:
    """0 where no other set can reach the threshold: n / (n + 1) is under it."""
    return 0 if den * n < num * (n + 1) else min(n, n - -(-num * n // den) + extension(n))


SKETCH_BITS = 2048
#: Pairs for each row of a key that are made in any case, and rows that a token's combinations may make of one.
MANY, GROWTH = 16, 4


def sketch(tokens: np.ndarray) -> bytes:
    """A bit is set where an odd number of tokens falls on it, so two sketches differ in no more bits than their sets in tokens."""
    odd = np.bincount((tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def most_different(n, m, num: int, den: int):
    """Most tokens that are in one of two sets of n and m tokens at the threshold."""
    return (n + m) * (den - num) // (den + num)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _sets(given: DataFrame, width: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(width)
        for b in batches:
            sizes, digests, prefixes, sketches = [], [], [], []
            for t in b.column(1):
                tokens = own.tokens(t.as_py())
                sizes.append(len(tokens))
                digests.append(digest(tokens))
                prefixes.append(tokens[: prefix_length(len(tokens), num, den)].view(np.int64))
                sketches.append(sketch(tokens))
            halves = np.array(digests, np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, prefixes)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))), pa.array(sketches, pa.binary())], names=["doc_id", "n", "d1", "d2", "prefix", "sketch"])

    return given.mapInArrow(tidy(run), "doc_id long, n int, d1 long, d2 long, prefix array<long>, sketch binary")


def _similar(n: Column, m: Column, num: int, den: int) -> Column:
    return (F.least(n, m) * den >= F.greatest(n, m) * num)


def _heavy(pairs: DataFrame, side: str, most: int = 256) -> DataFrame | None:
    """(side, parts): classes that more than `most` pairs have on a side, and over how many parts their pairs are dealt; None without any."""
    found = written(pairs.groupBy(side).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1"), "heavy")
    return found if found.limit(1).count() else None


def _dealt(pairs: DataFrame, side: str, by: str, heavy: DataFrame | None) -> DataFrame:
    """pairs with part_<side>, so that no part of a class has many more than `most` pairs."""
    if heavy is None:
        return pairs.withColumn(f"part_{side}", F.lit(0))
    joined = pairs.join(small(heavy), side, "left")
    return joined.withColumn(f"part_{side}", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def _alike(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Of written pairs (a, b) of classes those whose sizes and sketches allow the threshold, with the ids and digests of their texts. No task
    gets all pairs of a class."""
    heavy = {side: _heavy(pairs, side) for side in "ab"}
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "needed")
    reps = reps.join(small(wanted), "c", "left_semi")
    for side, by in (("a", "b"), ("b", "a")):
        own = reps.select(F.col("c").alias(side), *[F.col(x).alias(f"{x}{side}") for x in ("rep", "n", "d1", "d2", "sketch")])
        pairs = _dealt(pairs, side, by, heavy[side])
        if heavy[side] is None:
            own = own.withColumn(f"part_{side}", F.lit(0))
        else:  # a class stands once for each of its parts
            own = own.join(small(heavy[side]), side, "left").withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        pairs = pairs.join(own, [side, f"part_{side}"])
    fields = ["a", "b", *[f"{x}{side}" for side in "ab" for x in ("rep", "d1", "d2")]]
    both = pairs.where(_similar(F.col("na"), F.col("nb"), num, den)).select(*fields, "na", "nb", "sketcha", "sketchb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sketcha", "sketchb")]
                differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1)
                ok = pa.array(differ <= most_different(b.column("na").to_numpy().astype(np.int64), b.column("nb").to_numpy(), num, den))
                yield b.select(fields).filter(ok)

    return both.mapInArrow(run, ", ".join(f"{x} long" for x in fields))


def verified(given: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those whose texts reach the threshold: a, b and their ids repa, repb. Where a class has many pairs, b
    is the side that has more of them."""
    wanted = written(pairs.select("a", "b"), "wanted")
    pairs = written(_alike(wanted, reps, num, den), "pairs")
    discard(wanted)
    many = _heavy(pairs.select(F.explode(F.array("a", "b")).alias("c")), "c")
    if many is not None:
        for side in "ab":
            pairs = pairs.join(small(many).withColumnsRenamed({"c": side, "parts": f"d_{side}"}), side, "left")
        swap = F.coalesce("d_a", F.lit(1)) > F.coalesce("d_b", F.lit(1))
        pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
        names = [("a", "b"), ("repa", "repb"), ("d1a", "d1b"), ("d2a", "d2b")]
        pairs = pairs.select(*[pick(x, y, x) for x, y in names], *[pick(y, x, y) for x, y in names])
    pairs = _dealt(pairs, "b", "a", _heavy(pairs, "b"))
    side = lambda x, order: [F.col(f"rep{x}").alias("doc_id"), F.col(x).alias("c"), F.col(f"d1{x}").alias("d1"), F.col(f"d2{x}").alias("d2"), "b", "repb", F.col("part_b").alias("part"), F.lit(order).alias("order")]
    sent = written(pairs.select(*side("a", 1)).unionByName(pairs.select(*side("b", 0)).distinct()), "sent")
    rows = given.where("doc_id is not null").join(small(sent), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, held = shingler(width), None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for doc_id, text, c, d1, d2, b, rep, part, order in zip(*(batch.column(i) for i in range(9)), strict=True):
                tokens = own.tokens(text.as_py())
                if digest(tokens) != (d1.as_py(), d2.as_py()):
                    continue  # another text of a repeated id
                if order.as_py() == 0:
                    key, held = (b.as_py(), part.as_py()), tokens
                elif key == (b.as_py(), part.as_py()):
                    both = len(tokens) + len(held)
                    shared = both - len(np.unique(np.concatenate([tokens, held])))
                    if den * shared >= num * (both - shared) and shared:
                        out.append((c.as_py(), key[0], doc_id.as_py(), rep.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["a", "b", "repa", "repb"])

    dealt = rows.select("doc_id", "text", "c", "d1", "d2", "b", "repb", "part", "order").repartition("b", "part").sortWithinPartitions("b", "part", "order")
    return dealt.mapInArrow(tidy(run), "a long, b long, repa long, repb long").distinct()


def _pairs_within(index: DataFrame, key: list[str], num: int, den: int) -> DataFrame:
    """Pairs of different components under each key (a < b), once for each key."""
    left = index.select(*key, F.col("c").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"), F.col("comp").alias("ca"))
    right = index.select(*key, F.col("c").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("comp").alias("cb"))
    return left.join(right, key).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _similar(F.col("na"), F.col("nb"), num, den))


def _crossing(index: DataFrame, key: list[str], *sums: Column) -> DataFrame:
    """Pairs of different components that each key would give, from counts alone; sums are aggregated along."""
    names = [f"s{i}" for i in range(len(sums))]
    by = index.groupBy(*key, "comp").agg(F.count("*").alias("c"), *[x.alias(n) for x, n in zip(sums, names, strict=True)])
    return by.groupBy(*key).agg(F.sum("c").alias("g"), ((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", 2))) / 2).alias("cross"), *[F.sum(n).alias(n) for n in names]).where("cross > 0")


def _merged(rows: DataFrame) -> DataFrame:
    """(key, c, n, comp): the classes of groups of keys, each once a group. rows: (key, g, c, n, comp), g classes a key.

    Keys that much the same classes have (tokens of one passage, of one text's near copies) would give the same pairs again and again. Each class
    is led by the largest of its keys, and a key goes to the group of the key that leads most of its classes. Where a group at one would make more pairs
    than its keys do, they stay apart."""
    led = rows.select(F.xxhash64("key").alias("key"), "g", "c", "n", "comp")  # keys of equal hash are compared together, which loses nothing
    led = written(led.withColumn("lead", F.max(F.struct("g", "key")).over(Window.partitionBy("c"))["key"]), "led")
    found = led.groupBy("key", "g", "lead").agg(F.count("*").alias("x")).groupBy("key", "g").agg(F.max_by("lead", F.struct("x", "lead")).alias("group"))
    found = written(found, "groups")
    # a class stands once a group from here on, and only groups that stay apart go back to the rows of their keys
    grouped = written(led.join(small(found.select("key", "group")), "key").select("group", "c", "n", "comp").distinct(), "grouped")
    together = grouped.groupBy("group").agg(F.count("*").alias("u"))
    apart = together.join(found.groupBy("group").agg(F.sum(F.pow("g", 2)).alias("own")), "group").where(F.pow("u", 2) > F.col("own"))
    apart = written(found.join(small(written(apart.select("group"), "apart")), "group").select("key", "group"), "apart-keys")
    whole = grouped.join(small(apart.select("group")), "group", "left_anti").withColumnRenamed("group", "key")
    alone = led.join(small(apart.select("key")), "key", "left_semi").select("key", "c", "n", "comp")
    merged = written(whole.unionByName(alone).distinct(), "merged")
    discard(led, grouped)
    return merged


def _placed(members: DataFrame, num: int, den: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """members (key, c, n, comp) with block and at, the tile of their key in which they stand, and the tiles that meet: (key, block, at) of each
    of both sides, with block_i, i, block_j, j for the pair and `right` for the side.

    Tiles follow the sizes of sets, so those of too different sizes don't meet; a component of more than a tile has a block of tiles of its own, which don't
    meet one another."""
    own = written(members.groupBy("key", "comp").agg(F.count("*").alias("m")).where(F.col("m") > tile).select("key", "comp", F.col("comp").alias("block")), "blocks")
    members = written(members.join(small(own), ["key", "comp"], "left").fillna(-1, ["block"]), "members")
    by = Window.partitionBy("key", "block")
    sizes = members.groupBy("key", "block", "n").agg(F.count("*").alias("m"))
    sizes = sizes.withColumns({"total": F.sum("m").over(by), "before": F.sum("m").over(by.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))}).fillna(0, ["before"])
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("c"), F.col("m"))) * F.ceil(F.col("total") / tile) / F.col("total"))
    placed = members.join(small(written(sizes, "sizes")), ["key", "block", "n"]).select("key", "c", "n", "comp", "block", place.alias("at"))
    placed = written(placed, "placed")
    tiles = written(placed.groupBy("key", "block", "at").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "tiles")
    left = tiles.select("key", F.col("block").alias("block_i"), F.col("at").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    right = tiles.select("key", F.col("block").alias("block_j"), F.col("at").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    meet = left.join(right, "key").where(F.struct("block_i", "i") <= F.struct(F.col("block_j").alias("block_i"), F.col("j").alias("i")))
    meet = meet.where("block_i <> block_j or block_i = -1").where((F.col("hi_i") * den >= F.col("lo_j") * num) & (F.col("hi_j") * den >= F.col("lo_i") * num))
    pair = ["key", "block_i", "i", "block_j", "j"]
    meet = written(meet.select(*pair), "meet")
    side = lambda x, rows: rows.select(*pair, F.col(f"block_{x}").alias("block"), F.col(x).alias("at"), F.lit(x == "j").alias("right"))
    return placed, written(side("i", meet).unionByName(side("j", meet.where("block_i <> block_j or i <> j"))), "sides")


def _tiles(rows: DataFrame, reps: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Pairs (a < b) of different components under keys with many members, by pairs of tiles of bounded size. In a pair of
    tiles the shared tokens of all prefixes are counted by a product of 0/1 matrices, and a pair goes on where the least overlap
    can be reached and the sketches don't differ too much."""
    placed, sides = _placed(_merged(rows), num, den, tile)
    # the narrow side goes to the prefixes where its count allows it
    placed = reps.select("c", "prefix", "sketch").join(small(placed), "c")
    dealt = placed.join(small(sides), ["key", "block", "at"]).select("key", "block_i", "i", "block_j", "j", "c", "n", "comp", "prefix", "sketch", "right")

    def run(table: pa.Table) -> pa.Table:
        rep, n, comp, right = (table.column(c).to_numpy() for c in ("c", "n", "comp", "right"))
        lists = table.column("prefix").combine_chunks()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(rep), -1)
        flat = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        starts = ends - lists.value_lengths().to_numpy()
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        if not len(other):  # a tile with itself
            other = left
        words, at = np.unique(flat, return_inverse=True)
        common = np.flatnonzero(np.bincount(at, minlength=len(words)) > 1)
        column = np.full(len(words), -1)
        column[common] = np.arange(len(common))
        owner, token = np.repeat(np.arange(len(rep)), ends - starts), column[at]
        owner, token = owner[token >= 0], token[token >= 0]
        out_a, out_b = [], []
        for k in range(0, len(left), 512):
            rows_ = left[k : k + 512]
            shared = np.zeros((len(rows_), len(other)), np.float32)
            for c in range(0, len(common), 2048):
                here = (token >= c) & (token < c + 2048)
                dense = np.zeros((len(rep), min(2048, len(common) - c)), np.float32)
                dense[owner[here], token[here] - c] = 1
                shared += dense[rows_] @ dense[other].T
            na, nb = n[rows_][:, None].astype(np.int64), n[other][None, :].astype(np.int64)
            x, y = np.nonzero((shared > 0) & (comp[rows_][:, None] != comp[other][None, :]) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num))
            x, y = rows_[x], other[y]
            once = rep[x] < rep[y] if other is left else np.ones(len(x), bool)
            x, y = x[once], y[once]
            c = shared[np.searchsorted(rows_, x), np.searchsorted(other, y)]
            need = -(-(n[x].astype(np.int64) + n[y]) * num // (num + den))
            ok = c >= need - np.maximum(n[x] - (ends - starts)[x], n[y] - (ends - starts)[y])
            x, y = x[ok], y[ok]
            ok = np.concatenate([np.zeros(0, bool), *[np.bitwise_count(bits[x[i : i + 65536]] ^ bits[y[i : i + 65536]]).sum(axis=1) <= most_different(n[x[i : i + 65536]].astype(np.int64), n[y[i : i + 65536]], num, den) for i in range(0, len(x), 65536)]])
            out_a.append(np.minimum(rep[x[ok]], rep[y[ok]]))
            out_b.append(np.maximum(rep[x[ok]], rep[y[ok]]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return dealt.groupBy("key", "block_i", "i", "block_j", "j").applyInArrow(run, "a long, b long")


def _combinations(frequent: DataFrame, reps: DataFrame, num: int, den: int, tile: int, deepest: int) -> list[DataFrame]:
    """Pairs (a, b) under combinations of frequent tokens. frequent: (t, c, n, comp, f, least, k), k numbering a class's f tokens, rarest
    first, and least how many of them a partner without rare tokens shares at the least."""
    out, apart = [], []
    level = frequent.where("k <= f - least + 1").select(F.array("t").alias("key"), "c", "n", "comp", "f", "least", "k")
    for j in range(1, deepest + 1):
        made = F.sum(F.least(F.col("f"), F.col("f") - F.col("least") + j + 1) - F.col("k"))
        stats = _crossing(level, ["key"], made, F.sum((F.col("least") <= j).cast("long")))
        longer = (F.col("s0") < F.col("cross")) & (F.col("s0") <= F.col("g") * (GROWTH if j == 1 else 1)) & (F.col("s1") == 0) & F.lit(j < deepest)
        few = F.col("cross") <= F.greatest(F.col("s0"), F.col("g") * MANY)
        stats = written(stats.select("key", "g", F.when(longer, "longer").when(few, "pairs").otherwise("tiles").alias("way")), f"ways{j}")
        level = written(level.join(small(stats), "key"), f"level{j}")
        ways = {r[0]: r[1] for r in stats.groupBy("way").count().collect()}  # three at most
        if "pairs" in ways:
            out.append(_pairs_within(level.where("way = 'pairs'"), ["key"], num, den).select("a", "b"))
        if "tiles" in ways:
            apart.append(level.where("way = 'tiles'").select("key", "g", "c", "n", "comp"))
        if "longer" not in ways:
            break
        behind = frequent.select("c", F.col("t").alias("u"), F.col("k").alias("ku"))
        level = level.where("way = 'longer'").join(behind, "c").where((F.col("ku") > F.col("k")) & (F.col("ku") <= F.col("f") - F.col("least") + j + 1))
        level = level.select(F.concat("key", F.array("u")).alias("key"), "c", "n", "comp", "f", "least", F.col("ku").alias("k"))
    if apart:
        out.append(_tiles(reduce(DataFrame.unionByName, apart), reps, num, den, tile))
    return out


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, rare_pairs: int = 200, tile: int = 2048, deepest: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_shingles, component_id: the smallest id that links of Jaccard >= num / den reach."""
    given = columns_or(docs, doc_id=id_col, text=text_col)
    sets = written(_sets(given, width, num, den), "sets")
    named = sets.where("n > 0 and doc_id is not null")
    # classes are numbered in order of their smallest ids; the writing fixes the numbers
    found = named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    classes = written(found.repartitionByRange("rep").sortWithinPartitions("rep", "n", "d1", "d2").withColumn("c", F.monotonically_increasing_id()), "classes")
    keys, many = ["n", "d1", "d2"], classes.count()
    joined = lambda rows: rows.join(F.broadcast(classes), keys) if many <= broadcast_rows(classes) else join_counted(rows, classes, keys, "m")
    reps = written(joined(named).where("doc_id = rep").drop("doc_id"), "reps")
    if reps.count() > many:  # rows that repeat an id and its text
        reps = written(reps.dropDuplicates(["c"]), "reps")
    members = written(joined(named.select("doc_id", *keys)).select("doc_id", "n", "c", "rep"), "members")
    # an id with several texts joins their classes
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    tied = members.join(small(written(several, "several")), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()

    index = reps.where(F.size("prefix") > 0).select("c", "n", F.explode("prefix").alias("t"))
    tokens = written(index.groupBy("t").agg(F.count("*").alias("g"), F.min("c").alias("lead")).where("g > 1"), "tokens")
    live = live_written = written(index.join(tokens, "t").select("t", "c", "n", "lead"), "live")

    # links to the class of the smallest id that shares most tokens
    shared = live.where("c <> lead").groupBy("c", "lead").agg(F.count("*").alias("k"))
    first = shared.groupBy("c").agg(F.max_by("lead", F.struct("k", "lead")).alias("lead"))
    links = written(verified(given, reps, first.select(F.col("c").alias("a"), F.col("lead").alias("b")), width, num, den), "links")
    edges = links.select(F.col("repa").alias("a"), F.col("repb").alias("b")).unionByName(tied)
    found = small(written(connected_components(edges), "comps"))
    comps = small(written(reps.select("c", "rep").join(found.withColumnRenamed("id", "rep"), "rep").select("c", "component"), "class-comps"))

    # the pairs of different components that are left: a component goes by its smallest class
    least = comps.groupBy("component").agg(F.min("c").alias("comp"))
    named_comps = small(written(comps.join(least, "component").select("c", "comp"), "named-comps"))
    live = live.drop("lead").join(named_comps, "c", "left").select("t", "c", "n", F.coalesce("comp", "c").alias("comp"))
    rows = written(live.join(_crossing(live, ["t"]), "t").withColumn("rare", F.col("cross") <= rare_pairs).drop("cross"), "rows")
    shared_least = extension(F.ceil(F.col("n") * num / den))  # of the smallest set that may be a partner
    order = Window.partitionBy("c").orderBy("g", "t")
    frequent = rows.where("not rare").withColumns({"k": F.row_number().over(order), "f": F.count("*").over(Window.partitionBy("c"))}).withColumn("least", shared_least)
    frequent = written(frequent.select("t", "c", "n", "comp", "f", "least", "k"), "frequent")
    counts = small(written(frequent.where("k = 1").select("c", "f"), "counts"))
    alone = _pairs_within(rows.where("rare").join(counts, "c", "left").fillna(0, ["f"]), ["t"], num, den)

    def need(n: str, m: str) -> Column:
        size = lambda x: F.col(x) - F.least(F.col(x), F.col(x) - F.ceil(F.col(x) * num / den) + extension(F.col(x)))
        return F.ceil((F.col(n) + F.col(m)) * num / (num + den)) - F.greatest(size(n), size(m)) - 1  # one less: rounding

    alone = alone.groupBy("a", "b").agg(F.count("*").alias("k"), *[F.first(x).alias(x) for x in ("na", "nb", "fa", "fb")])
    wanted = alone.where(F.col("k") + F.least("fa", "fb") >= need("na", "nb")).select("a", "b")
    for more in _combinations(frequent.where("f >= least"), reps, num, den, tile, deepest):
        wanted = wanted.unionByName(more)
    wanted = wanted.distinct().join(small(links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(verified(given, reps, wanted, width, num, den), "links")
    edges = edges.unionByName(more.select(F.col("repa").alias("a"), F.col("repb").alias("b")))
    comps = written(connected_components(edges), "comps")

    known = reps.select("c", "rep", "m").join(small(comps).withColumnRenamed("id", "rep"), "rep", "left")
    known = written(known.select("c", "m", F.coalesce("component", "rep").alias("component_id")), "known")
    fine = join_counted(members, known, ["c"], "m").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    other = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = written(fine.unionByName(other), "jaccard")
    discard(sets, classes, reps, members, tokens, live_written, rows, frequent, links, more, known)
    return out
