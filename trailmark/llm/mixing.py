"""Mixing sources to target weights, in DataFrame functions alone.

A source with share p of the tokens weighs p^a, normalised. The exponent a in [0, 1] is the largest that gives the target entropy,
raised where the smallest source would be repeated over max_epochs. Both are bisected to 2^-30: the limit needs two shares only, the
entropy takes ROUNDS passes of SECTIONS parts over the table of shares. The budget is given, or else the least at which every document is taken
once.

A source's budget is spent on a permutation of its documents by a keyed hash: whole epochs first, then the documents whose
running sum of tokens stays within the rest. The permutation is a tree of blocks (FAN superblocks of FAN blocks), so the place where
the rest ends is found from sums of blocks, then inside one superblock, then over the distinct ids of one block: no window ever holds more
than FAN rows or one block's ids, a hot source is only fuller blocks, and rows that repeat an id are summed before they meet.

What comes out of that is one row a source (`Plan.ends`), broadcast to the rows where its count allows and salted otherwise, so no row is
shuffled by its source or its id.

Cases: a null source is the source ''; null and empty texts have no tokens and are taken with each epoch they fall in; a source
without tokens keeps one copy of each row; null and repeated ids are rows like others (rows of one id and source are taken alike); an
empty table gives no rows; other columns are kept where copies are dealt out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, columns_or, written

SECTIONS, ROUNDS, FAN, SALTS = 1024, 3, 1024, 64


def permutation_key(seed: str, doc_id: Column) -> Column:
    """60 bits of md5 over seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def least_exponent(small: float, large: float, max_epochs: float) -> float:
    """The least exponent, in steps of 2^-30, at which the smallest share is repeated at most max_epochs times as often as the
    largest."""
    fine = lambda a: (small / large) ** (a - 1) <= max_epochs
    if fine(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(round(math.log2(SECTIONS**ROUNDS))):
        mid = (low + high) / 2
        low, high = (low, mid) if fine(mid) else (mid, high)
    return high


def exponent(totals: DataFrame, target: float, max_epochs: float) -> float:
    """totals: share of each source. The exponent for an entropy of target times the largest, within max_epochs."""
    size, smallest, largest = totals.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if not size:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        at = totals.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        x = F.col("a") * F.log("p")
        sums = at.groupBy("a").agg(F.sum(F.exp(x)).alias("z"), F.sum(F.exp(x) * x).alias("zx"))
        found = sums.where(F.log("z") - F.col("zx") / F.col("z") >= target * F.log(F.lit(float(size)))).agg(F.max("a")).first()[0]
        low, high = (low if found is None else found), min(1.0, (low if found is None else found) + grid[1] - grid[0])
    return max(low, least_exponent(smallest, largest, max_epochs))


class Plan:
    """Where the mixture's budget ends in each source. ends: source, epochs, c1, c2 (the block in which the rest ends), last (key and id of
    the last document taken there)."""

    def __init__(self, ends: DataFrame):
        self.ends, self.few = ends, ends.count() <= BROADCAST_ROWS

    def of(self, rows: DataFrame, source: Column, k: Column, doc_id: Column) -> DataFrame:
        """rows with __copies: how often the mixture takes each."""
        b1, b2 = blocks(k)
        own = self.ends.select(F.col("source").alias("__source"), F.struct("epochs", "c1", "c2", "last").alias("__end"))
        if self.few:
            joined = rows.join(F.broadcast(own), source == F.col("__source"), "left")
        else:  # a source's rows are dealt over salts
            own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = rows.join(own, (source == F.col("__source")) & (F.pmod(F.xxhash64(k, doc_id), F.lit(SALTS)).cast("int") == F.col("__salt")), "left")
        place, cut = F.struct(b1, b2), F.struct("__end.c1", "__end.c2")
        partly = F.when(place < cut, 1).when((place == cut) & (F.struct(k, doc_id) <= F.col("__end.last")), 1).otherwise(0)
        copies = F.when(F.col("__end").isNull(), F.lit(1).cast("long")).otherwise(F.col("__end.epochs") + F.coalesce(partly, F.lit(0))).cast("long")
        return joined.withColumn("__copies", copies).drop("__source", "__end", *([] if self.few else ["__salt"]))


def blocks(k: Column) -> tuple[Column, Column]:
    return F.shiftright(k, 50), F.shiftright(k, 40).bitwiseAND(F.lit(FAN - 1).cast("long"))


def counted(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, n_tokens, k), written."""
    given = columns_or(docs, doc_id=id_col, text=text_col, source=source_col)
    return written(given.select("doc_id", source_name(F.col("source")).alias("source"), word_count(F.col("text")).alias("n_tokens"), permutation_key(seed, F.col("doc_id")).alias("k")), "mix")


def mix(docs: DataFrame, target: float = 0.97, max_epochs: float = 4.0, budget: int | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row doc_id, source, n_tokens, block and copies: how often the mixture takes it. max_epochs binds the ratio of the most
    to the least repeated source; budget is the mixture's number of tokens."""
    rows = counted(docs, seed, id_col, text_col, source_col)
    out = plan(rows, target, max_epochs, budget).of(rows, F.col("source"), F.col("k"), F.col("doc_id"))
    return out.select("doc_id", "source", "n_tokens", F.shiftright("k", 40).alias("block"), F.col("__copies").alias("copies"))


def deal_out(docs: DataFrame, target: float = 0.97, max_epochs: float = 4.0, budget: int | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mixture takes it; columns and rows otherwise as they were."""
    chosen = plan(counted(docs, seed, id_col, text_col, source_col), target, max_epochs, budget)
    doc_id = F.col(f"`{id_col}`")
    rows = docs.withColumns({"__own": source_name(F.col(f"`{source_col}`")), "__k": permutation_key(seed, doc_id)})
    dealt = chosen.of(rows, F.col("__own"), F.col("__k"), doc_id).where("__copies > 0")
    return dealt.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def plan(rows: DataFrame, target: float, max_epochs: float, budget: int | None) -> Plan:
    """The plan for (doc_id, source, n_tokens, k)."""
    b1, b2 = blocks(F.col("k"))
    rows = rows.withColumns({"b1": b1, "b2": b2})
    sums = written(rows.groupBy("source", "b1", "b2").agg(F.sum("n_tokens").alias("t")), "blocks")
    total = sums.groupBy("source").agg(F.sum("t").alias("t")).where("t > 0")
    total = written(total.crossJoin(F.broadcast(total.agg(F.sum("t").alias("all")))).withColumn("p", F.col("t").cast("double") / F.col("all").cast("double")), "shares")  # one row
    a = exponent(total.select("p"), target, max_epochs)
    z = total.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.max("p").alias("large"), F.max("all").alias("all_"))
    spend = F.lit(float(budget)) if budget is not None else F.col("all_") * F.col("large") / (F.pow("large", F.lit(a)) / F.col("z"))
    shares = total.crossJoin(F.broadcast(z)).select("source", "t", F.floor(spend * F.pow("p", F.lit(a)) / F.col("z") + 1e-6).cast("long").alias("due"))
    shares = shares.select("source", F.floor(F.col("due") / F.col("t")).cast("long").alias("epochs"), (F.col("due") % F.col("t")).alias("rest"))

    # the superblock, then the block, in which the rest ends
    one = sums.groupBy("source", "b1").agg(F.sum("t").alias("t"))
    ends = _cut(one.join(shares, "source"), ["source"], "b1", "rest").select("source", "epochs", "b1", "left")
    two = sums.join(ends, ["source", "b1"])
    ends = written(_cut(two, ["source"], "b2", "left").select("source", "epochs", F.col("b1").alias("c1"), F.col("b2").alias("c2"), "left"), "ends")
    own = ends.select(F.col("source").alias("own"), "c1", "c2", "left")
    own = F.broadcast(own) if ends.count() <= BROADCAST_ROWS else own
    last = rows.join(own, (F.col("source") == F.col("own")) & (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))).groupBy("source", "k", "doc_id").agg(F.sum("n_tokens").alias("t"), F.max("left").alias("left"))
    inside = Window.partitionBy("source").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = last.withColumn("run", F.sum("t").over(inside)).where("run <= left").groupBy("source").agg(F.max(F.struct("k", "doc_id")).alias("last"))
    return Plan(written(ends.join(taken, "source", "left").select("source", "epochs", "c1", "c2", "last"), "plan"))


def _cut(sums: DataFrame, key: list[str], block: str, rest: str) -> DataFrame:
    """Of each source the block in which rest ends (the last, where it doesn't), with what is left of it there."""
    order = Window.partitionBy(*key).orderBy(block)
    run = sums.withColumn("before", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    found = run.where(F.col("before") <= F.col(rest)).withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(block)))).where("n = 1")
    return found.withColumn("left", F.col(rest) - F.col("before")).drop("n", "before", *({rest} - {"left"}))


def oracle(target: float = 0.97, max_epochs: float = 4.0, seed: str = "mix") -> str:
    """mix over documents at the least budget that takes every document, in DuckDB's SQL."""
    n = SECTIONS
    steps, last = ["e0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high)"], "e0"
    for r in range(1, ROUNDS + 1):
        steps.append(f"e{r} AS (SELECT coalesce(f, low) AS low, least(1.0::DOUBLE, coalesce(f, low) + (high - low) / {n}) AS high FROM (SELECT low, high, max(a) FILTER (ln(z) - zx / z >= {target!r}::DOUBLE * ln(size)) AS f FROM (SELECT low, high, a, size, sum(exp(a * ln(p))) AS z, sum(exp(a * ln(p)) * (a * ln(p))) AS zx FROM (SELECT low, high, low + (high - low) * i / {n} AS a FROM {last}, range({n + 1}) AS g(i)), shares, sizes GROUP BY ALL) GROUP BY ALL))")
        last = f"e{r}"
    parts = float(n**ROUNDS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens,
  ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM texts GROUP BY source HAVING sum(n_tokens) > 0),
shares AS (SELECT source, t, t::DOUBLE / (SELECT sum(t) FROM totals)::DOUBLE AS p FROM totals),
sizes AS (SELECT count(*)::DOUBLE AS size, min(p) AS small, max(p) AS large, sum(t)::DOUBLE AS total FROM shares),
{', '.join(steps)},
chosen AS (SELECT greatest({last}.low, CASE WHEN large / small <= {max_epochs!r}::DOUBLE THEN 0 ELSE ceil((1 - ln({max_epochs!r}::DOUBLE) / ln(large / small)) * {parts!r}::DOUBLE) / {parts!r}::DOUBLE END) AS a FROM {last}, sizes),
z AS (SELECT a, sum(pow(p, a)) AS z FROM shares, chosen GROUP BY a),
due AS (SELECT source, t, floor(total * large / (pow(large, a) / z) * pow(p, a) / z + 1e-6)::BIGINT AS due FROM shares, z, sizes),
run AS (SELECT texts.*, t, due, sum(n_tokens) OVER (PARTITION BY texts.source ORDER BY k, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM texts LEFT JOIN due USING (source))
SELECT doc_id, source, n_tokens, (k // {1 << 40})::BIGINT AS block, CASE WHEN t IS NULL THEN 1 ELSE due // t + CASE WHEN so_far <= due % t THEN 1 ELSE 0 END END::BIGINT AS copies FROM run"""
