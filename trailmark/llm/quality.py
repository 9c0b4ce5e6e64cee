"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base rules are fixed. Beyond them, each feature has a list of cutoffs from loose to tight. Labelled documents (quality 1 is good)
are the holdout: in a stratum, a cutoff is safe when the exact binomial bound says so, that is when k or fewer false rejections
among n good documents have a probability of at most delta' under a risk of alpha'. Cutoffs are tried in their order and the first
unsafe one ends the list (a fixed sequence needs no correction of its own); delta is shared over strata and features (Bonferroni)
and alpha over features, so that with probability 1 - delta no stratum's rules reject more than alpha of its good documents. A
stratum whose holdout is too small gets no rule. The bound takes the holdout as independent draws: of exact copies in a stratum one counts;
near copies should be dropped before (as the corpus pipeline does). Sums of the bound have at most TERMS terms at every size.

Words are the longest runs without the characters space and U+0009 to U+000D. Repeated words: words in some window of five that
occurs twice or more in the text; windows are compared by 64-bit hashes within one text.

Cases: null and empty texts have no words and fail the base rules; a null stratum is one of its own; documents without labels, and
labels without documents, only don't count, and repeated labels count once; an empty table gives no rows; null and repeated ids give a row
each; other columns are ignored; an array of a text's words is the largest thing held."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_or, small, written

#: Terms of a binomial sum that are added up; the others are bounded.
TERMS = 2_000

#: Cutoffs in percent, loose to tight. A document fails where 100 * part > cutoff * whole.
CUTOFFS = {
    "symbols": ("n_symbols", "word_chars", [60, 40, 30, 20, 15, 10, 8, 6, 5, 4]),
    "lines": ("n_dup_lines", "n_lines", [80, 60, 50, 40, 30, 25, 20]),
    "repeats": ("n_repeat_words", "n_words", [18, 15, 12, 10]),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five that occurs twice or more."""

    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-5).alias("end")), lambda acc, p: F.struct((acc["sum"] + F.lit(5) - F.greatest(F.lit(0), acc["end"] - p)).alias("sum"), (p + 5).alias("end")), lambda acc: acc["sum"])

    def repeated(sorted_: Column) -> Column:
        same = lambda i, j: F.get(sorted_, i)["h"] == F.get(sorted_, j)["h"]
        kept = F.filter(sorted_, lambda s, i: F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))))
        return covered(F.array_sort(F.transform(kept, lambda s: s["p"])))

    def of_windows(h: Column) -> Column:
        distinct = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(distinct, F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), repeated))

    def of_hashes(w: Column) -> Column:
        five = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return F.when(F.size(w) < 6, F.lit(0)).otherwise(let(five, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Counts of every text, without the texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    stratum = F.col(f"`{stratum_col}`").cast("string") if stratum_col else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), stratum.alias("stratum"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = rows.select("doc_id", "stratum", F.md5("text").alias("copy"), F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), counted.alias("c"), lined.alias("l"))
    return out.select("doc_id", "stratum", "copy", "c.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")


def _fails(part: str, whole: str, cutoff: Column) -> Column:
    return F.col(part) * 100 > cutoff * F.col(whole)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Logarithm of (x - 1)! for x >= 1: Stirling's series, after seven steps up."""
    y = x.cast("double") + 7
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    steps = F.lit(0.0)
    for i in range(7):
        steps = steps + F.log(x.cast("double") + i)
    return series - steps


def binomial_tail(k: Column, n: Column, risk: float, terms: int = TERMS) -> Column:
    """P(X <= k) of X ~ Binomial(n, risk), never less than it is: 1 where k isn't under the mean, else the sum of its largest terms, downward
    from k, each from the one above it, and for what lies below the last of `terms` the bound of a geometric series."""
    import math

    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
    ratio = lambda i: i * ((1 - risk) / risk) / (n - i + 1)  # noqa: E731  of the term of i - 1 to that of i
    start = F.struct(top.alias("term"), top.alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * ratio(i.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    last = F.greatest(F.lit(1.0), k - terms + 1)  # the lowest i that is stepped down from
    down = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.greatest(k, F.lit(1.0)).cast("long"), last.cast("long"), F.lit(-1).cast("long")))
    rest = lambda acc: F.when(last <= 1, F.lit(0.0)).otherwise(acc["term"] * ratio(last - 1) / (1 - ratio(last - 1)))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.aggregate(down, start, add, lambda acc: F.least(F.lit(1.0), acc["sum"] + rest(acc))))


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row a stratum of labelled documents: for each feature the tightest safe cutoff, or null."""
    good = columns_or(labels, doc_id=id_col, y=label_col).where("y = 1 and doc_id is not null").select("doc_id").distinct()
    found = rows.where(~base_failed()).join(good, "doc_id")
    # a text counts once in its stratum, however many copies of it are labelled
    held = found.groupBy("stratum", "copy").agg(*[F.first(c).alias(c) for c in sorted({x for part, whole, _ in CUTOFFS.values() for x in (part, whole)})])
    sums = [F.sum(_fails(part, whole, F.lit(c)).cast("long")).alias(f"{name}_{c}") for name, (part, whole, values) in CUTOFFS.items() for c in values]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    counts = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata"))))  # one row
    risk = alpha / len(CUTOFFS)
    level = F.lit(delta / len(CUTOFFS)) / F.col("strata")
    chosen = []
    for name, (_, _, values) in CUTOFFS.items():
        safe, best = F.lit(True), F.lit(None).cast("int")
        for c in values:  # a fixed sequence: it goes on as long as every looser cutoff is safe
            safe = safe & F.col(f"{name}_{c}_safe")
            best = F.when(safe, F.lit(c)).otherwise(best)
        chosen.append(best.alias(name))
    tested = counts.select("stratum", *[(binomial_tail(F.col(f"{name}_{c}"), F.col("n"), risk) <= level).alias(f"{name}_{c}_safe") for name, (_, _, values) in CUTOFFS.items() for c in values])
    return tested.select("stratum", *chosen)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Per document doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = written(features(docs, id_col, text_col, stratum_col), "features")
    found = written(cutoffs(rows, labels, alpha, delta, id_col), "cutoffs")
    judged = rows.join(small(found).withColumnRenamed("stratum", "own"), F.col("stratum").eqNullSafe(F.col("own")), "left")
    rejected = F.lit(False)
    for name, (part, whole, _) in CUTOFFS.items():
        rejected = rejected | F.coalesce(_fails(part, whole, F.col(name)), F.lit(False))
    judged = judged.withColumn("base_failed", base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def oracle(alpha: float = 0.03, delta: float = 0.05) -> str:
    """quality_rules over documents and labels, in DuckDB's SQL."""
    tests, best = [], []
    risk = alpha / len(CUTOFFS)
    for name, (part, whole, values) in CUTOFFS.items():
        chain = []
        for c in values:
            k = f"count(*) FILTER (100 * {part} > {c} * {whole})"
            tests.append(f"{k} AS {name}_{c}")
            tail = f"list_sum(list_transform(range({name}_{c} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}::DOUBLE) + (n - i) * ln(1 - {risk!r}::DOUBLE))))"
            chain.append(f"{tail} <= {delta / len(CUTOFFS)!r}::DOUBLE / strata")
        steps = " ".join(f"WHEN {' AND '.join(chain[: i + 1])} THEN {values[i]}" for i in reversed(range(len(values))))
        best.append(f"CASE {steps} END AS {name}")
    fails = " OR ".join(f"coalesce(100 * {part} > {name} * {whole}, false)" for name, (part, whole, _) in CUTOFFS.items())
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM texts),
windows AS (SELECT r, i, w[i:i + 4] AS five FROM words, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 6),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS o(k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM texts),
f AS (SELECT t.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(x)::BIGINT AS n_lines,
  (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, md5(text) AS copy
  FROM texts t JOIN words USING (r) JOIN lines USING (r) LEFT JOIN covered USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
counts AS (SELECT g.stratum, count(*) AS n, {', '.join(tests)} FROM (SELECT DISTINCT stratum, copy, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words FROM g WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) g GROUP BY g.stratum),
rules AS (SELECT stratum, {', '.join(best)} FROM counts, (SELECT count(*) AS strata FROM counts))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept
FROM g LEFT JOIN rules ON g.stratum IS NOT DISTINCT FROM rules.stratum"""
