"""Helpers that the corpus operators share: written tables, column passing, word splitting."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset a local master (tests) gets
    a new folder; on a cluster that is an error, as executors would not see one another's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="trailmark-"))
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trailmark-{name}-{uuid.uuid4().hex}"
    collect_on_driver(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trailmark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_trailmark_path", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows up to which a table whose rows were counted may be broadcast, and bytes that it may take as a hashed table: the driver builds
#: it, and holds it beside its rows as they came and its blocks as they are sent.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 96 << 20


def broadcast_rows(df: DataFrame) -> int:
    """Rows up to which df may be broadcast. A hashed table has its key, its length, a pointer and a place of its own for each row, some 96 bytes."""
    return min(BROADCAST_ROWS, BROADCAST_BYTES // (96 + df._jdf.schema().defaultSize()))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast where its counted rows are at most `most` and broadcast_rows; df should be a written table."""
    return F.broadcast(df) if df.count() <= min(most, broadcast_rows(df)) else df


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", hot: int = 10_000) -> DataFrame:
    """left joined with right, a written table of one row a key whose column `count` has the key's rows in left. Keys of more than
    `hot` rows, of which there are few, are broadcast, so that no task gets all rows of one; the others are shuffled."""
    heavy = right.where(F.col(count) > hot)
    n = heavy.count()
    if not n or n > BROADCAST_ROWS:
        return left.join(right, keys, how)
    names = F.broadcast(heavy.select(*keys))
    return left.join(F.broadcast(heavy), keys).unionByName(left.join(names, keys, "left_anti").join(right.where(F.col(count) <= hot), keys, how))


def columns_or(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names; what else df carries can't clash."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in wanted.items()])


def append_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, str]], make: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """df with new columns that a Python function gives for each Arrow batch.

    make() runs once a task and returns f(*arrays) -> list of arrays. Columns of df that carry a new column's name are replaced."""
    bounded_batches(df.sparkSession)
    new = {n for n, _ in fields}
    kept = [c for c in df.columns if c not in new]
    pruned = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(inputs)])
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` {t}" for n, t in fields])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for b in sliced(whole, n_kept):
                out = f(*[b.column(n_kept + i) for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_kept)] + out, names=kept + [n for n, _ in fields])

    return pruned.mapInArrow(tidy(run), schema)


def sliced(batch: pa.RecordBatch, column: int = 0, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about most bytes in the column, so that a batch of very long texts takes bounded memory."""
    if batch.num_rows == 0:
        return
    size = batch.column(column).nbytes / batch.num_rows
    step = max(1, int(most / max(size, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


BATCH_BYTES = 8 << 20
_LIVE: dict[tuple, object] = {}


def worker_cache(name: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time, so that operators that follow one another in the same worker
    don't add up."""
    if name not in _LIVE:
        _LIVE.clear()
        gc.collect()
        give_back()
        _LIVE[name] = make()
    return _LIVE[name]


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back_heap(spark: SparkSession) -> None:
    """Executors collect their garbage, after which a JVM gives heap back that it no longer needs: a task for each core, each of which
    asks its JVM once. For the time between steps, where little is live; it changes no result, and an executor that gets no task stays as it is."""
    collect_on_driver(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def collect_on_driver(spark: SparkSession) -> None:
    """The driver collects its garbage where its heap has grown beyond half of what it may take: tables that were broadcast for steps that are
    over go, and the JVM gives heap back that it no longer needs. It changes no result."""
    own = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * own.totalMemory() > own.maxMemory():
        spark._jvm.java.lang.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; a task's end gives memory back, as its worker lives on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by BATCH_BYTES where the session has the default bound, so very long texts take bounded memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def id_crc(column: Column, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo mod."""
    return F.pmod(F.crc32(column.cast("string")), F.lit(mod))


class WordSplitter:
    """A library tokenizer's words: pieces of text that it encodes independently of their surroundings.

    pattern must split texts of characters below U+0250 just as the tokenizer's own pre-tokenizer does (tests compare all of
    them); other texts go through the library's own normalizer and pre-tokenizer. Special tokens are cut out first, as the
    library does it."""

    def __init__(self, path: str, pattern: str, lower: bool):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.find = regex.compile(pattern).findall
        self.odd = re.compile("[^\x00-ɏ]").search
        self.lower = lower

    def _plain(self, text: str) -> list[str]:
        if self.odd(text) is None:
            return self.find(text.lower() if self.lower else text)
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        at, out = self.tok.pre_tokenizer.pre_tokenize_str(text), []
        for _, (a, b) in at:
            out.append(text[a:b])
        return out

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._plain(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte. Fixed rule: printable Latin-1 stands for itself, the other
    bytes, in order, for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}


BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Codes(dict):
    """Numbers words as they come; a new word is remembered in order."""

    def __init__(self):
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self.order)
        self.order.append(word)
        return i


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], flat[starts[1]: ...] and so on, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(total, dtype=at.dtype)
    return flat[at]


def texts(column: pa.Array) -> list[str]:
    """A batch's texts; null is empty."""
    return [t or "" for t in column.to_pylist()]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
