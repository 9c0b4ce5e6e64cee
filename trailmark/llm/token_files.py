"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding.

File format. A token file is a folder, in any file system that Spark writes to, of two Parquet containers, written by Spark's own committer.
`ranks` has a row for each distinct id of the corpus: rank (0 for the most frequent; ties: smaller id first), id, n. `blocks` has one row a
block: shard, block (ascending, together in ascending doc_id order), start_in_shard, n_ids, payload. A payload is

    uint32 x 3   number of documents D, of ids N, of data bytes
    uint8  x D   1 where the doc_id isn't null
    int64  x D   doc_id
    uint32 x D   ids of the document
    ceil(N/4)    control bytes: two bits for each id, its rank's number of bytes less one
    data bytes   ranks, little endian, in so many bytes

all little endian. Readers look the lengths of four ranks up in a table by their control byte, and ids in the table of ranks.

Writing takes two steps: texts are encoded where they lie and their ids written to the shared folder with the number of the row, and with each
task's counts of ids, which together give the ranks; then the rows' ids, not the texts, are exchanged into ascending
order of (doc_id, number of the row), coded and written. The row's number parts rows of a null or repeated doc_id, so they don't meet in one task.

Cases: null text is empty and gives the end id alone; null doc_id comes first; equal doc_ids keep an arbitrary order among
themselves; an empty table gives an empty file and no rows; other columns are ignored."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, WordSplitter, byte_characters, columns_or, crc, discard, ragged, shared_dir, sliced, texts, tidy, worker_cache, written

SCHEMA = "shard int, block int, start_in_shard long, n_ids long, payload binary"
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1  # of the four ranks of a control byte


def ranking(counts: np.ndarray) -> np.ndarray:
    """Ids by rank, from the number of each id: most frequent first, of equal ones the smaller, without ids that don't occur."""
    used = np.flatnonzero(counts)
    return used[np.lexsort((used, -counts[used]))].astype(np.uint32)


def pack(ranks: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The payload of a block."""
    extra = (ranks >= 1 << 8).astype(np.uint8)
    if ranks.dtype.itemsize > 2:
        extra += (ranks >= 1 << 16).astype(np.uint8) + (ranks >= 1 << 24)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    if not len(ranks) or ranks.max() < 1 << 16:  # two bytes a rank at most
        pairs, keep = ranks.astype("<u2").view(np.uint8), np.ones(2 * len(ranks), bool)
        keep[1::2] = extra > 0
        data = pairs[keep]
    else:
        data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<3I", len(doc_ids), len(ranks), len(data))
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, and all ranks, from a block's payload."""
    docs, n, size = struct.unpack_from("<3I", payload)
    at = 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    known, doc_ids, lengths = take("u1", docs), take("<i8", docs), take("<u4", docs)
    control, data = take("u1", -(-n // 4)), take("u1", size)
    widths = _LENGTHS[control].ravel()[:n]
    starts = np.cumsum(widths, dtype=np.int64) - widths
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = padded[starts].astype(np.uint32)
    for k in range(1, int(widths.max(initial=1))):
        more = np.flatnonzero(widths > k)
        ranks[more] |= padded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [int(d) if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], lengths, ranks


def id_kind(tok) -> str:
    """The numbers that hold a tokenizer's ids."""
    return "<u2" if tok.get_vocab_size(True) <= 1 << 16 else "<u4"


class _Pieces(dict):
    """Pieces with their ids as bytes; one that is missing is looked for among the pieces before, or else made."""

    def __init__(self, before: dict, make: Callable[[str], bytes]):
        super().__init__()
        self.before, self.make = before, make

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        self[piece] = found = self.make(piece) if found is None else found
        return found


class _Encoder:
    """Texts to ids. White space always parts words, so the ids of what stands between it are the library's for it alone: each
    such piece goes through the library once while it's in the cache. The cache is two tables of at most about `bound` pieces: a full one
    becomes the older, whose pieces move on when they are met, and the older one goes. A piece of letters and one of
    ENDS is looked up without it, as a mark alone is a word of its own. Texts with special tokens or
    with characters beyond U+024F (or U+001C to U+001F, on which white space differs) go through the library whole."""

    ENDS = ".,;:!?"

    def __init__(self, path: str, bound: int = 250_000):
        self.split, self.bound = WordSplitter(path, WORD_PATTERN, lower=True), bound
        self.odd = re.compile("[^\x00-\x1b\x20-\u024f]").search
        self.bytes = byte_characters()
        self.kind = id_kind(self.split.tok)
        size = max([*self.split.tok.get_vocab(True).values(), *self.split.tok.get_added_tokens_decoder()]) + 1
        width, flat = np.dtype(self.kind).itemsize, np.arange(size).astype(self.kind).tobytes()
        self.single = [flat[i : i + width] for i in range(0, len(flat), width)]  # each id's bytes, which pieces of one id share
        self.tokenize = self.split.tok.model.tokenize
        self.ends = {c: self._word(c) for c in self.ENDS}
        self.pieces, self.step = _Pieces({}, self._piece), max(1, bound // 10)

    def _word(self, w: str) -> bytes:
        """A word's ids: in the vocabulary's byte characters, through the library's model."""
        single = self.single
        out = [single[t.id] for t in self.tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.bytes))]
        return out[0] if len(out) == 1 else b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """A piece's ids: those of its words; letters alone are one."""
        if piece.isalpha():
            return self._word(piece)
        return b"".join(map(self._word, self.split.find(piece)))

    def whole(self, text: str) -> bool:
        """Whether a text goes through the library whole."""
        if text.isascii():
            return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return "<|" in text or self.odd(text) is not None

    def _look(self, piece: str) -> bytes:
        """The ids of a piece that isn't of letters alone."""
        end = self.ends.get(piece[-1:])
        return self.pieces[piece[:-1]] + end if end is not None and piece[:-1].isalpha() else self.pieces[piece]

    def encode(self, given: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with `end` behind it, and where each text's begin; one number more, their total.
        Arrow numbers the pieces of all texts, so that each distinct one is looked up once."""
        width, whole = np.dtype(self.kind).itemsize, [i for i, t in enumerate(given) if self.whole(t)]
        odd = set(whole)
        split = pc.ascii_split_whitespace(pa.array(["" if i in odd else t.lower() for i, t in enumerate(given)], pa.string()))
        ends, numbered = split.offsets.to_numpy()[1:], split.flatten().dictionary_encode()
        known = numbered.dictionary
        # one string, cut at spaces, is faster than many from Arrow; a piece holds none
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), " ")[0].as_py().split(" ") if len(known) else []
        found: list[bytes] = []
        for i in range(0, len(words), self.step):
            if len(self.pieces) > self.bound:
                self.pieces.before = {}  # goes before the new table grows
                self.pieces = _Pieces(self.pieces, self._piece)
            letters, look = self.pieces.__getitem__, self._look
            found += [letters(w) if w.isalpha() else look(w) for w in words[i : i + self.step]]
        n = len(found)
        found += [np.array(self.split.tok.encode(given[i], add_special_tokens=False).ids, self.kind).tobytes() for i in whole]
        found.append(b"" if end is None else np.array([end], self.kind).tobytes())
        # behind a text's pieces stand the ids of one that the library took whole, and the end
        at, what = np.concatenate([ends[whole], ends]), np.concatenate([np.arange(n, n + len(whole)), np.full(len(given), len(found) - 1)])
        pieces = np.insert(numbered.indices.to_numpy().astype(np.int64), at, what)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        flat, lengths = np.frombuffer(b"".join(found), self.kind), sizes[pieces]
        last = ends + np.arange(1, len(given) + 1) + np.searchsorted(np.array(whole, np.int64), np.arange(len(given)), "right")
        starts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], last]).astype(np.int64)]
        return ragged(flat, (np.cumsum(sizes) - sizes)[pieces], lengths), starts

    def ids(self, text: str) -> np.ndarray:
        return self.encode([text])[0].astype(np.uint32)


def encoder(path: str) -> _Encoder:
    return worker_cache(("encoder", path), lambda: _Encoder(path))


def _encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(doc_id, row, ids) of every row of (doc_id, text): ids as bytes of two each where the vocabulary allows it, else four. Of each task one more row,
    under a number below zero, holds how often each id came: ids and counts, as bytes of eight each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        row, counts = part << 32, np.zeros(1, np.int64)
        for whole in batches:
            for b in sliced(whole, 1):
                ids, starts = enc.encode(texts(b.column(1)), end_id)
                own = np.bincount(ids, minlength=len(counts))
                own[: len(counts)] += counts
                counts = own
                coded = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((starts * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(row, row + b.num_rows)), coded], names=["doc_id", "row", "ids"])
                row += b.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1 - part], pa.int64()), pa.array([np.concatenate([used, counts[used]]).astype("<i8").tobytes()], pa.binary())], names=["doc_id", "row", "ids"])

    return docs.mapInArrow(tidy(run), "doc_id long, row long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id, and writes the ids in ascending order of id_col."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    rows = written(_encoded(columns_or(docs, doc_id=id_col, text=text_col), tokenizer, end_id), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column(0):
                used, n = np.frombuffer(own.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["id", "n"])

    counts = np.zeros(1, np.int64)
    for i, n in rows.where("row < 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # at most the vocabulary
        if i >= len(counts):
            counts = np.concatenate([counts, np.zeros(i + 1, np.int64)])
        counts[i] = n
    table = ranking(counts)
    spark.createDataFrame([(k, int(i), int(counts[i])) for k, i in enumerate(table.tolist())], "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(len(counts), "<u2" if len(table) <= 1 << 16 else np.uint32)
    rank_of[table] = np.arange(len(table))
    shared = spark.sparkContext.broadcast(rank_of)
    kind = id_kind(Tokenizer.from_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(("coder",), dict)  # the encoder goes from workers that have done with it
        shard = TaskContext.get().partitionId()
        block, start, size, width = 0, 0, 0, np.dtype(kind).itemsize
        raw, lengths, doc_ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, size
            payload = pack(shared.value[np.frombuffer(b"".join(raw), kind)], np.array(lengths, np.int64), doc_ids)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "block", "start_in_shard", "n_ids", "payload"])
            block, start, size = block + 1, start + size, 0
            for x in (raw, lengths, doc_ids):
                x.clear()
            return out

        for b in batches:
            for d, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw.append(own)
                lengths.append(len(own) // width)
                doc_ids.append(d)
                size += lengths[-1]
                if size >= block_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = rows.where("row >= 0").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    ordered.mapInArrow(tidy(run), SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(rows)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids the ids themselves."""
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")
    # one number a shard comes to the driver, as many as the writing tasks, and a table of the vocabulary's size
    totals = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect()}
    offsets, before = {}, 0
    for shard in sorted(totals):
        offsets[shard] = before
        before += totals[shard]
    ranks = spark.read.schema("rank int, id long, n long").parquet(f"{path}/ranks").select("rank", "id").collect()
    table = np.zeros(len(ranks), np.uint32)
    table[[r[0] for r in ranks]] = [r[1] for r in ranks]
    shared = spark.sparkContext.broadcast((offsets, table))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(("coder",), dict)
        offsets, table = shared.value
        for b in batches:
            for shard, first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                doc_ids, lengths, own = unpack(payload.as_py())
                ids = table[own]
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                sums = [crc(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(offsets[shard] + first + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.select("shard", "start_in_shard", "payload").mapInArrow(tidy(run), schema)


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the token files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/trailmark-tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
