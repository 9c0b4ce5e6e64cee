"""BPE encoding and decoding over a distinct-word table.

1. Every task splits its texts into the tokenizer's words and lists the distinct words of a block of texts once, by bucket of a word hash.
2. A bucket gathers the lists of all blocks; each distinct word of the corpus is encoded there, once, and every list is answered
   with the ids of its words.
3. The answers are joined by block to the positions (numbers in the block's sorted word list) of its documents' words, and each
   document's ids are put together; an id-to-piece table of the vocabulary's size turns them back into text.

What moves is one entry for each word and block, never one for each occurrence, so a frequent word makes no large group. The number of
buckets follows the characters of the input (bucket_chars each), so a bucket's share is bounded at every size.

Texts are split twice, for the words and for the positions, as words of all blocks on disk would be more than the texts. Both readings must make the same
blocks: an input that isn't a plain scan of files is written first, and a block's words are compared by a 64-bit digest where they meet.

Cases: null text is empty and has no ids; null and repeated doc_ids give a row each; an empty table gives no rows; other columns
are ignored; texts of any length are encoded whole."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_PATTERN, Codes, WordSplitter, byte_characters, columns_or, give_back, ragged, tidy, worker_cache, written


def splitter(path: str) -> WordSplitter:
    return worker_cache(("splitter", path), lambda: WordSplitter(path, BYTE_PATTERN, lower=False))


def _press(*arrays: np.ndarray) -> bytes:
    import zstandard

    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(a.tobytes() for a in arrays))


def _unpress(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * (1 + len(kinds)), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(kinds), 8).tolist(), kinds, strict=True):
        a = np.frombuffer(raw[at : at + size], kind)
        out.append(a)
        at += size
    return out


class _Block:
    """Documents whose words are numbered together."""

    def __init__(self, placed: bool):
        """placed: the words' positions count, not only the words."""
        self.placed, self.words = placed, set()
        self.codes, self.docs, self.lengths, self.at, self.chars = Codes(), [], [], [], 0

    def add(self, doc_id: int | None, words: list[str], chars: int) -> None:
        self.docs.append(doc_id)
        if not self.placed:
            self.words.update(words)
            self.chars += chars
            return
        self.lengths.append(len(words))
        self.at.append(np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words)))
        self.chars += chars

    def dictionary(self, buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Bucket of each word, words as bytes, and the order by bucket and word; it depends on the words alone."""
        raw = [w.encode("utf-8", "surrogatepass") for w in (self.codes.order if self.placed else self.words)]
        bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
        order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        return bucket, raw, order


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, chars: int, placed: bool) -> Iterator[tuple[int, _Block]]:
    split, block, n = splitter(tokenizer), _Block(placed), 0
    part = TaskContext.get().partitionId()
    for b in batches:
        for d, t in zip(b.column(0), b.column(1), strict=True):
            text = t.as_py() or ""
            block.add(d.as_py(), split.words(text), len(text))
            if block.chars >= chars:
                yield part << 32 | n, block
                block, n = _Block(placed), n + 1
    if block.docs:
        yield part << 32 | n, block


def _row(names: list[str], kinds: list[pa.DataType], *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _check(words: list[bytes]) -> int:
    """64 bits of the words in their order, none of which holds the byte between them."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b"\xff".join(words))).view(np.int64))


def fixed_order(df: DataFrame) -> DataFrame:
    """df if it is a projection or filter of a scan of files, whose rows come in the same order at every reading; else df written."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"[\s:+|-]*([A-Za-z]+)", line)[1] for line in plan.splitlines() if re.match(r"[\s:+|-]*[A-Za-z]", line)}
    return df if nodes <= {"Project", "Filter", "Relation"} else written(df, "texts")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 5_000_000, bucket_chars: int = 4_000_000, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256, decoded_sha256; keep_ids adds ids, keep_text the decoded text."""
    given = fixed_order(columns_or(docs, doc_id=id_col, text=text_col))
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-chars // bucket_chars))

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, tokenizer, block_chars, False):
            bucket, raw, order = block.dictionary(buckets)
            at = order.tolist()
            check, buckets_of = _check([raw[i] for i in at]), bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], buckets_of[1:] != buckets_of[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = [raw[i] for i in at[a:b]]
                words = _press(np.fromiter(map(len, own), "<u4", len(own)), np.frombuffer(b"".join(own), np.uint8))
                yield _row(["bucket", "block", "check", "words"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()], (int(buckets_of[a]), number, check, words))

    def encode_bucket(table: pa.Table) -> pa.Table:
        """The distinct-word table of a bucket, and its answers."""
        split, codes, asked = splitter(tokenizer), Codes(), []
        for words in table.column("words"):
            lengths, flat = _unpress(words.as_py(), "<u4", "u1")
            ends, raw = np.cumsum(lengths, dtype=np.int64), flat.tobytes()
            asked.append(np.fromiter((codes[raw[e - n : e]] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)), np.int64, len(lengths)))
        ids = []
        for i in range(0, len(codes.order), 20_000):
            ids += split.encode([w.decode("utf-8", "surrogatepass") for w in codes.order[i : i + 20_000]])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, starts = np.fromiter((x for i in ids for x in i), np.int32, int(lengths.sum())), np.cumsum(lengths) - lengths
        del codes, ids
        give_back()
        sizes = pa.array([lengths[at].astype(np.int32) for at in asked], pa.list_(pa.int32()))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "check": table.column("check"), "sizes": sizes, "ids": pa.array([ragged(flat, starts[at], lengths[at]) for at in asked], pa.list_(pa.int32()))})

    def list_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, tokenizer, block_chars, True):
            _, raw, order = block.dictionary(buckets)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            # frequent words get small numbers before zstandard sees them
            at = np.concatenate(block.at) if block.at else np.zeros(0, np.uint32)
            counts = np.bincount(at, minlength=len(order))
            common = np.argsort(-counts, kind="stable").astype(np.uint32)
            rank = np.empty(len(order), np.uint32)
            rank[common] = np.arange(len(order), dtype=np.uint32)
            ranked = rank[at]
            low, mid, high = (ranked & 255).astype(np.uint8), (ranked >> 8 & 255).astype(np.uint8), (ranked >> 16).astype("<u2")
            escaped = ranked >= 240
            payload = _press(
                np.array([d is not None for d in block.docs], np.uint8), np.array([d or 0 for d in block.docs], "<i8"), np.array(block.lengths, "<u4"), place[common].astype("<u4"),
                np.where(escaped, 255 - np.minimum(15, ranked >> 8).astype(np.uint8), low).astype(np.uint8), low[escaped], mid[escaped & (ranked >= 15 << 8)], high[escaped & (ranked >= 15 << 8)],
            )
            yield _row(["block", "check", "docs"], [pa.int64(), pa.int64(), pa.binary()], (number, _check([raw[i] for i in order.tolist()]), payload))

    pieces_kept = {}

    def pieces() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id-to-piece table: all pieces' bytes, and where each starts and how long it is."""
        if tokenizer not in pieces_kept:
            table = piece_bytes(splitter(tokenizer).tok)
            lengths = np.fromiter(map(len, table), np.int64, len(table))
            pieces_kept[tokenizer] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths
        return pieces_kept[tokenizer]

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_text

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("a block of words has no documents: its input changed between two reads")
        if any(x != left.column("check")[0].as_py() for x in right.column("check").to_pylist()):
            raise RuntimeError("a block's words changed between two reads of the input")
        # the replies, by bucket, stand in the order of the block's dictionary
        right = right.sort_by("bucket").combine_chunks()
        flat = right.column("ids").combine_chunks().flatten().to_numpy().astype(np.uint32) if right.num_rows else np.zeros(0, np.uint32)
        lengths = right.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
        known, doc_ids, sizes, place, first, low, mid, high = _unpress(left.column("docs")[0].as_py(), "u1", "<i8", "<u4", "<u4", "u1", "u1", "u1", "<u2")
        ranked = first.astype(np.uint32)
        escaped = np.flatnonzero(first >= 240)
        page = 255 - ranked[escaped]
        value = page << np.uint32(8) | low
        far = page == 15
        value[far] = high.astype(np.uint32) << 16 | mid.astype(np.uint32) << 8 | low[far]
        ranked[escaped] = value
        at = place[ranked]
        starts = np.cumsum(lengths) - lengths
        piece_flat, piece_starts, piece_lengths = pieces()
        ends, out = np.cumsum(sizes, dtype=np.int64), []
        for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            own = at[end - n : end]
            ids = ragged(flat, starts[own], lengths[own]).astype("<u4")
            decoded = ragged(piece_flat, piece_starts[ids], piece_lengths[ids]).tobytes().decode("utf-8", "replace")
            row = [int(doc_ids[k]) if known[k] else None, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
            out.append(row + [ids.astype(np.int32)] * keep_ids + [decoded] * keep_text)
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    answers = given.mapInArrow(tidy(list_words), "bucket int, block long, check long, words binary").groupBy("bucket").applyInArrow(encode_bucket, "block long, bucket int, check long, sizes array<int>, ids array<int>")
    placed = given.mapInArrow(tidy(list_docs), "block long, check long, docs binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_together, schema)


def piece_bytes(tok) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    byte_of = {c: b for b, c in byte_characters().items()}
    special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    size = max([*tok.get_vocab(True).values(), *special]) + 1
    out = []
    for i in range(size):
        piece = special.get(i) or tok.id_to_token(i) or ""
        out.append(piece.encode() if i in special or any(c not in byte_of for c in piece) else bytes(byte_of[c] for c in piece))
    return out
