"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, that scores all overlapping windows.

Inputs of a word: log odds, in toxic against other training documents, of the word, of its prefixes and of its character 4-grams (of UTF-8
bytes; document counts, smoothed; what fewer than two documents have is unknown), and two learned vectors: one of the word (by hash) and one of its
characters, the mean over hashed 3-grams. Two gated recurrent layers, one each way, read a window of WINDOW words; attention pools their states into a
window's logit. Windows start every STRIDE words and reach over the whole text; a document's score is a logistic function of its largest
window logit, the mean of its three largest, and the logarithm of their number.

Training: a document's own count is taken out of the odds that it is trained with, so that they tell as much as on new documents. Documents
carry the labels, windows don't, so each toxic training document gives its windows with the largest evidence as positive ones, and the others
their most suspicious and some further windows as negative ones; in the later rounds the network itself picks them. What comes to
the driver is bounded by parameters: sample_docs documents a class, of at most most_chars characters each (longer ones aren't drawn; they are
scored whole like all others).

Cases: null and empty texts are one window without words and get its score; without both classes in training every score is 0;
null ids and repeated rows are scored each; of the texts of a repeated id one is learned; an empty table gives no rows; columns that carry an
output's name are replaced."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, columns_or, id_crc, ragged, worker_cache

WINDOW, STRIDE, HIDDEN, CHAR_DIM, WORD_DIM, BUCKETS, WORD_BUCKETS = 32, 16, 8, 4, 4, 1024, 4096
FIXED = 6  # inputs of a word that aren't learned vectors
PREFIXES = range(4, 11)  # bytes
KEEP, DECAY = 0.3, 0.05
_STRIP = ".,;:!?\"'()[]{}|*#-_%&$<>+=~^/"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _clean(word: str) -> str:
    return word.strip(_STRIP)


def _grams(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the cleaned words' bytes, between marks, as one number each, word after word, and how many each word has (one
    at least)."""
    raw = [b"<" + w + b">_" for w in raw]
    flat = np.frombuffer(b"".join(raw) + b"____", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    keys = np.zeros(len(flat) - 4, np.uint32)
    for k in range(n):
        keys = keys << np.uint32(8) | flat[k : k + len(keys)]
    many = np.maximum(sizes - n, 1)
    return ragged(keys, np.cumsum(sizes) - sizes, many), many


def _prefixes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, lengths) hashes of the words' prefixes, and which the words have."""
    most = PREFIXES[-1]
    sizes = np.minimum(np.fromiter(map(len, raw), np.int64, len(raw)), most)
    flat = np.frombuffer(b"".join(w[:most].ljust(most, b"\0") for w in raw), np.uint8).reshape(-1, most).astype(np.uint64)
    h, out = np.full(len(raw), 7, np.uint64), []
    for k in range(most):
        h = (h ^ flat[:, k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        if k + 1 in PREFIXES:
            out.append(h)
    return np.stack(out, axis=1), sizes[:, None] >= np.array(PREFIXES)


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _word_buckets(raw: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in raw), np.uint32, len(raw)) % np.uint32(WORD_BUCKETS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Odds:
    """Items, sorted, with the documents of both classes that have them."""

    items: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    n_toxic: int
    n_other: int

    def of(self, keys: np.ndarray, held: int | None = None) -> np.ndarray:
        """Log odds of keys, 0 for unknown ones; held: the class of the document at hand, which all keys are in and which doesn't count."""
        at = np.minimum(np.searchsorted(self.items, keys), len(self.items) - 1)
        known = self.items[at] == keys
        t, o = np.maximum(self.toxic[at] - (held == 1), 0), np.maximum(self.other[at] - (held == 0), 0)
        v = np.log((t + 0.5) / (self.n_toxic + 1 - (held == 1))) - np.log((o + 0.5) / (self.n_other + 1 - (held == 0)))
        return np.where(known & (t + o >= 2) & (np.abs(v) >= 0.5), np.clip(v, -4, 4), 0).astype(np.float32)

    @staticmethod
    def count(toxic: list[np.ndarray], other: list[np.ndarray]) -> Odds:
        """Each array holds the distinct items of a document. Items of one document are left out."""
        t, o = (np.concatenate([np.zeros(0, np.uint64), *rows]) for rows in (toxic, other))
        items, at = np.unique(np.concatenate([t, o]), return_inverse=True)
        a, b = np.bincount(at[: len(t)], minlength=len(items)), np.bincount(at[len(t) :], minlength=len(items))
        keep = a + b >= 2
        keep[:1] |= not keep.any()  # never empty
        return Odds(items[keep], a[keep].astype(np.float32), b[keep].astype(np.float32), len(toxic), len(other))


def _keys(raw: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) | len(w) << 32 for w in raw), np.uint64, len(raw))


@dataclass
class ToxicityModel:
    words: Odds | None = None
    grams: Odds | None = None
    prefixes: Odds | None = None
    p: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0, -50.0)

    def inputs(self, words: list[str], held: int | None = None) -> np.ndarray:
        """The fixed inputs of each word."""
        raw = [_clean(w).encode("utf-8", "replace") for w in words]
        own = self.words.of(_keys(raw), held)
        keys, many = _grams(raw, 4)
        odds, starts = self.grams.of(keys.astype(np.uint64), held), np.cumsum(many) - many
        keys, has = _prefixes(raw)
        prefix = np.where(has, self.prefixes.of(keys.ravel(), held).reshape(keys.shape), 0)
        best = np.take_along_axis(prefix, np.abs(prefix).argmax(axis=1)[:, None], axis=1)[:, 0]
        return np.column_stack([own, np.maximum.reduceat(odds, starts), np.add.reduceat(odds, starts) / many, prefix.max(axis=1), best, own != 0]).astype(np.float32)


class Spelling:
    """Where the learned vectors of words are: buckets of their 3-grams, and of the words."""

    def __init__(self, words: list[str]):
        raw = [_clean(w).encode("utf-8", "replace") for w in words]
        keys, self.many = _grams(raw, 3)
        self.flat, self.starts, self.word = _buckets(keys), np.cumsum(self.many) - self.many, _word_buckets(raw)

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        chars = np.add.reduceat(p["chars"][self.flat], self.starts, axis=0) / self.many[:, None]
        return np.concatenate([chars.astype(np.float32), p["words"][self.word]], axis=1)


def windows_of(n: int) -> list[tuple[int, int]]:
    """Start and length of each window over n words."""
    return [(i, min(WINDOW, n - i)) for i in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)] if n else [(0, 0)]


class _Net:
    """Forward and backward passes over a batch of windows; x is (T, B, D), mask (T, B). Both directions run side by side, the
    second one over reversed windows."""

    def __init__(self, d: int, seed: int):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
        h = HIDDEN
        small = lambda *s: (0.1 * r.standard_normal(s)).astype(np.float32)
        self.p = {"chars": small(BUCKETS, CHAR_DIM), "words": small(WORD_BUCKETS, WORD_DIM), "out": w(2 * h), "bias": np.zeros(1, np.float32), "att": w(2 * h, h), "pick": w(h), "x": w(2, d, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "h": w(2, h, 3 * h)}

    def forward(self, x: np.ndarray, mask: np.ndarray):
        p, h, (steps, n) = self.p, HIDDEN, mask.shape
        kind = p["h"].dtype
        both, masks = np.stack([x, x[::-1]]), np.stack([mask, mask[::-1]])[..., None]
        px = (both.reshape(2, steps * n, -1) @ p["x"] + p["b"]).reshape(2, steps, n, 3 * h)
        states, trail, now = np.zeros((2, steps, n, h), kind), [], np.zeros((2, n, h), kind)
        for t in range(steps):
            u = now @ p["h"]
            zr = _sigmoid(px[:, t, :, : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(px[:, t, :, 2 * h :] + r * u[..., 2 * h :])
            m = masks[:, t]
            new = now + m * (1 - z) * (c - now)
            trail.append((now, z, r, c, u[..., 2 * h :], m))
            states[:, t] = now = new
        joined = np.concatenate([states[0], states[1, ::-1]], axis=2)
        a = np.tanh(joined @ p["att"])
        e = a @ p["pick"] - 1e9 * (1 - mask)
        e = np.exp(e - e.max(axis=0)) * np.maximum(mask, 1e-9)
        w = e / e.sum(axis=0)
        pooled = (w[..., None] * joined).sum(axis=0)
        return pooled @ p["out"] + p["bias"][0], (both, joined, trail, a, w, pooled, mask)

    def backward(self, d: np.ndarray, saved) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of x."""
        p, h = self.p, HIDDEN
        both, joined, trail, a, w, pooled, mask = saved
        steps, n = mask.shape
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        dw = (joined * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0)) * mask
        da = de[..., None] * p["pick"] * (1 - a * a)
        g["pick"] = (de[..., None] * a).sum(axis=(0, 1))
        g["att"] = joined.reshape(-1, 2 * h).T @ da.reshape(-1, h)
        dj = w[..., None] * dp + da @ p["att"].T
        ds = np.stack([dj[..., :h], dj[::-1, :, h:]])
        gates, carry, gh = np.zeros((2, steps, n, 3 * h), p["h"].dtype), np.zeros((2, n, h), p["h"].dtype), np.zeros_like(p["h"])
        back = p["h"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, uc, m = trail[t]
            dn = carry + ds[:, t]
            inner = dn * m
            dc = inner * (1 - z) * (1 - c * c)
            dz = inner * (before - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            gates[:, t, :, :h], gates[:, t, :, h : 2 * h], gates[:, t, :, 2 * h :] = dz, dr, dc
            du = np.concatenate([dz, dr, dc * r], axis=2)
            gh += before.transpose(0, 2, 1) @ du
            carry = inner * z + dn * (1 - m) + du @ back
        flat = gates.reshape(2, steps * n, 3 * h)
        g |= {"h": gh, "x": both.reshape(2, steps * n, -1).transpose(0, 2, 1) @ flat, "b": flat.sum(axis=1, keepdims=True)}
        dx = (flat @ p["x"].transpose(0, 2, 1)).reshape(2, steps, n, -1)
        return g, dx[0] + dx[1, ::-1]


def _without_copies(texts: list[str], labels: list[int], hashes: int = 4) -> tuple[list[str], list[int]]:
    """Texts no two of which share one of a few smallest hashes of five words."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in zip(texts, labels, strict=True):
        words = words_of(text)
        keys = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
        five = sum((keys[k : max(0, len(keys) - 4) + k] * np.uint64(31**k) for k in range(5)), np.zeros(max(0, len(keys) - 4), np.uint64))
        mixed = [(five * np.uint64(2 * i + 0x9E3779B97F4A7C15)) ^ ((five + np.uint64(i)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) for i in range(hashes)]
        marks = {(i, int(m.min())) for i, m in enumerate(mixed)} if len(five) else {(-1, zlib.crc32(text.lower().encode("utf-8", "replace")))}
        if not marks & seen:
            out.append((text, label))
        seen |= marks
    return [t for t, _ in out], [v for _, v in out]


def train(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 7, rounds: int = 4, steps: int = 400, batch: int = 256) -> ToxicityModel:
    """The model, from whole labelled texts in memory; prior: the share of toxic documents that the sample was drawn from. Of
    copies in the sample one counts, else their words would look telling."""
    texts, labels = _without_copies(texts, labels)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return ToxicityModel()
    rng = np.random.default_rng(seed)
    codes: dict[str, int] = {"": 0}
    docs = [np.fromiter((codes.setdefault(w, len(codes)) for w in words_of(t)), np.int64) for t in texts]
    vocabulary = list(codes)
    raw = [_clean(w).encode("utf-8", "replace") for w in vocabulary]
    keys, many = _grams(raw, 4)
    starts, (prefixes, has), own = np.cumsum(many) - many, _prefixes(raw), _keys(raw)
    unique = [np.unique(d) for d in docs]
    count = lambda items: Odds.count([items(u) for u, v in zip(unique, labels, strict=True) if v], [items(u) for u, v in zip(unique, labels, strict=True) if not v])
    model = ToxicityModel(count(lambda u: np.unique(own[u])), count(lambda u: np.unique(ragged(keys, starts[u], many[u])).astype(np.uint64)), count(lambda u: np.unique(prefixes[u][has[u]])))
    fixed = np.stack([model.inputs(vocabulary, k) for k in (0, 1)])
    fixed[:, 0] = 0
    spelling = Spelling(vocabulary)
    net = _Net(FIXED + CHAR_DIM + WORD_DIM, seed)
    spans = [windows_of(len(x)) for x in docs]
    first = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    grid, kind = np.zeros((first[-1], WINDOW), np.int64), np.repeat(y, np.diff(first))
    for d, (x, s) in enumerate(zip(docs, spans, strict=True)):
        for k, (a, n) in enumerate(s):
            grid[first[d] + k, :n] = x[a : a + n]
    top = fixed[:, :, [0, 1, 3]].max(axis=2)
    evidence = np.sort(top[kind[:, None], grid], axis=1)[:, -3:] @ np.array([0.1, 0.3, 1.0])

    def inputs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        idx = grid[at].T
        used, place = np.unique(idx, return_inverse=True)
        part = Spelling([vocabulary[i] for i in used.tolist()]) if len(used) < len(vocabulary) // 4 else None
        vectors = part.vectors(net.p) if part else spelling.vectors(net.p)[used]
        return np.concatenate([fixed[kind[at], idx], vectors[place.reshape(idx.shape)]], axis=2), (idx > 0).astype(np.float32)

    def chosen(score: np.ndarray, toxic: int, other: int) -> list[np.ndarray]:
        out = []
        for d in range(len(docs)):
            a, b = first[d], first[d + 1]
            out.append(a + np.argsort(-score[a:b], kind="stable")[: toxic if y[d] else other])
        return out

    def logits(at: np.ndarray) -> np.ndarray:
        return np.concatenate([net.forward(*inputs(at[i : i + 4096]))[0] for i in range(0, len(at), 4096)])

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    hard = np.concatenate(chosen(evidence, 6, 6))  # windows that the network picks from later
    step = 0
    for turn in range(rounds):
        score = evidence
        if turn >= rounds // 2:
            score = np.full(len(grid), -1e9)
            score[hard] = logits(hard)
        at = np.concatenate([np.unique(np.concatenate([own, rng.integers(first[d], first[d + 1], 1)])) if not y[d] else own for d, own in enumerate(chosen(score, 2, 3))])
        label = kind[at].astype(np.float32)
        balance = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(np.float32)
        queue = np.concatenate([rng.permutation(len(at)) for _ in range(1 + steps // rounds * batch // len(at))])
        for own in (queue[i : i + batch] for i in range(0, steps // rounds * batch, batch)):
            idx = grid[at[own]].T
            x, mask = inputs(at[own])
            # learned vectors are left out at random, so that they can't stand for single documents
            kept = (rng.random(idx.shape) < KEEP)[..., None] / np.float32(KEEP)
            x[..., FIXED:] *= kept
            z, saved = net.forward(x.astype(np.float32), mask)
            g, dx = net.backward(((_sigmoid(z) - label[own]) * balance[own] / len(own)).astype(np.float32), saved)
            word = idx.ravel()
            dx = (dx[..., FIXED:] * kept).reshape(len(word), -1)
            used, place = np.unique(word, return_inverse=True)
            sums = np.stack([np.bincount(place, dx[:, k], len(used)) for k in range(dx.shape[1])], axis=1)
            sums[used == 0] = 0
            n = spelling.many[used]
            flat = ragged(spelling.flat, spelling.starts[used], n)
            share = np.repeat(sums[:, :CHAR_DIM] / n[:, None], n, axis=0)
            g["chars"] = np.stack([np.bincount(flat, share[:, k], BUCKETS) for k in range(CHAR_DIM)], axis=1).astype(np.float32)
            g["words"] = np.stack([np.bincount(spelling.word[used], sums[:, CHAR_DIM + k], WORD_BUCKETS) for k in range(WORD_DIM)], axis=1).astype(np.float32)
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + (DECAY * net.p[k] if k in ("chars", "words") else 0)).astype(np.float32)
    z = logits(np.arange(len(grid)))
    model.p = net.p
    f = np.array([_summary(z[first[d] : first[d + 1]]) for d in range(len(docs))])
    *weights, c = _logistic(f, y).tolist()
    share = float(y.mean())
    prior = share if prior is None else prior
    model.calibration = *weights, c + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def _summary(z: np.ndarray) -> tuple[float, float, float]:
    """Largest window logit, mean of the three largest, and the number of windows, which raises both."""
    top = np.sort(z)[-3:]
    return float(top[-1]), float(top.mean()), float(np.log(len(z)))


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of f and of a constant, with a little shrinkage."""
    x = np.column_stack([f, np.ones(len(f))])
    w, shrink = np.zeros(x.shape[1]), np.array([0.1] * f.shape[1] + [1e-3])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(shrink), x.T @ (q - y) + shrink * w)
    return w


def default_training(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id's text isn't 1 modulo 3."""
    return id_crc(F.col(id_col), 3) != 1


def learn(docs: DataFrame, labels: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 1000, most_chars: int = 40_000) -> ToxicityModel:
    """A model from a hash sample of at most sample_docs labelled training documents a class, of at most most_chars characters each."""
    marks = columns_or(labels, doc_id=id_col, y=label_col).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.where(default_training() if training is None else training).withColumn("key", F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)))
    counts = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    limit = lambda k: int(min(1.0, 1.2 * sample_docs / max(1, counts.get(k, 1))) * (1 << 30))
    marks = marks.where((F.col("key") < limit(1)) & (F.col("y") == 1) | (F.col("key") < limit(0)) & (F.col("y") == 0))
    found = columns_or(docs, doc_id=id_col, text=text_col).where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(marks), "doc_id")  # marks: at most 2.4 * sample_docs rows or so
    one = found.groupBy("doc_id", "y", "key").agg(F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("t"))  # a repeated id counts once
    rows = sorted((r[0], r[1], r[2] or "") for r in one.select("y", "key", "t.text").collect())
    rows = [r for r in rows if r[0] == 0][:sample_docs] + [r for r in rows if r[0] == 1][:sample_docs]
    prior = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return train([r[2] for r in rows], [r[0] for r in rows], prior if 0 < prior < 1 else None)


class _Scorer:
    """Scores batches of texts. A word's part of both layers' gates is computed once while it's in the cache."""

    def __init__(self, model: ToxicityModel, bound: int = 300_000):
        self.m, self.bound = model, bound
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.table = np.zeros((2, 1 << 12, 3 * HIDDEN), np.float32)
        if self.m.p:
            empty = np.zeros((1, FIXED), np.float32)
            self.table[:, :1] = self._gates(np.concatenate([empty, Spelling([""]).vectors(self.m.p)], axis=1))

    def _gates(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.m.p["x"] + self.m.p["b"]

    def _learn(self, fresh: list[str]) -> None:
        n = len(self.codes) + 1
        need = n + len(fresh)
        if need > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros((2, need - self.table.shape[1] // 2, 3 * HIDDEN), np.float32)], axis=1)
        self.table[:, n:need] = self._gates(np.concatenate([self.m.inputs(fresh), Spelling(fresh).vectors(self.m.p)], axis=1))
        for k, w in enumerate(fresh):
            self.codes[w] = n + k

    def logits(self, grid: np.ndarray) -> np.ndarray:
        p, h = self.m.p, HIDDEN
        n = len(grid)
        mask = (grid.T > 0).astype(np.float32)
        full = bool(mask.all())
        states, now, x = np.empty((2, WINDOW, n, h), np.float32), np.zeros((2, n, h), np.float32), np.empty((2, n, 3 * h), np.float32)
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            np.take(self.table[0], grid[:, t], axis=0, out=x[0], mode="clip")
            np.take(self.table[1], grid[:, back], axis=0, out=x[1], mode="clip")
            u = now @ p["h"]
            zr = x[..., : 2 * h]
            zr += u[..., : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = u[..., 2 * h :]
            c *= zr[..., h:]
            c += x[..., 2 * h :]
            c = np.tanh(c)
            new = c + zr[..., :h] * (now - c)
            if not full:
                new = np.where(np.stack([mask[t], mask[back]])[..., None] > 0, new, now)
            states[0, t], states[1, back] = new
            now = new
        e = np.tanh(states[0] @ p["att"][:h] + states[1] @ p["att"][h:]) @ p["pick"] - 1e9 * (1 - mask)  # (T, n)
        e = np.exp(e - e.max(axis=0)) * np.maximum(mask, 1e-9)
        w = e / e.sum(axis=0)
        value = states[0] @ p["out"][:h] + states[1] @ p["out"][h:]
        return (w * value).sum(axis=0) + p["bias"][0]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.m.p:
            return [0.0] * len(texts)
        if len(self.codes) > self.bound:
            self.clear()
        rows, counts, lists, fresh = [], [], [], set()
        for t in texts:
            words = words_of(t)
            lists.append(words)
            fresh.update([w for w in set(words) if w not in self.codes])
        if fresh:
            self._learn(sorted(fresh))
        for words in lists:
            codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            many = len(windows_of(len(words)))
            padded = np.zeros((many - 1) * STRIDE + WINDOW, np.int64)
            padded[: len(codes)] = codes
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
            counts.append(many)
        grid = np.concatenate(rows)
        z = np.concatenate([self.logits(grid[i : i + 2048]) for i in range(0, len(grid), 2048)])
        *weights, c = self.m.calibration
        out, at = [], 0
        for n in counts:
            logit = float(np.dot(weights, _summary(z[at : at + n]))) + c
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -50, 50)))))
            at += n
        return out


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 from threshold on)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a model of bounded size

    def make():
        scorer = worker_cache(("scorer", key), lambda: _Scorer(shared.value))

        def batch(column: pa.Array) -> list[pa.Array]:
            out = []
            for i in range(0, len(column), 200):
                out += scorer.scores(column.slice(i, 200).to_pylist())
            return [pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())]

        return batch

    return append_columns(docs, [text_col], [("score", "double"), ("predicted", "int")], make)
