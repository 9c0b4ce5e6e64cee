"""Language ID by compression: the language whose dictionary lets zstandard write the text shortest.

Each language's dictionary is raw content of a bounded sample of labelled training rows (sample_docs a language, cut to
dictionary_bytes, of at most piece_chars of each). A text is lower-cased, everything but letters is one space, and it is
compressed piece by piece (chunk_bytes), so that the dictionary counts alike at every length; sizes add up over the whole text.

Cases: null text, and text without a letter, is 'und' with score 0 and rejected; without training rows every text is; ties go to
the language first by name; null ids and repeated rows are predicted each; columns that carry an output's name are replaced."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, columns_or, id_crc, worker_cache

_NO_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def normalised(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    chunk_bytes: int = 1024

    def compressors(self):
        import zstandard

        out = []
        for lang, data in self.dictionaries:
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=self.level)
            out.append((lang, zstandard.ZstdCompressor(level=self.level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
        return out


def default_training(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id's text isn't 2 modulo 4."""
    return id_crc(F.col(id_col), 4) != 2


def learn(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400, piece_chars: int = 2000, dictionary_bytes: int = 112 << 10, most_languages: int = 1000) -> LanguageModel:
    """Dictionaries from a hash sample of labelled rows; what comes to the driver is about 3 * sample_docs pieces of piece_chars for
    each of the most_languages labels with most rows (ties: by name); rarer labels are not learned."""
    rows = docs.where(default_training(id_col) if training is None else training)
    rows = columns_or(rows, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and lang <> 'und' and text is not null and length(text) > 0")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return LanguageModel(())
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):  # three times the wanted share, then exactly sample_docs below
        chosen = chosen | ((F.col("lang") == lang) & (F.col("key") < int(min(1.0, 3 * sample_docs / n) * (1 << 30))))
    cut = F.expr(f"substring(text, 1 + cast(pmod(key, greatest(1, length(text) - {piece_chars})) as int), {piece_chars})")
    pieces: dict[str, list] = {lang: [] for lang in counts}
    for lang, k, piece in rows.withColumn("key", key).where(chosen).select("lang", "key", cut.alias("piece")).collect():
        pieces[lang].append((k, piece))
    out = []
    for lang in sorted(pieces):
        own = [normalised(p) for _, p in sorted(pieces[lang])[:sample_docs]]
        out.append((lang, b" ".join(own)[:dictionary_bytes] or b" "))
    return LanguageModel(tuple(out))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", reject_margin: float = 0.003) -> DataFrame:
    """docs with lang_pred, score (margin over the next language, m / (m + 0.02)), margin and rejected (und, or margin under
    reject_margin)."""

    def make():
        own = worker_cache(("language", model), model.compressors)
        step = model.chunk_bytes

        def sizes(text: str) -> list[int]:
            raw = normalised(text)
            parts = [raw[i : i + step] for i in range(0, len(raw), step)]
            return [sum(map(len, map(write, parts))) for _, write in own]

        def batch(column: pa.Array) -> list[pa.Array]:
            lang, margin = [], []
            for t in column:
                text = t.as_py()
                if not own or text is None or _LETTER.search(text) is None:
                    lang.append("und")
                    margin.append(0.0)
                    continue
                size = sizes(text)
                best = min(range(len(own)), key=size.__getitem__)
                lang.append(own[best][0])
                others = [s for i, s in enumerate(size) if i != best]
                margin.append((min(others) - size[best]) / max(1, min(others)) if others else 1.0)
            m = np.array(margin, float)
            rejected = (m < reject_margin) | np.array([x == "und" for x in lang], bool)
            return [pa.array(lang, pa.string()), pa.array(m / (m + 0.02), pa.float64()), pa.array(m, pa.float64()), pa.array(rejected, pa.bool_())]

        return batch

    return append_columns(docs, [text_col], [("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("rejected", "boolean")], make)
