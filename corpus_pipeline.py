"""The corpus pipeline: language ID, near duplicates, personal data, source mixing, BPE round trip.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents. Rows that repeat an id stay
together in every stage. Stages follow one another in the same executors, whose heap would keep the size that the largest of them needed beside the
Python workers of the next: every stage after the first begins by giving heap back.

Cases, in every stage: documents with null ids are kept (no stage links them), null and empty texts go with language ID as texts without a letter,
null sources are one source of their own, an empty table gives empty tables, and columns beyond those used are carried along, whatever their
names (the last stage returns its own four)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, jaccard, language_id, mixing, pii
from trailmark.llm.common import give_back_heap, small, written
from trailmark.llm.queries import table, tokenizer_path

#: The most repeated source is taken at most so many times as often as the least, as in op1.
MAX_EPOCHS = 4.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told from the others; the rest goes."""
    found = language_id.predict(docs, language_id.learn(docs))
    return found.where("not rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard of 0.8 or more on five-word shingles the one with the smallest id."""
    give_back_heap(spark)
    found = jaccard.jaccard_components(docs.select("doc_id", "text"), width=5, num=80, den=100)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows."""
    give_back_heap(spark)
    out = pii.replace_pii(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to MAX_EPOCHS times on average."""
    give_back_heap(spark)
    return mixing.deal_out(docs, max_epochs=MAX_EPOCHS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of ids, and digests of the ids and of the decoded text."""
    give_back_heap(spark)
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("source mixing", mix_sources),
    ("BPE", encode_and_decode),
]

#: Beyond SQL: compression, token-combination prefixes and surrogates; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
