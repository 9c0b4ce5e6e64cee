"""The queries of the corpus operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, quality


#: Share of the largest entropy that op1 asks for: sources weigh almost alike, as far as max_epochs allows it.
MIX_TARGET = 0.9999


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), target=MIX_TARGET)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import id_crc
    from .language_id import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(id_crc(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_links import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import id_crc
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(id_crc(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii, session_key

    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_embedding_links": op4_embedding_links,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_toxicity": op6_toxicity,
    "op7_surrogates": op7_surrogates,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
}

OP4_SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
fine AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
walk(n, m) AS (SELECT DISTINCT vec_id, vec_id FROM v UNION SELECT walk.n, links.b FROM walk JOIN links ON links.a = walk.m), least AS (SELECT n, min(m) AS component_id FROM walk GROUP BY n), counts AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v LEFT JOIN counts USING (r) LEFT JOIN least ON n = vec_id"""

OP10_SQL = """WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT r, doc_id, count(*) AS n FROM shingles GROUP BY r, doc_id),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
near AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c) AND x.doc_id <> y.doc_id),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
walk(n, m) AS (SELECT DISTINCT doc_id, doc_id FROM words UNION SELECT walk.n, links.b FROM walk JOIN links ON links.a = walk.m), least AS (SELECT n, min(m) AS component_id FROM walk GROUP BY n)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, component_id FROM words w LEFT JOIN sizes z ON z.r = w.r LEFT JOIN least ON least.n = w.doc_id"""

#: The others' methods are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_source_mixing": mixing.oracle(MIX_TARGET), "op4_embedding_links": OP4_SQL, "op9_quality_rules": quality.oracle(), "op10_jaccard_join": OP10_SQL}
