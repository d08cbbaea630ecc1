"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import audio, bpe, decontam, forest, html, lm, records, sharding, substring, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digests(_documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(_documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    index = records.token_records(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "offset", "length")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_hash")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_documents(spark, sf_dir)).drop("text_hash", "cluster")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_documents(spark, sf_dir))


_FOREST = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS ss FROM w
), e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The registered queries."""
    return {f.__name__: f for f in (op1_audio_features, op2_lm_scoring, op3_html_extraction, op4_byte_bpe, op5_toxicity, op6_token_records, op7_decontamination, op8_substring_dedup, op9_sharding, op10_minhash_forest)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op10_minhash_forest": _FOREST}
