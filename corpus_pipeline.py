"""A corpus from documents to tokens: five stages, each an operator of millrace.llm.

A stage takes what the one before has written and returns a table; all but the last return
the columns of documents.  Toxic documents go; one document of each group of near duplicates
stays; passages that an earlier document has are cut out of texts; documents that hold a
benchmark's item go; what is left is encoded.

Cases: documents with null or empty texts are clean and stay, as do rows with null ids; equal rows
with one id become one row where near duplicates go; ties between near duplicates go to the
smaller id; an empty table passes every stage; other columns, of any name, stay as they are until
the last stage, which returns those of ``documents`` without the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, forest, substring, toxicity
from millrace.sources.scratch import drop, scratch_dir
from millrace.sources.ship import ship

#: Percent of the union that two documents' shingles share to be near duplicates.
NEAR = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return forest.drop_near_duplicates(docs, numerator=NEAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    coded = bpe.encode_column(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: The stages need trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    top = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if before is not None:  # what the stage before has written is no longer asked for
            drop(before)
        before = docs
    return docs
