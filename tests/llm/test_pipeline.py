"""The pipeline's stages: each against what its operator says of its own input."""

from __future__ import annotations

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from millrace.llm import queries, toxicity
from millrace.sources.scratch import materialize


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, frames = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept[name], frames[name], docs = {r.doc_id for r in after.select("doc_id").collect()}, after, after
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = toxicity.judge(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert kept["toxicity"] == {r.doc_id for r in scores if r.score < 0.5}
    near = queries._FOREST.replace("FROM documents", f"FROM '{tmp_path}/toxicity/*.parquet'").replace("85 * (na", f"{corpus_pipeline.NEAR} * (na")
    assert kept["near_dedup"] == {r[0] for r in duckdb.sql(f"SELECT doc_id FROM ({near}) WHERE kept").fetchall()}
    assert kept["substring_dedup"] == kept["near_dedup"]
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in frames["decontamination"].collect()}
    for r in frames["byte_bpe"].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == peer.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4
    assert kept["byte_bpe"] == kept["decontamination"]


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"] and 0 < got.count() <= 200


def test_odd_tables(spark, sf_dir):
    """Nulls, empty and repeated rows, a long text and an empty table through every stage."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = [f"plain words number {k} go on " + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(4)]
    rows = [(0, clean[0], "en", "s", 1), (0, clean[0], "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (None, clean[1], None, "s", 5), (3, clean[0] + " more", "en", "s", 2), (4, " ".join(f"t{j}" for j in range(20_000)), "en", "s", 9), (5, clean[2], "en", None, 3)]
    odd = spark.createDataFrame([(a, b, c, d, n) for a, b, c, d, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    for docs, want in ((odd, [0, 1, 2, 4, 5, None]), (odd.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "odd")
        assert sorted((r.doc_id for r in docs.collect()), key=lambda k: (k is None, k or 0)) == want
