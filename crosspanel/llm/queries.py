"""The subpackage's queries with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, license_scan, media_chunks, packing, pii, secrets, simhash, token_shards, topk, toxicity

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.round_trip(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.digests(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_media_chunks, op2_pii, op3_toxicity, op4_byte_bpe, op5_license_scan, op6_token_shards, op7_simhash, op8_packing, op9_secrets, op10_topk]
    return {f.__name__: f for f in ops}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS t
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT ON (vec_id) vec_id, t FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.t, v.t)])::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": TOP_K_SQL}
