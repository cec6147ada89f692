"""A corpus pipeline: toxic documents go, near-duplicates go, secrets are marked, what is left is packed for training.

Part of the subpackage ``crosspanel.llm``. Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import common, packing, secrets, simhash, toxicity
from crosspanel.llm.queries import WORD_BPE, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the documents given here and their labels."""
    return toxicity.without_toxic(docs.select(*COLUMNS), toxicity.train(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids in sequences of at most 2048."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL has none of the classifier, XXH64 with a seed, the Markov models' training or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read again as the next one's documents, and then dropped."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.drop_written(*before)
        before = [docs]
    return docs
