"""The corpus pipeline: stages from the operators of tidalspan.llm, each written and reread.

toxicity drops the documents that the factorization machine rejects; near_dedup keeps the first
document of each group that is alike in shingles of five words to 0.8 or more; secret_scan
replaces secrets in the texts; mixing takes documents, whole, once or more or not at all, until
each source has its share; packing cuts the mix into sequences and returns their pieces. All but
the last return the columns of documents. Each has the cases of its operator (see there).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalspan.llm import mixing, packing, secret_scan, simhash, storage, toxicity, words


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones among them, does not reject."""
    docs = docs.select(*words.DOCUMENT_COLUMNS)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, machine, words.DOCUMENT_COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).drop("score")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.first_of_groups(docs.select(*words.DOCUMENT_COLUMNS))


def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secret_scan.redacted(docs.select(*words.DOCUMENT_COLUMNS))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row each time that a document is taken."""
    return mixing.mixed(docs.select(*words.DOCUMENT_COLUMNS), words.partitions(spark))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("secret_scan", stage_secret_scan),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, storage.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        storage.drop(before)  # the table of the stage before; nothing reads it any more
    return docs
