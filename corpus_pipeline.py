"""A training corpus from raw documents: select, deduplicate, decontaminate, redact, encode.

``STAGES`` holds ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns the documents that go on. Each result is written as Parquet and
read back as the next stage's documents.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import decontaminate, near_text, pieces, pii, resample
from duskwatch.llm.words import small_batches
from duskwatch.session import stage

#: The vocabulary file, at the same place on every machine.
MODEL = os.path.join(os.environ.get("DUSKWATCH_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by importance resampling towards those labelled good."""
    labels = small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return resample.keep(docs, labels, F.col("quality") == 1, seed=6)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (word shingles alike by 0.8 or more), the one of the smallest id."""
    small_batches(spark)
    return near_text.deduplicate(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage."""
    return decontaminate.clean(docs, small_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind; the length follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a sampled segmentation into vocabulary pieces."""
    small_batches(spark)
    coded = pieces.encode(docs, MODEL, alpha=0.9, seed=1)
    return coded.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("encoding", encoding)]

#: SQL can't express the sampling, the minwise join, the bootstrapping and the drawn segmentation: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
