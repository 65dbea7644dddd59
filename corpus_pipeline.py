"""A document corpus made ready for training: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns
of `documents`. The mix repeats documents, so its rows are not unique by doc_id.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm import decontam, mixing, neardup, quality, sharding
from tillweave.session import shared_dir

#: Similarity of five-word shingles from which texts are near copies here; op5 has its own, 85.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep most of their text when cleaned line by line,
    without their failing lines."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked at `NEAR_PERCENT`."""
    return neardup.deduplicate(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its coin say."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    made = sharding.with_shards(docs)
    s = made.columns[-1]
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{s}.shard").alias("shard"), F.col(f"{s}.slot").alias("slot"))


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix_sources", mix_sources), ("sharding", shard),
]

#: Near-duplicate linking and the classifiers of lines are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_dir(spark), "pipeline", uuid.uuid4().hex)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
