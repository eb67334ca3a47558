"""From raw documents to shards: quality, near duplicates, benchmark passages, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again before the next. Part of the training-data subpackage tessella.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.session import importable
from tessella.llm import decontaminate, minhash, mixing, quality, shards
from tessella.llm.storage import Scratch

SHARDS = 40
#: No SQL states the classifier or the signatures; tests compare the stages with brute force.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at the threshold or above."""
    return quality.keep_good(spark, docs, importable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; rows that repeat an id count once."""
    return minhash.one_of_each(importable(spark), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(spark, docs, importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked mixture."""
    return mixing.sampled(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return shards.shard_documents(docs, SHARDS)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixture", mixed), ("shards", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(name, docs)
    return docs
