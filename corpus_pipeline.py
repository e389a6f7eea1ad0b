"""From raw documents to a sharded training set, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as
Parquet into the shared folder and rereads them for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphspark.llm import decontam, jaccard, mixing, quality, sharding
from graphspark.plans.scratch import delete, scoped, scratch_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are multivariate outliers of their language and source."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share 80 % of their five-word shingles only the one with the smallest id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark text, substitutions tolerated."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot, shard and shard_name."""
    return sharding.place(docs, sharding.shard_names(64), 10_007)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality_rules), ("n-gram jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("mixing", source_mix), ("sharding", shards)]

#: No stage before the last can be said in SQL (robust estimates, seeds, positions by hash): tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/graphspark/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scoped(spark):  # the stage's own intermediate tables go when its rows are written
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.schema(rows.schema).parquet(path), path
    return docs
