"""The corpus pipeline: good documents, one of each near-duplicate group, decontaminated, mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from personaloom.llm import decontaminate, jaccard_join, mixing, quality, sharding
from personaloom.llm.storage import stored

SHARDS = 16
#: Near duplicates: shingles of five words, a similarity of 0.8.
NEAR = jaccard_join.Rule(n=5, percent=80)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from labelled rows of `docs`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, quality.fit(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that near-duplicate links connect."""
    return jaccard_join.one_of_each(docs, NEAR)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontaminate.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources uses them, 0 to 3 times."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; repeated documents are linked and go to one shard."""
    return sharding.shard_documents(docs, SHARDS).drop("link")


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier's scores and the links' components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
