"""The training-data pipeline: each stage reads what the stage before it kept.

toxicity (documents that it rejects go) -> quality (documents that it rejects go) -> near-duplicates (one document of each
class stays) -> substring dedup (repeated words go) -> packing (one row for each piece of a sequence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenprose.llm import anchors, bagminhash, packing, quality, toxicity
from lumenprose.llm.common import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return anchors.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: The stages that learn and the tokenizer can't be expressed in SQL; tests/llm holds the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    path = scratch(spark, "pipeline-packed")
    STAGES[-1][1](spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
