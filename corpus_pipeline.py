"""The corpus pipeline: toxicity, exact and near duplicates, benchmark leaks, mixing.

``run(spark, sf_dir)`` applies the stages to the table ``documents``; every stage is written as Parquet to the shared
folder and read again by the next. No stage's decision is expressible in SQL as a whole (the first learns a model, the
last draws a sample), hence no oracle: tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jetloom.llm.compression_toxicity import drop_toxic
from jetloom.llm.cuckoo import keep_first
from jetloom.llm.decontaminate import drop_leaks
from jetloom.llm.mixing import mix
from jetloom.llm.odd_sketch import NearPlan, keep_smallest
from jetloom.llm.staging import staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (similarity 0.8 or more) stays."""
    return keep_smallest(docs, NearPlan(percent=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix repeats every document that is left."""
    return mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
