"""A training corpus from `documents`, in five stages; counted as part of mortise.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mortise.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from mortise.session import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines the first stays; documents that lose every line go."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 or more, the one with the smallest id stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the contamination rule, go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights, each document with the number of times it is drawn."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_copies), ("decontamination", benchmark_free), ("mixing", mixture)]

#: Line dedup and mixing hash with functions that SQL engines don't share; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
