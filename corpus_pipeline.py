"""The corpus pipeline: documents through the stages below, each written as Parquet and reread as the next one's input.

Every stage takes ``(spark, docs, sf_dir)`` and, but for the last, returns the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import fmindex, mixing, ngram_join, quality, sharding
from graphloom.llm.common import forget, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; every document stays."""
    return fmindex.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tempered weights over the source tree; each leaf gives one whole epoch at least, so no document is lost."""
    return mixing.tempered(docs, "pipeline-1")


def balanced_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row in one of the shards, counts at most one apart."""
    return sharding.result(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("sharding", balanced_shards),
]
#: The classifier and the iterative stages have no SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            now: list[str] = []
            docs = stored(docs, f"stage{i}", now)
            forget(spark, last)  # what the stage read
            last = now
    # the last stage's result is a stored table of its own
    forget(spark, last)
    return docs
