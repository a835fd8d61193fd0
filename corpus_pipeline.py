"""A training-corpus pipeline over ``documents``; each stage is one operator of webstrata.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import decontamination, language_id, line_dedup, mixing, ngram_join
from webstrata.llm.common import shared_dir


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language_id.accepted(docs)


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that an earlier one has."""
    return line_dedup.deduplicated(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken, with its size and the number of the copy."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_deduplicated),
    ("ngram_join", one_of_each_class),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Word statistics, alignment and tilting are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes its result, which the next one reads."""
    at = f"{shared_dir(spark)}/webstrata/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
