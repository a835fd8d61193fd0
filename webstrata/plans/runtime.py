"""The cluster's shared checkpoint folder, cutting the lineage of iterated tables in it, and keys that
have too many rows for one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task may always get.
HOT_ROWS = 5000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/webstrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, on: list[str], *more) -> DataFrame | None:
    """Keys with more rows than a third of a task's share (``HOT_ROWS`` at least), with ``n`` and the
    aggregates ``more``; None if there are none.

    There are at most three times as many as partitions, so they may be broadcast.
    """
    counts = cut(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *more).where(F.col("n") > HOT_ROWS))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.where(F.col("n") > max(HOT_ROWS, int(total) // (3 * tasks)))
