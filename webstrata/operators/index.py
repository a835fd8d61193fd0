"""The index of visits by URL as a table that batches are added to.

The table is bucketed and sorted by URL, so lookups join it without moving it: only the side that asks
is shuffled. A batch is a partition of its own and overwrites itself when it is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def create(spark: SparkSession, name: str, schema: DataFrame, path: str, key: str = "net_url", buckets: int = BUCKETS) -> None:
    """An empty index with the columns of ``schema``, in the shared folder ``path``."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")


def append(batch: DataFrame, batch_id: int, name: str, key: str = "net_url", buckets: int = BUCKETS) -> None:
    """Add a batch; one that has been added before is replaced, so a repeated batch does no harm."""
    spark = batch.sparkSession
    columns = [c for c in spark.table(name).columns if c != "batch"]
    rows = batch.select(*columns).repartition(buckets, key)
    listed = ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = {int(batch_id)}) SELECT {listed} FROM {{rows}}", rows=rows)


def appender(name: str, key: str = "net_url", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds every batch of a stream."""
    return lambda batch, batch_id: append(batch, batch_id, name, key, buckets)


def lookup(asked: DataFrame, name: str, key: str = "net_url", how: str = "inner") -> DataFrame:
    """``asked`` joined to the index by URL; the index is read bucket by bucket, without an exchange."""
    index = asked.sparkSession.table(name).drop("batch")
    return asked.hint("shuffle_merge").join(index, key, how)
