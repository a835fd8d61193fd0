"""Archiving a stream into several stores, with a queue of what has yet to get there.

The state after a batch is two tables in a shared folder: ``open/<batch>`` is the queue, all rows that some
store still lacks, and ``done/<batch>`` the rows that left it in that batch. Each batch reads the queue of
the one before, so a batch that is run again, after a lost driver too, gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.plans.runtime import cut

Store = Callable[[DataFrame, int], None]
STATE = ["want", "archived", "attempts", "reason"]


def archiver(stores: dict[int, Store], folder: str, key: str = "id", seq: str = "seq", max_attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for rows with ``key``, ``seq`` and ``want``, a set of bits of stores.

    A store is a function of rows and batch number; one that raises keeps none of them back from the others,
    and its rows stay in the queue with the reason. After ``max_attempts`` batches with a failure a row is
    given up. Of rows of one key that are in the queue at once the last is archived, for all their stores.
    Stores should overwrite what they have of a batch that comes again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"archived": F.lit(0), "attempts": F.lit(0), "reason": F.lit(None).cast("string")}).withColumn("want", F.col("want").cast("int"))
        if batch_id > 0:
            rows = spark.read.schema(rows.schema).parquet(f"{folder}/open/{batch_id - 1}").unionByName(rows)
        others = [c for c in rows.columns if c not in (key, *STATE)]
        last = F.max_by(F.struct(*others, "reason"), F.col(seq)).alias("_row")
        rows = cut(rows.groupBy(key).agg(last, F.bit_or("want").alias("want"), F.bit_or("archived").alias("archived"), F.max("attempts").alias("attempts")).select(key, "_row.*", "want", "archived", "attempts"))
        held, failed = 0, {}
        for bit, store in stores.items():
            try:
                store(rows.where((F.col("want").bitwiseAND(F.lit(bit)) != 0) & (F.col("archived").bitwiseAND(F.lit(bit)) == 0)).select(key, *others), batch_id)
                held |= bit
            except Exception as exc:  # whatever keeps a store from taking rows
                failed[bit] = (str(exc) or type(exc).__name__).splitlines()[0]
        archived = F.col("archived").bitwiseOR(F.col("want").bitwiseAND(F.lit(held)))
        missing = F.col("want").bitwiseAND(F.bitwise_not("archived"))
        why = F.concat_ws("; ", *[F.when(missing.bitwiseAND(F.lit(bit)) != 0, F.lit(text)) for bit, text in failed.items()])
        after = rows.withColumn("archived", archived).withColumn("attempts", F.col("attempts") + (missing != 0).cast("int")).withColumn("reason", F.when(missing != 0, F.nullif(why, F.lit(""))).otherwise(F.col("reason")))
        waits = (missing != 0) & (F.col("attempts") < max_attempts)
        after.where(waits).write.mode("overwrite").parquet(f"{folder}/open/{batch_id}")
        after.where(~waits).write.mode("overwrite").parquet(f"{folder}/done/{batch_id}")

    return run


def state(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """All rows after a batch, with ``state``: archived, queued, or given up."""
    done = spark.read.parquet(*[f"{folder}/done/{k}" for k in range(batch_id + 1)])
    missing = F.col("want").bitwiseAND(F.bitwise_not("archived")) != 0
    rows = done.withColumn("state", F.when(missing, "given up").otherwise("archived"))
    return rows.unionByName(spark.read.schema(done.schema).parquet(f"{folder}/open/{batch_id}").withColumn("state", F.lit("queued")))


def counters(rows: DataFrame) -> DataFrame:
    """Rows and attempts by state."""
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("rows"), F.sum("attempts").alias("attempts"))
