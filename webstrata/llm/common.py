"""Shared plumbing of the training-data operators: durable cuts of lineage, size-checked joins,
skew-proof joins and connected components.

Nothing here keeps data on one machine: every intermediate table is written to the folder named
by ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only while its counted rows stay under this many bytes.
BROADCAST_BYTES = 16 << 20
#: Rows of one key that a single task may always get; a key is salted from a third of a task's share on.
HOT_ROWS = 1000
#: Bytes of texts in an Arrow batch, which a task and its Python worker both hold whole.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webstrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about ``BATCH_BYTES`` for the actions inside, unless the session sets a size.

    Batches are cut by rows too; a batch of that many long texts would be held by executor and worker.
    A single longer text is still a batch of its own.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is not None:
        yield
        return
    spark.conf.set(size, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(size)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small iterated table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (one row a key), broadcasting ``small`` only if its counted size allows.

    ``small`` has to be materialised (``stored``/``cut``) so that counting it is cheap. Beyond
    ``BROADCAST_BYTES`` the join shuffles, with hot keys of ``big`` salted.
    """
    if rows is None:
        rows = small.count()
    if rows * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return join_salted(big, small, on, how)


def join_salted(big: DataFrame, small: DataFrame, on: list[str], how: str, counts: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to ``small``, which has one row a key, so that no key of ``big`` meets in one task.

    Keys with more rows than a third of a task's share (``HOT_ROWS`` at least) are split over as many
    salts as they need; there are at most three times as many such keys as partitions, so their list
    may be broadcast. ``small`` gets one copy of such a key's row for each salt. Salts come from the
    row's content, so a repeated task deals alike. ``counts`` may hold the stored keys with their number
    ``n`` of rows in ``big``.
    """
    if counts is None:
        counts = cut(big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS))
    share = counts.where(F.col("n") > HOT_ROWS).agg(F.sum("n")).first()[0]
    if not share:
        return big.join(small, on, how)
    limit = max(HOT_ROWS, int(share) // (3 * partitions(big.sparkSession)))
    hot_keys = F.broadcast(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    left = big.join(hot_keys, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*big.columns), F.col("_salts")).cast("int"))).drop("_salts")
    right = small.join(hot_keys, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has columns ``u`` and ``v`` of one type. Returns ``node``, ``root`` (the smallest node of its
    component) for every node that has an edge. Only minima are aggregated, never neighbour lists,
    and every round is checkpointed. Raises if the rounds do not converge.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        at = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if at == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = at
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def set_aside(df: DataFrame, used: list[str]) -> DataFrame:
    """The ``used`` columns of ``df`` that it has, and all others together in the struct ``_rest``.

    So an operator's own column names cannot clash with those of the table; ``put_back`` undoes it.
    """
    rest = [_named(c) for c in df.columns if c not in used]
    return df.select(*[_named(c) for c in df.columns if c in used], *([F.struct(*rest).alias("_rest")] if rest else []))


def put_back(columns: list[str], used: list[str]) -> list[Column]:
    """The ``columns`` of the table before ``set_aside``, in their order."""
    return [_named(c) if c in used else F.col("_rest").getField(c).alias(c) for c in columns]


def _named(column: str) -> Column:
    return F.col("`{}`".format(column.replace("`", "``")))


def text_id(text: str | Column = "text") -> Column:
    """A 128-bit digest of the text (null counts as empty) as 16 bytes."""
    col = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.substring(F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256), 1, 32))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """25 bytes that tell rows apart and sort them: ids in order, null ids last, then the text's digest."""
    number = F.when(F.col(doc_id).isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), F.lpad(F.hex(F.col(doc_id).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")))
    return F.unhex(F.concat(number, F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32)))
