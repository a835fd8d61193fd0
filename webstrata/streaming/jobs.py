"""Streaming forms of capture and archive operators, on Structured Streaming.

Stateless ones (classification, filters, templates) are the batch functions applied to a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of that name in a folder; their schema is that of the batch table."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def dump_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files that servers drop into a landing folder, without those still being written."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).where(~F.col("path").endswith(".part"))


def distinct(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First row of each key; state is kept as long as repeats may come."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """The running latest row of each key (update or complete mode)."""
    others = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time, seq)).alias("row")).select(*keys, "row.*")


def settled(stream: DataFrame, key: str, time: str, gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Bursts of activity that ended with a quiet period: start, end and rows of each."""
    grouped = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("burst"), key).agg(F.count(F.lit(1)).alias("rows"))
    return grouped.select(key, F.col("burst.start").alias("started"), F.col("burst.end").alias("settled"), "rows")


def totals(stream: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Running counts and sizes (update mode)."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("size"))


def assembled(stream: DataFrame, key: str, parts: list[str], wait_ms: int = 3000) -> DataFrame:
    """Join the two halves of events that arrive in any order.

    ``parts`` are nullable string columns. A row goes out once all are known; one that stays
    incomplete for ``wait_ms`` of processing time goes out as it is, with ``whole`` false.
    """
    schema = f"{key} string, " + ", ".join(f"{p} string" for p in parts) + ", whole boolean"
    state_schema = ", ".join(f"{p} string" for p in parts)

    def update(key_value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(parts, state.get)) if state.exists else dict.fromkeys(parts)
        if not state.hasTimedOut:
            for frame in frames:
                for p in parts:
                    values = frame[p].dropna()
                    if known[p] is None and len(values):
                        known[p] = values.iloc[0]
            if not all(v is not None for v in known.values()):
                state.update(tuple(known[p] for p in parts))
                state.setTimeoutDuration(wait_ms)
                return
        if state.exists:
            state.remove()
        yield pd.DataFrame([{key: key_value[0], **known, "whole": all(v is not None for v in known.values())}])

    return stream.select(F.col(key).cast("string").alias(key), *parts).groupBy(key).applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def matched(ours: DataFrame, theirs: DataFrame, on: list[str], within: str = "1 minute") -> DataFrame:
    """Stream-stream match of two observers' records of one exchange: pairs of equal keys at most
    ``within`` apart. Both have id and at; watermarks bound how long either side waits."""
    a = ours.select(*on, F.col("id").alias("our_id"), F.col("at").alias("our_at")).withWatermark("our_at", within)
    b = theirs.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("id").alias("their_id"), F.col("at").alias("their_at")).withWatermark("their_at", within)
    near = (F.col("our_at") >= F.col("their_at") - F.expr(f"INTERVAL {within}")) & (F.col("our_at") <= F.col("their_at") + F.expr(f"INTERVAL {within}"))
    same = near
    for c in on:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return a.join(b, same).select(*on, "our_id", "their_id", "our_at", "their_at")


def in_flight(stream: DataFrame, key: str, wait_ms: int = 60_000) -> DataFrame:
    """Exchanges from their events (``key``, seq, kind, value), one row or more for each key.

    ``request`` opens, ``headers`` sets the status, ``redirect`` and ``auth`` emit what there is and go
    on, ``complete`` and ``error`` emit and end; ``flush`` emits at once. What stays open for ``wait_ms``
    of processing time goes out as ``timeout``. Only the open request is state.
    """
    schema, state_schema = f"{key} string, part int, request string, status string, ended string", "part int, request string, status string"

    def update(key_value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part, request, status = state.get if state.exists else (0, None, None)
        out = []
        if state.hasTimedOut:
            out.append((key_value[0], part, request, status, "timeout"))
            state.remove()
        else:
            open_ = state.exists
            for event in pd.concat(list(frames)).sort_values("seq").itertuples():
                if event.kind == "request":
                    request, open_ = event.value, True
                elif event.kind == "headers":
                    status, open_ = event.value, True
                elif open_:
                    out.append((key_value[0], part, request, status, event.kind))
                    part, status, open_ = part + 1, None, event.kind in ("redirect", "auth")
            if open_:
                state.update((part, request, status))
                state.setTimeoutDuration(wait_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[key, "part", "request", "status", "ended"])

    return stream.select(F.col(key).cast("string").alias(key), "seq", "kind", "value").groupBy(key).applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def retried(failures: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose archiving failed for a reason that may pass, to be put in again: one for each store."""
    return rows.join(failures.where(F.col("recoverable")).select(key, "store").distinct(), key)


def archive_to(stores: dict[int, Callable[[DataFrame, int], None]], failures: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands every batch to each store whose bit is not yet in
    ``archived``. A store that raises gets its rows written to ``failures`` with the reason, to be
    put in again; the others are not held up."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for bit, store in stores.items():
                todo = batch.where(F.col("archived").bitwiseAND(F.lit(bit)) == 0)
                try:
                    store(todo, batch_id)
                except Exception as exc:
                    failures(todo.withColumn("store", F.lit(bit)).withColumn("reason", F.lit(str(exc).splitlines()[0])), batch_id)
        finally:
            batch.unpersist()

    return run


def run_batches(stream: DataFrame, function: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> StreamingQuery:
    """Hand every batch of what is there to a ``foreachBatch`` function, and stop; ``state`` is the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(function).start()
    query.awaitTermination()
    return query


def run_now(stream: DataFrame, path: str, mode: str = "append", timeouts: bool = False) -> StreamingQuery:
    """Process what is there and stop; the result is a Parquet table at ``path``.

    Append mode writes with the file sink, the others overwrite the table with every batch's result.
    State with processing-time ``timeouts`` (``assembled``) asks for batches without data for ever, so
    such a run does without them; rows that still wait are left to the next run.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}.state").trigger(availableNow=True)
    conf, idle = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(idle)
    conf.set(idle, "false" if timeouts else before)
    try:
        if mode == "append":
            query = writer.format("parquet").start(path)
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    finally:
        conf.set(idle, before)
    query.awaitTermination()
    return query
