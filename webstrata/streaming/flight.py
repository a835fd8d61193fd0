"""Streams with state of their own: exchanges in flight, and the match of two observers' records.

Both keep their state in Spark's state store by ``transformWithState``, with timers of event time, so results
depend on what arrived and not on when a batch happened to run. Exchanges are dealt to lanes by
their id, so that one command can reach all that are open and no lane grows with a busy site.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Hashable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from webstrata.operators.settle import settle

#: The state store that keeps maps, lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LANES = 64


def run_stateful(stream: DataFrame, path: str) -> StreamingQuery:
    """Process what is there and stop; the result is a Parquet table at ``path``, the state beside it."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STORE)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}.state").trigger(availableNow=True).format("parquet").start(path)
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return query


#: Parts of a lane's open exchanges: a batch reads and writes a part at once, and only those that it touches.
BUCKETS = 256
_OPEN = T.StructType([T.StructField("rows", T.StringType())])
_EARLY = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("last", T.LongType())])
PARTS = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("request", T.StringType()), T.StructField("status", T.StringType()), T.StructField("ended", T.StringType())])


def _wake(handle: StatefulProcessorHandle, at: int, after: int = -1) -> None:
    """Ask for a timer, unless an earlier one is set, which then looks at all that is due and asks anew.

    The timer that just rings is still in the list, so those up to ``after`` do not count.
    """
    if min((t for t in handle.listTimers() if t > after), default=at + 1) > at:
        handle.registerTimer(at)


class _InFlight(StatefulProcessor):
    """One lane: the exchanges that are open, in ``BUCKETS`` parts by their id, and a list of events that came before their request.

    A call to the store takes far longer than an event, so there are two calls for each part and not for each exchange.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", T.StructType([T.StructField("bucket", T.IntegerType())]), _OPEN)
        self.early = handle.getListState("early", _EARLY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.parts: dict[int, dict[str, list]] = {}
        early = {}
        for x in self.early.get():
            early.setdefault(x[0], []).append(tuple(x))
        before, now, out, due = {k: list(v) for k, v in early.items()}, {}, [], []
        todo = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for event in todo[["request_id", "seq", "kind", "value", "at_ms"]].itertuples(index=False):
            one, seq, kind, value, at = event.request_id, int(event.seq), event.kind, event.value if isinstance(event.value, str) else None, int(event.at_ms)
            due.append(at + self.wait_ms)
            if kind == "flush":
                self._flush(one if isinstance(one, str) else None, now, out)
                continue
            if one not in now:
                now[one] = self._known(one)
            if now[one] is None and kind != "request":
                early.setdefault(one, []).append((one, seq, kind, value, at))
                continue
            self._event(one, kind, value, at, now, out)
            if kind == "request":
                for _, _, later, what, then in sorted(early.pop(one, []), key=lambda e: e[1]):
                    self._event(one, later, what, max(at, then), now, out)
        changed = set()
        for one, state in now.items():
            bucket = self._bucket(one)
            if self.parts[bucket].get(one) != state:
                changed.add(bucket)
                if state is None:
                    del self.parts[bucket][one]
                else:
                    self.parts[bucket][one] = state
        for bucket in sorted(changed):
            self._put(bucket, self.parts[bucket])
        self.parts = {}
        if early != before:
            self._keep(early)
        _wake(self.handle, min(due))
        yield pd.DataFrame(out, columns=PARTS.names)

    @staticmethod
    def _bucket(one: str | None) -> int:
        return zlib.crc32((one or "").encode()) % BUCKETS

    def _known(self, one: str) -> list | None:
        bucket = self._bucket(one)
        if bucket not in self.parts:
            self.parts[bucket] = self._read(self.open.getValue((bucket,))[0]) if self.open.containsKey((bucket,)) else {}
        return self.parts[bucket].get(one)

    @staticmethod
    def _read(rows: str) -> dict[str, list]:
        return {one: state for one, *state in json.loads(rows)}

    def _put(self, bucket: int, rows: dict[str, list]) -> None:
        if rows:
            self.open.updateValue((bucket,), (json.dumps([[one, *state] for one, state in rows.items()]),))
        elif self.open.containsKey((bucket,)):
            self.open.removeKey((bucket,))

    def _keep(self, early: dict) -> None:
        left = [e for events in early.values() for e in events]
        if left:
            self.early.put(left)
        else:
            self.early.clear()

    def _event(self, one: str, kind: str, value: str | None, at: int, now: dict, out: list) -> None:
        part, request, status, last = now[one] or (0, None, None, at)
        last = max(last, at)
        if kind == "request":
            now[one] = [part, value, status, last]
        elif kind == "headers":
            now[one] = [part, request, value, last]
        elif now[one] is not None:
            out.append((one, part, request, status, kind))
            now[one] = [part + 1, request, None, last] if kind in ("redirect", "auth") else None

    def _flush(self, one: str | None, now: dict, out: list) -> None:
        """Send out one exchange or all that are open, as they are."""
        if one is None:
            for (bucket,), (rows,) in [(tuple(k), tuple(v)) for k, v in self.open.iterator()]:
                self.parts.setdefault(bucket, self._read(rows))
        names = [one] if one is not None else list(dict.fromkeys([*now, *(name for rows in self.parts.values() for name in rows)]))
        for name in sorted(names):
            state = now[name] if name in now else self._known(name)
            if state is not None:
                out.append((name, *state[:3], "flush"))
            now[name] = None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out, left = timerValues.getCurrentWatermarkInMs() - self.wait_ms, [], []
        for (bucket,), (rows,) in [(tuple(k), tuple(v)) for k, v in self.open.iterator()]:
            rows = self._read(rows)
            stay = {one: state for one, state in rows.items() if state[3] > until}
            out += [(one, *state[:3], "timeout") for one, state in rows.items() if state[3] <= until]
            left += [state[3] for state in stay.values()]
            if len(stay) < len(rows):
                self._put(bucket, stay)
        early: dict[str, list] = {}
        for x in self.early.get():
            early.setdefault(x[0], []).append(tuple(x))
        old = [one for one, events in early.items() if max(e[4] for e in events) <= until]
        for one in old:  # their request never came
            status = [e[3] for e in sorted(early.pop(one), key=lambda e: e[1]) if e[2] == "headers"]
            out.append((one, 0, None, status[-1] if status else None, "timeout"))
        if old:
            self._keep(early)
        left += [max(e[4] for e in events) for events in early.values()]
        if left:
            _wake(self.handle, min(left) + self.wait_ms, expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame(sorted(out, key=lambda r: r[:2]), columns=PARTS.names)

    def close(self) -> None:
        pass


def in_flight(events: DataFrame, wait_ms: int = 60_000, delay: str = "0 seconds", lanes: int = LANES) -> DataFrame:
    """Exchanges from their events (request_id, seq, at, kind, value), a row for each part (``PARTS``).

    ``request`` opens, ``headers`` sets the status, ``redirect`` and ``auth`` send out a part and go on,
    ``complete`` and ``error`` send one out and end. Events that come before their request wait for it. A
    row of kind ``flush`` sends out its exchange as it is, with a null id all that are open. What has had no event
    for ``wait_ms`` goes out as ``timeout``, once the watermark (``delay`` behind the latest ``at``) has passed. Rows are
    taken in order of ``seq`` within a batch.
    """
    every = F.when((F.col("kind") == "flush") & F.col("request_id").isNull(), F.sequence(F.lit(0), F.lit(lanes - 1)))
    rows = events.withWatermark("at", delay).select(
        F.explode(F.coalesce(every, F.array(F.pmod(F.xxhash64("request_id"), F.lit(lanes)).cast("int")))).alias("lane"),
        F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), F.col("kind"), F.col("value").cast("string").alias("value"), F.unix_millis("at").alias("at_ms"), "at",
    )
    return rows.groupBy("lane").transformWithStateInPandas(_InFlight(wait_ms), PARTS, "Append", "EventTime")


_CHUNK = T.StructType([T.StructField("rows", T.BinaryType())])
_RECORDS = pa.schema([("side", pa.int32()), ("id", pa.int64()), ("at_ms", pa.int64()), ("headers", pa.string())])
PAIRS = T.StructType([T.StructField("their_id", T.LongType()), T.StructField("our_id", T.LongType()), T.StructField("score", T.IntegerType())])
#: Records in a chunk of state.
CHUNK = 1 << 16


def _packed(rows: pa.Table) -> list[tuple[bytes]]:
    """Records as chunks of state: one call to the store then carries many."""
    out = []
    for at in range(0, rows.num_rows, CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows.slice(at, CHUNK))
        out.append((sink.getvalue().to_pybytes(),))
    return out


class _Matched(StatefulProcessor):
    """One key: the records of both sides that have not been settled, in chunks."""

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _CHUNK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([pa.Table.from_pandas(frame[_RECORDS.names], _RECORDS, preserve_index=False) for frame in rows])
        self.waiting.appendList(_packed(new))
        _wake(self.handle, pc.min(new["at_ms"]).as_py() + 2 * self.within_ms + 1)
        yield pd.DataFrame(columns=PAIRS.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Settle theirs in order of arrival: by now all records that can take part are there."""
        until = timerValues.getCurrentWatermarkInMs() - 2 * self.within_ms - 1
        held = pa.concat_tables([pa.ipc.open_stream(x[0]).read_all() for x in self.waiting.get()])
        due = pc.less_equal(held["at_ms"], until)
        is_ours = pc.equal(held["side"], 0)
        ours = held.filter(is_ours)
        theirs = held.filter(pc.and_(pc.equal(held["side"], 1), due)).sort_by([("at_ms", "ascending"), ("id", "ascending")])
        walk = lambda t: zip(t["at_ms"].to_pylist(), t["id"].to_pylist(), t["headers"].to_pylist())
        out = [(their, our, score) for their, our, score, _ in settle(walk(theirs), walk(ours), self._score, self.within_ms, self._headers)]
        taken = pa.array([our for _, our, _ in out if our is not None], pa.int64())
        ours = ours.filter(pc.invert(pc.is_in(ours["id"], value_set=taken)))
        # ours that no later record of theirs can want any more
        gone = pc.less(ours["at_ms"], until - self.within_ms)
        out += [(None, one, None) for one in ours.filter(gone).sort_by([("at_ms", "ascending"), ("id", "ascending")])["id"].to_pylist()]
        left = pa.concat_tables([ours.filter(pc.invert(gone)), held.filter(pc.and_(pc.equal(held["side"], 1), pc.invert(due)))])
        if left.num_rows:
            self.waiting.put(_packed(left))
            _wake(self.handle, pc.min(left["at_ms"]).as_py() + 2 * self.within_ms + 1, expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.waiting.clear()
        for at in range(0, max(1, len(out)), CHUNK):
            frame = pd.DataFrame(out[at : at + CHUNK], columns=PAIRS.names)
            yield frame.astype({"their_id": "Int64", "our_id": "Int64", "score": "Int32"})

    @staticmethod
    def _headers(kind: str | None) -> list[tuple[str, Hashable]]:
        return [(n, v if isinstance(v, Hashable) else json.dumps(v)) for n, v in json.loads(kind or "{}").items()]

    @staticmethod
    def _score(ours: str | None, theirs: str | None) -> int:
        held = json.loads(ours or "{}")
        return sum(1 if held[n] == v else -1000 for n, v in json.loads(theirs or "{}").items() if n in held)

    def close(self) -> None:
        pass


def matched(records: DataFrame, on: list[str], within_ms: int = 60_000, delay: str = "0 seconds") -> DataFrame:
    """Pair records of two observers one to one: (their_id, our_id, score), as ``capture.match`` does in batches.

    ``records`` holds both sides: ``side`` (0 ours, 1 theirs), id, at, headers (a map) and the keys ``on``. A
    record is settled once the watermark is twice ``within_ms`` past it, so all that may compete for its
    partners have come; rows later than the watermark are dropped. Records without a partner go out alone.
    """
    rows = records.withWatermark("at", delay).select(*on, F.col("side").cast("int").alias("side"), F.col("id").cast("long").alias("id"), F.unix_millis("at").alias("at_ms"), F.to_json("headers").alias("headers"), "at")
    rows = rows.where(F.col("at_ms").isNotNull())
    return rows.groupBy(*on).transformWithStateInPandas(_Matched(within_ms), PAIRS, "Append", "EventTime")
