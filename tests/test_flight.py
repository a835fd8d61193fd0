"""Streams with state: exchanges in flight and the match of two observers."""

import random

from pyspark.sql import functions as F

from webstrata.operators import capture
from webstrata.streaming import flight, jobs, stores


def _batches(spark, folder, schema, *batches):
    """One file a batch, in order of their names and times."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    kind = spark.read.parquet(f"{folder}/0").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))


EVENTS = "request_id string, seq long, t long, kind string, value string"


def _flown(spark, tmp_path, wait_ms, *batches):
    stream = _batches(spark, tmp_path / "in", EVENTS, *batches).withColumn("at", F.timestamp_seconds("t"))
    out = flight.in_flight(stream, wait_ms, lanes=3)
    flight.run_stateful(out, str(tmp_path / "out"))
    return sorted((tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()), key=repr)


def test_late_halves_flush_and_timeout(spark, tmp_path):
    got = _flown(
        spark, tmp_path, 60_000,
        [("a", 1, 100, "request", "GET /"), ("a", 2, 100, "headers", "301"), ("b", 3, 100, "headers", "200"), ("c", 4, 100, "request", "GET /c"), ("f", 5, 100, "headers", "204")],
        [("a", 6, 110, "redirect", None), ("a", 7, 110, "headers", "200"), ("b", 8, 120, "complete", None), ("d", 9, 120, "request", "GET /d"), ("e", 10, 300, "request", "GET /e")],
        [("b", 11, 301, "request", "GET /b"), ("a", 12, 301, "complete", None), ("e", 13, 302, "auth", None), ("e", 14, 302, "flush", None), ("x", 15, 303, "request", "GET /x")],
        [(None, 16, 304, "flush", None), ("e", 17, 304, "complete", None)],
        [("z", 18, 900, "error", None)],
        [("z", 19, 2000, "request", "GET /z")],
    )
    # c, d and f had been quiet for a minute when the watermark, 300 s, had passed; b and z waited for their
    # request; the end of e came after it had been sent out
    assert got == sorted([
        ("a", 0, "GET /", "301", "redirect"), ("a", 1, "GET /", "200", "complete"), ("b", 0, "GET /b", "200", "complete"), ("c", 0, "GET /c", None, "timeout"), ("d", 0, "GET /d", None, "timeout"),
        ("e", 0, "GET /e", None, "auth"), ("e", 1, "GET /e", None, "flush"), ("e", 0, None, None, "timeout"), ("f", 0, None, "204", "timeout"), ("x", 0, "GET /x", None, "flush"), ("z", 0, "GET /z", None, "error"),
    ], key=repr)


def test_all_orders_of_arrival_give_the_same_parts(spark, tmp_path):
    rng = random.Random(2)
    events, want = [], []
    for k in range(60):
        name = f"r{k}"
        events += [(name, 10 * k, 10, "request", f"GET /{k}"), (name, 10 * k + 1, 10, "headers", "301"), (name, 10 * k + 2, 10, "redirect", None), (name, 10 * k + 3, 10, "headers", "200"), (name, 10 * k + 4, 10, "complete", None)]
        want += [(name, 0, f"GET /{k}", "301", "redirect"), (name, 1, f"GET /{k}", "200", "complete")]
    late = [e for e in events if e[3] == "request" and rng.random() < 0.5]
    first = [e for e in events if e not in late]
    assert _flown(spark, tmp_path, 1_000_000, first, late) == sorted(want, key=repr)


RECORDS = "k string, side int, id long, t long, headers map<string,string>"


def test_matches_are_those_of_the_batch_operator(spark, tmp_path):
    rng = random.Random(4)
    at = 0
    rows = []
    for k in range(300):
        at += rng.randrange(0, 25)
        rows.append((rng.choice("ab"), int(rng.random() < 0.6), k, at, {"X": rng.choice("12")} if rng.random() < 0.7 else {}))
    end = [("a", 0, 9000, at + 10_000, {}), ("b", 0, 9001, at + 10_000, {})]
    last = [("a", 0, 9002, at + 20_000, {}), ("a", 0, 9003, 1, {"X": "1"})]  # the second is late and dropped
    stream = _batches(spark, tmp_path / "in", RECORDS, rows[:100], rows[100:200], rows[200:], end, last).withColumn("at", F.timestamp_seconds("t"))
    out = flight.matched(stream, ["k"], within_ms=60_000)
    flight.run_stateful(out, str(tmp_path / "out"))
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    batch = spark.createDataFrame(rows, RECORDS).select("k", "side", "id", (F.col("t") * 1000).alias("at_ms"), F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("name"), F.encode(e["value"], "UTF-8").alias("value"))).alias("headers"))
    want = {tuple(r) for r in capture.match(batch.where("side = 0"), batch.where("side = 1"), ["k"], 60_000).collect()}
    assert {tuple(r) for r in got if r.their_id is not None and r.our_id is not None} == want
    paired = {i for t, o, _ in want for i in (t, o)}
    alone = {r.their_id if r.their_id is not None else r.our_id for r in got if r.their_id is None or r.our_id is None}
    assert alone - {9000, 9001, 9002} == {r[2] for r in rows} - paired
    assert len(got) == len({(r.their_id, r.our_id) for r in got}) and 9003 not in alone


def test_a_store_that_fails_twice(spark, tmp_path):
    folder, seen = str(tmp_path / "s"), []

    def one(rows, batch_id):
        seen.append((1, batch_id, sorted(r.id for r in rows.collect())))

    def two(rows, batch_id):
        if batch_id in (0, 1):
            raise OSError("no room\nat all")
        seen.append((2, batch_id, sorted(r.id for r in rows.collect())))

    schema = "id long, seq long, want long, body string"
    stream = _batches(spark, tmp_path / "in", schema, [(1, 1, 3, "a"), (2, 2, 1, "b")], [(3, 3, 2, "c"), (1, 4, 3, "a2")], [(4, 5, 3, "d")], [(5, 6, 1, "e")])
    run = stores.archiver({1: one, 2: two}, folder, max_attempts=3)
    jobs.run_batches(stream, run, str(tmp_path / "progress"))
    got = {r.id: (r.body, r.archived, r.attempts, r.state, r.reason) for r in stores.state(spark, folder, 3).collect()}
    assert got == {1: ("a2", 3, 2, "archived", "no room"), 2: ("b", 1, 0, "archived", None), 3: ("c", 2, 1, "archived", "no room"), 4: ("d", 3, 0, "archived", None), 5: ("e", 1, 0, "archived", None)}
    assert seen == [(1, 0, [1, 2]), (1, 1, []), (1, 2, [4]), (2, 2, [1, 3, 4]), (1, 3, [5]), (2, 3, [])]
    run(spark.createDataFrame([(5, 6, 1, "e")], schema), 3)  # a batch that comes again changes nothing
    assert {r.id: r.state for r in stores.state(spark, folder, 3).collect()} == dict.fromkeys(range(1, 6), "archived")
    early = {r.state: (r.rows, r.attempts) for r in stores.counters(stores.state(spark, folder, 1)).collect()}
    assert early == {"archived": (1, 0), "queued": (2, 3)}
    never = stores.archiver({2: two}, str(tmp_path / "n"), max_attempts=1)
    never(spark.createDataFrame([(9, 1, 2, "x")], schema), 0)
    assert [(r.id, r.state, r.reason) for r in stores.state(spark, str(tmp_path / "n"), 0).collect()] == [(9, "given up", "no room")]


def test_a_busy_key_is_settled_without_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flight, "CHUNK", 1000)
    rows = [("a", k % 2, k, 1000 + k % 50, {"X": str(k % 3)}) for k in range(9000)]
    end = [("a", 0, 9001, 10_000, {}), ("a", 0, 9002, 20_000, {})]
    stream = _batches(spark, tmp_path / "in", RECORDS, rows, end[:1], end[1:]).withColumn("at", F.timestamp_seconds("t"))
    out = flight.matched(stream, ["k"], within_ms=100_000)
    flight.run_stateful(out, str(tmp_path / "out"))
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect() if r.their_id is not None]
    assert len({o for _, o, _ in got}) == len({t for t, _, _ in got}) == len(got) == 4500 and all(s == 1 for _, _, s in got)
    processor = flight._Matched(1000)
    assert processor._score('{"X":"1","Y":null}', '{"X":"1","Z":"2"}') == 1 and processor._score(None, '{"X":"1"}') == 0

    class Counted(list):
        """Chunks of state: calls to the store do not grow with the records."""

        calls = 0

        def get(self):
            return iter(self)

        def put(self, rows):
            Counted.calls += len(rows)
            self[:] = rows

        appendList = put

        def clear(self):
            self[:] = []

    class Handle:
        def getListState(self, name, schema):
            return Counted()

        def listTimers(self):
            return iter([])

        def registerTimer(self, at):
            pass

    import pandas as pd

    processor.init(Handle())
    list(processor.handleInputRows(("a",), iter([pd.DataFrame([(s, i, t, "{}") for _, s, i, t, _ in rows], columns=flight._RECORDS.names)]), None))
    assert Counted.calls == 9


def test_calls_to_the_store_do_not_grow_with_the_exchanges(monkeypatch):
    import pandas as pd

    class Counted(dict):
        calls = 0

        def containsKey(self, key):
            Counted.calls += 1
            return key in self

        def getValue(self, key):
            Counted.calls += 1
            return self[key]

        def updateValue(self, key, value):
            Counted.calls += 1
            self[key] = value

        def removeKey(self, key):
            Counted.calls += 1
            del self[key]

        def iterator(self):
            return iter(list(self.items()))

        keys = None

    class Handle:
        def getMapState(self, name, key, value):
            return Counted()

        def getListState(self, name, schema):
            class Empty:
                get = staticmethod(lambda: iter([]))
                clear = staticmethod(lambda: None)

            return Empty()

        def listTimers(self):
            return iter([])

        def registerTimer(self, at):
            pass

    lane = flight._InFlight(1000)
    lane.init(Handle())
    columns = ["request_id", "seq", "kind", "value", "at_ms"]
    first = pd.DataFrame([(f"r{k}", k, "request", "GET /", 5) for k in range(5000)], columns=columns)
    second = pd.DataFrame([(f"r{k}", 5000 + k, "complete", None, 6) for k in range(4000)] + [(None, 9999, "flush", None, 7)], columns=columns)
    assert sum(map(len, lane.handleInputRows((0,), iter([first]), None))) == 0
    out = pd.concat(list(lane.handleInputRows((0,), iter([second]), None)))
    assert out["ended"].value_counts().to_dict() == {"complete": 4000, "flush": 1000} and not lane.open
    assert Counted.calls <= 6 * flight.BUCKETS
