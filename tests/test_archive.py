"""Archive files, layout plans, capture logs, links and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from webstrata.operators import capture, filters, layout, links, versions
from webstrata.sources import sinks, wrr
from webstrata.streaming import jobs


def value(url="http://example.org/", body=b"hi", at=1000, response=True):
    rs = [at, 200, "OK", [["Content-Type", b"text/html"]], True, body] if response else None
    return [wrr.MAGIC, "test/1", "HTTP/1.1", [0, "GET", url, [], True, b""], rs, 2000, {"document_url": "http://d/", "websocket": [[5, True, 1, b"ping"]]}]


def test_codec():
    for v in (value(), value(response=False), [1, -5, 2.5, None, True, "ü", b"\0", {"a": [1 << 40]}]):
        raw = wrr.encode(v)
        assert wrr.decode(raw) == (v, len(raw))
    with pytest.raises((ValueError, IndexError)):
        wrr.decode(wrr.encode(value())[:-3])


def put(folder, name, data):
    (folder / name).write_bytes(data)


def test_read_and_write(spark, tmp_path):
    one = wrr.encode(value())
    put(tmp_path, "a.wrr", one)
    put(tmp_path, "b.wrr", gzip.compress(one))
    put(tmp_path, "c.wrrb", one + wrr.encode(value("http://example.org/2", body="text")) + wrr.encode(value(response=False)))
    put(tmp_path, "empty.wrrb", b"")
    put(tmp_path, "half.wrr.part", b"junk")
    rows = wrr.read(spark, str(tmp_path)).collect()
    assert sorted((r.source_path.rsplit("/")[-1], r.element_num) for r in rows) == [("a.wrr", None), ("b.wrr", None), ("c.wrrb", 0), ("c.wrrb", 1), ("c.wrrb", 2)]
    assert rows[0].extra == {"document_url": "http://d/"} and bytes(rows[0].websocket[0].content) == b"ping"
    text = [r for r in rows if r.request.url.endswith("2")][0]
    assert text.response.body_is_text and bytes(text.response.body) == b"text"
    dumped = wrr.dumps(wrr.read(spark, str(tmp_path / "a.wrr")), "source_path").first().dump
    assert wrr.decode(gzip.decompress(dumped) if dumped[:2] == b"\x1f\x8b" else bytes(dumped))[0] == value()


@pytest.mark.parametrize(
    "name,data",
    [("x.wrr", gzip.compress(b"")), ("x.wrr", wrr.encode(value()) + b"\0"), ("x.wrr", wrr.encode([1])), ("x.wrr", wrr.encode(value("file:///etc"))), ("x.wrr", wrr.encode(value(at="soon")))],
)
def test_bad_files(spark, tmp_path, name, data):
    put(tmp_path, name, data)
    assert wrr.read(spark, str(tmp_path), errors="ignore").count() == 0
    assert wrr.read(spark, str(tmp_path), errors="skip").first().error
    with pytest.raises(Exception, match="cannot load"):
        wrr.read(spark, str(tmp_path)).collect()


def test_some_loader(spark, tmp_path):
    put(tmp_path, "x.wrrb", wrr.encode(value()))
    assert wrr.read(spark, str(tmp_path), loader="some").first().element_num is None


def test_sinks(spark, tmp_path):
    put(tmp_path, "a.wrr", wrr.encode(value()))
    rows = wrr.read(spark, str(tmp_path / "a.wrr"))
    sinks.write_raw(rows, str(tmp_path / "raw"), F.col("request.method"), F.col("response.body"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "raw")).collect()) == ["GET", "hi"]
    assert rows.select(sinks.json_rows(F.col("request.method"), F.col("response.body"))).first()[0] == '["GET","hi"]'
    assert "request: GET http://example.org/" in sinks.describe(rows).first().value


def visits_frame(spark):
    return spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", "x"), (2, "a", "2024-01-03 00:00:00", "y"), (3, "a", "2024-01-03 00:00:00", "z"), (4, "b", "2024-01-02 00:00:00", "x")], "seq long, net_url string, stime string, sha256 string").withColumn("stime", F.col("stime").cast("timestamp"))


def test_versions(spark):
    from datetime import datetime

    v = visits_frame(spark)
    pick = lambda df: sorted((r.net_url, r.seq) for r in df.collect())
    assert pick(versions.keep_latest(v, ["net_url"], "stime", "seq")) == [("a", 3), ("b", 4)]
    assert pick(versions.keep_oldest(v, ["net_url"], "stime", "seq")) == [("a", 1), ("b", 4)]
    assert pick(versions.keep_nearest(v, ["net_url"], "stime", "seq", datetime(2024, 1, 2))) == [("a", 1), ("b", 4)]  # tie: the earlier
    assert pick(versions.replay(v, "latest", "a")) == [("a", 3)] or pick(versions.replay(v, "latest", "a")) == [("a", 2)]
    row = versions.replay(v, "2024-01-03 00:00:00", "a").first()
    assert (row.seq, row.exact) == (2, True)
    assert not versions.replay(v, "2024-01", "a").first().exact
    assert {r.net_url for r in versions.replay(v, "*", "?").collect()} == {"a", "b"}
    parts = versions.keep_latest(versions.keep_latest(v.where("seq < 3"), ["net_url"], "stime", "seq").unionByName(v.where("seq >= 3")), ["net_url"], "stime", "seq")
    assert pick(parts) == pick(versions.keep_latest(v, ["net_url"], "stime", "seq"))  # by pieces as at once


def test_plan_is_idempotent(spark):
    v = visits_frame(spark).withColumn("path", F.col("net_url")).withColumn("stime_ms", F.unix_millis("stime"))
    first = layout.plan(v, mode="latest")
    assert {r.action for r in first.collect()} == {"write"}
    again = layout.plan(v, first.select("path", "sha256", "stime_ms"), mode="latest")
    assert {r.action for r in again.collect()} == {"noop"}
    assert {(r.path, r.action) for r in layout.plan(v, mode="error").collect()} == {("a", "conflict"), ("b", "write")}
    with pytest.raises(ValueError):
        layout.check_mode("latest", "copy")


def test_templates(spark):
    frame = spark.createDataFrame([(["view"], "?", "one=1&two=2", "one=1", ".htm")], "filepath_parts array<string>, oqm string, mq_query string, mq_nquery string, filepath_ext string")
    fixed = {"scheme": "https", "hostname": "example.org", "rhostname": "org.example", "netloc": "example.org", "mq_npath": "view", "net_url": "https://example.org/view?one=1", "method": "GET", "status": "C200C", "qtime_ms": "0", "syear": 1970, "smonth": 1, "sday": 1, "shour": 0, "sminute": 16, "ssecond": 40, "stime_msq": 0, "stime_ms": 1000000}
    frame = frame.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    get = lambda alias: frame.select(layout.template(alias)).first()[0]
    tag = __import__("hashlib").sha256(fixed["net_url"].encode()).hexdigest()[:4]
    assert get("default") == f"1970/01/01/001640000_0_GET_{tag}_C200C_example.org_{{num}}"
    assert get("short") == "1970/01/01/1000000_0_{num}"
    assert get("surl_msn") == "https/example.org/view?one=1&two=2__GET_C200C_{num}"
    assert get("shupq") == "https/example.org/view?one=1&two=2.htm"
    assert get("rhupnq_mhs") == f"org.example/view?one=1.GET_{tag}_C200C.htm"
    assert get("flat_mstn") == "example.org/view?one=1.GET_C200C_1970-01-01_001640000_{num}.htm"
    with pytest.raises(ValueError):
        layout.template("nonsense")


def test_matching_is_one_to_one(spark):
    heads = lambda *x: [(k, v) for k, v in x]
    schema = "tab long, id long, at_ms long, headers array<struct<name:string,value:string>>"
    ours = spark.createDataFrame([(1, 10, 0, heads(("a", "1"))), (1, 11, 50, heads(("a", "2")))], schema)
    theirs = spark.createDataFrame([(1, 20, 40, heads(("A", "1"))), (1, 21, 45, heads(("A", "1"))), (2, 22, 45, heads())], schema)
    got = {(r.their_id, r.our_id) for r in capture.match(ours, theirs, ["tab"]).collect()}
    assert got == {(20, 10), (21, 11)}


def test_halves_and_headers(spark):
    frame = spark.createDataFrame([(1, "x", None), (1, None, "y"), (2, "z", None)], "request_id long, a string, b string")
    assert {tuple(r) for r in capture.halves(frame).collect()} == {(1, "x", "y"), (2, "z", None)}


def test_filter_metrics(spark):
    from pyspark.sql import Observation

    frame = spark.range(10)
    seen = Observation("use")
    kept = frame.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") >= 0).alias("clause_0"), F.count_if(F.col("id") > 5).alias("clause_1")).where("id > 5")
    assert kept.count() == 4 and filters.redundant(seen.get) == ["clause_0"]
    assert filters.apply(frame, filters.text(F.col("id").cast("string"), exact=["3"]), name="n").count() == 1


def test_link_extraction(spark):
    page = """<base href="/deep/"><script>var x = '<a href="no">';</script><!-- <a href="no"> --><A HREF='a?x=1&amp;y=2#z'>t</A><img src=i.png srcset="s1.png 2x, s2.png"><link rel="icon stylesheet" href="//cdn.e/x.css">
    <form action="post"><a href="mailto:me">m</a>"""
    rows = links.extract(spark.createDataFrame([("http://e.org/p/q", page)], "url string, html string")).collect()
    assert {(r.tag, r.kind, r.target) for r in rows} == {
        ("a", "jump", "http://e.org/deep/a?x=1&y=2"), ("img", "requisite", "http://e.org/deep/i.png"), ("img", "requisite", "http://e.org/deep/s1.png"), ("img", "requisite", "http://e.org/deep/s2.png"),
        ("link", "requisite", "http://cdn.e/x.css"), ("form", "action", "http://e.org/deep/post"), ("a", "jump", None),
    }


def test_traversal_takes_requisites_for_free(spark):
    edges = spark.createDataFrame([("r", "a", "jump"), ("a", "b", "jump"), ("a", "img", "requisite"), ("img", "sub", "requisite"), ("sub", "a", "requisite")], "src string, dst string, kind string")
    roots = spark.createDataFrame([("r",)], "url string")
    assert {tuple(r) for r in links.within(roots, edges, 1).collect()} == {("r", 0), ("a", 1), ("img", 1), ("sub", 1)}
    assert {tuple(r) for r in links.within(roots, edges, 0).collect()} == {("r", 0)}


def test_assembly_of_halves_in_a_stream(spark, tmp_path):
    schema = "id string, a string, b string"
    spark.createDataFrame([("1", "x", None), ("2", None, "q"), ("1", None, "y"), ("2", "p", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.run_now(jobs.assembled(stream, "id", ["a", "b"]), str(tmp_path / "out"), timeouts=True)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", "x", "y", True), ("2", "p", "q", True)}


def test_fan_out_goes_on_after_a_failure(spark):
    done, failed = [], []

    def broken(batch, _):
        raise RuntimeError("store is full")

    run = jobs.archive_to({1: broken, 4: lambda b, _: done.extend(r.id for r in b.collect())}, lambda b, _: failed.extend((r.id, r.reason) for r in b.collect()))
    run(spark.createDataFrame([(1, 0), (2, 5)], "id long, archived int"), 0)
    assert done == [1] and failed == [(1, "store is full")]
