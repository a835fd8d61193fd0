"""Functions that no query uses: each in a small case."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webstrata.functions import http, mime, pipes, scrub, urls
from webstrata.operators import capture, filters, layout, links, versions
from webstrata.sources import sinks, wrr
from webstrata.streaming import jobs


def value(spark, column, **named):
    df = spark.createDataFrame([tuple(named.values()) or (1,)], list(named) or ["one"])
    return df.select(column.alias("v")).first().v


def heads(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("binary").alias("value")) for n, v in pairs])


@pytest.mark.parametrize("stated, at, want", [("HTTP/2.0", None, "HTTP/2.0"), (None, "HTTP/1.1 200 OK", "HTTP/1.1"), (None, "odd", "HTTP/2.0")])
def test_protocols(spark, stated, at, want):
    found = capture.protocol(F.lit(stated).cast("string"), F.lit(at).cast("string"), heads((":Authority", "a")))
    assert value(spark, found) == want
    assert value(spark, capture.protocol(F.lit(None).cast("string"), F.lit("x"), heads(("Host", "a")))) == "HTTP/1.0"


def test_headers_of_two_records(spark):
    both = capture.merged_headers(heads(("A", "1"), ("B", "2")), heads(("a", "1"), ("B", "3")))
    assert value(spark, F.transform(both, lambda h: F.concat(h["name"], F.lit("="), h["value"].cast("string")))) == ["A=1", "B=2", "B=3"]


def test_forms(spark):
    form = F.array(F.struct(F.lit("a b").alias("name"), F.lit("x&y").alias("value")), F.struct(F.lit('q"').alias("name"), F.lit("é").alias("value")))
    assert value(spark, capture.form_body(form)) == "a+b=x%26y&q%22=%C3%A9"
    assert value(spark, capture.multipart_body(form, F.lit("--x"))) == '----x\r\nContent-Disposition: form-data; name="a b"\r\n\r\nx&y\r\n----x\r\nContent-Disposition: form-data; name="q%22"\r\n\r\né\r\n----x--\r\n'


def test_limbo_and_stores(spark):
    rows = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "id long, in_limbo boolean")
    commands = spark.createDataFrame([(1, "collect", 1), (2, "collect", 1), (2, "discard", 2), (4, "discard", 1)], "id long, command string, seq long")
    assert {r.id: r.fate for r in capture.release(rows, commands).collect()} == {1: "collected", 2: "discarded", 3: "held", 4: "collected"}
    kind = "id long, want int"
    moves = capture.store_moves(spark.createDataFrame([(1, 1), (2, 3), (3, 1)], kind), spark.createDataFrame([(1, 3), (2, 1), (4, 4)], kind))
    assert {r.id: (r.had, r.want, r.move) for r in moves.collect()} == {1: (1, 3, "do"), 2: (3, 1, "undo"), 3: (1, 0, "undo"), 4: (0, 4, "do")}
    failures = spark.createDataFrame([(1, 2, True), (1, 2, True), (2, 4, False)], "id long, store int, recoverable boolean")
    assert [(r.id, r.store) for r in jobs.retried(failures, rows).collect()] == [(1, 2)]


def test_filters(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), "about:blank", "C200C"), (2, datetime(2024, 2, 1), "http://own/x", "C301C"), (3, None, "http://a/", "C404C")], "id long, t timestamp_ntz, url string, status string")
    ids = lambda clause: {r.id for r in rows.where(clause).collect()}
    assert ids(filters.not_after(F.col("t"), "2024-01-15", "2024-03")) == {1, 3}
    assert ids(filters.boring_url(F.col("url"), "http://own/")) == {1, 2} and ids(filters.boring_url(F.col("url"))) == {1}
    assert ids(filters.default_inputs(F.col("status"))) == {1, 2} and ids(filters.default_inputs(F.col("status"), ".404C")) == {1, 2, 3} and ids(filters.default_roots(F.col("status"))) == {1}
    assert ids(filters.mime_type(F.lit("text/javascript"), exact=["application/javascript"])) == {1, 2, 3} and ids(filters.mime_type(F.lit("image/png"), prefix=["text/"])) == set()
    assert value(spark, filters.header_lines(heads(("A", "1\n2"), ("B", "3")))) == ["A: 1", "A: 2", "B: 3"]
    assert value(spark, F.length(filters.body_text(F.lit(bytearray(b"\xff\x00a")))[0])) == 3
    log = spark.createDataFrame([(1, 7, "GET", "http://a/x", True, 5), (2, 7, "POST", "http://a/y", False, 1)], "session_id long, tab_id long, method string, url string, picked boolean, archived int")
    picked = lambda **by: {r.session_id for r in log.where(filters.rows(**by)).collect()}
    assert picked() == {1, 2} and picked(tab=7, method="GET") == {1} and picked(flags={"picked": False}) == {2} and picked(stores={4: True, 2: False}) == {1} and picked(url_has="/y") == {2} and picked(url_matches="http://./x") == {1} and picked(session=2, url_is="http://a/x") == set()


def test_versions(spark):
    rows = spark.createDataFrame([(1, "u", datetime(2024, 1, 2), 2), (2, "u", datetime(2024, 1, 1), 3), (3, "v", datetime(2024, 1, 1), 1)], "id long, net_url string, stime timestamp_ntz, seq long")
    assert {r.id for r in versions.keep_last_arrival(rows, ["net_url"], "seq").collect()} == {2, 3}
    named = rows.withColumn("rhostname", F.lit("h")).withColumn("pretty_net_url", F.when(F.col("id") == 3, "http://a/x y").otherwise("http://b/x"))
    assert [r.id for r in versions.by_place(named).collect()][0] == 3
    assert {r.net_url for r in versions.suggestions(named, "http://a/x y/").collect()} == {"v"} and {r.net_url for r in versions.suggestions(named, "*://b/*").collect()} == {"u"}
    sent = versions.replay_location(versions.replay(rows, "2024-01", "u"))
    assert [(r.id, r.location) for r in sent.collect()] == [(1, "/web/2024-01-02_00:00:00.000/u")]


def test_layout(spark):
    docs = spark.createDataFrame([("a", ".txt"), ("a", ".txt"), ("b", ".txt")], "content string, extension string")
    kept = layout.with_content(layout.content_store(docs), docs)
    assert {(r.content, r.uses) for r in kept.collect()} == {("a", 2), ("b", 1)}
    assert value(spark, layout.landing_path(F.lit("x"), F.lit(86400), F.lit(9), F.lit(3))) == "x/1970/01/02/86400_9_3.wrr"
    one, other = (value(spark, layout.request_id(F.lit("GET"), F.lit("u"), F.lit(b).cast("binary"))) for b in (None, "x"))
    assert one.startswith("GET u ") and one != other and one == value(spark, layout.request_id(F.lit("GET"), F.lit("u"), F.lit("").cast("binary")))


def test_types_and_sizes(spark):
    sniff = lambda *h: value(spark, mime.may_sniff(heads(*h)))
    assert sniff(("X-Content-Type-Options", "NoSniff ")) is False and sniff(("X-Content-Type-Options", "x")) is True and sniff(("A", "b")) is True
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    assert value(spark, mime.expected(names("text/css", "image/png"), names("image/jpeg", "image/png", "text/css"))) == ["image/png", "text/css"]
    assert [value(spark, http.human_count(F.lit(n))) for n in (999, 1500, 2_000_000)] == ["999", "1.5K", "2.0M"]
    assert [value(spark, http.human_bytes(F.lit(n))) for n in (1023, 1536, 3 << 30)] == ["1023B", "1.5KiB", "3.0GiB"]
    assert value(spark, http.unparse_srcset(http.srcset(F.lit("/aa.png 2x, /bb.png")))) == "/aa.png 2x, /bb.png"
    p = urls.parts(F.lit("http://a/b#c"))
    assert value(spark, urls.with_fragment(urls.net_url(p), p)) == "http://a/b#c"


def test_rels_and_options(spark):
    rels = lambda text: value(spark, links.only_preloads(F.lit(text)))
    assert rels("preload  Prefetch") is True and rels("preload stylesheet") is False and rels(" ") is False
    assert scrub.banned_kinds(scrub.Options()) == ["javascript", "dyndoc"] and scrub.banned_kinds(scrub.Options(scripts=True, unknown=False)) == ["unknown"]
    meta = value(spark, scrub.header_meta(heads(("Refresh", '1;url="x"&y'), ("Server", "s"), ("Link", "<a>"))))
    assert meta == '<meta http-equiv="Refresh" content="1;url=&quot;x&quot;&amp;y"><meta http-equiv="Link" content="<a>">'
    put = lambda page: value(spark, scrub.with_meta(F.lit(page), F.lit("<m>")))
    assert put("<html><HEAD a=b><x>") == "<html><HEAD a=b><m><x>" and put("<header>x") == "<m><header>x" and value(spark, scrub.with_meta(F.lit("<head>"), F.lit(None).cast("string"))) == "<head>"


def test_own_atoms(spark):
    rows = spark.createDataFrame([("ab",)], "text string")
    pipes.register_atom("twice", 1, lambda v, t, a: F.concat(v, F.lit(a), v))
    try:
        assert rows.select(pipes.compile_pipe(rows, "text|twice -").alias("v")).first().v == "ab-ab"
    finally:
        del pipes.ATOMS["twice"]


def test_inputs_and_outputs(spark, tmp_path):
    a, b = (spark.createDataFrame(rows, "source_path string, n int") for rows in ([("x", 1), ("y", 1)], [("y", 2), ("z", 2), ("z", 3)]))
    assert sorted((r.source_path, r.n) for r in wrr.union(a, b).collect()) == [("x", 1), ("y", 1), ("z", 2), ("z", 3)]
    (tmp_path / "f.txt").write_text("t")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f.txt")).select(F.col("path").alias("source_path"), F.col("modificationTime").alias("modified"))
    assert wrr.unchanged(spark, files, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="has changed"):
        wrr.unchanged(spark, files.withColumn("modified", F.lit(datetime(2020, 1, 1)).cast("timestamp")), str(tmp_path)).collect()
    sinks.write_json(a, str(tmp_path / "json"), F.col("source_path"), F.col("n"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect()) == ['["x","1"]', '["y","1"]'] or sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect()) == ['["x",1]', '["y",1]']
    sinks.write_paths(a, str(tmp_path / "paths"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "paths")).collect()) == ["x", "y"]
    sinks.write_bundles(spark.createDataFrame([("k", 0, 1, bytearray(b"d"))], "bucket string, bundle long, seq long, dump binary"), str(tmp_path / "bundles"))
    assert [(r.bucket, bytes(r.dump)) for r in spark.read.parquet(str(tmp_path / "bundles")).collect()] == [("k", b"d")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wrr").write_bytes(b"1")
    (tmp_path / "in/b.wrr.part").write_bytes(b"2")
    jobs.run_now(jobs.dump_stream(spark, str(tmp_path / "in")).select("path"), str(tmp_path / "out"))
    assert [r.path.rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.wrr"]
