"""Pipe expressions, templates, scrubbing, and plans that are carried out."""

import gzip

import pytest
from pyspark.sql import functions as F

from webstrata.functions import pipes, scrub
from webstrata.operators import layout, links, versions
from webstrata.plans import runtime
from webstrata.sources import sinks, wrr
from webstrata.streaming import jobs


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "ab/c d?x=1", bytearray(b"\x01\x02"), ["a", "b", "c"], 5), (2, None, None, None, None)]
    return spark.createDataFrame(data, "id long, text string, raw binary, parts array<string>, n long")


CASES = [
    ("text", "ab/c d?x=1", None),
    ("text|missing", False, True),
    ("text|es", "ab/c d?x=1", ""),
    ("text|not", False, True),
    ("parts|len", 3, None),
    ("raw|eb|len", 2, 0),
    ("raw|to_hex", "0102", None),
    ("text|take_prefix 2|add_prefix '<|'", "<|ab", None),
    ("parts|take_suffix 2|len", 2, None),
    ("text|replace / :", "ab:c d?x=1", None),
    ("text|quote ''", "ab%2Fc%20d%3Fx%3D1", None),
    ("text|~= 'ab'", True, None),
    ("n|>= 5", True, None),
    ("n|str|add_suffix !", "5!", None),
    ("text|bool", True, None),
    ("n|0|== 0", False, True),
    ("text|echo x", "x", "x"),
    ("text|parse_path|unparse_path", "ab/c%20d%3Fx%3D1", None),
    ("text|abbrev 4", "ab=1", None),
]


@pytest.mark.parametrize("text, first, second", CASES)
def test_pipes(rows, text, first, second):
    got = [r.v for r in rows.select("id", pipes.compile_pipe(rows, text).alias("v")).orderBy("id").collect()]
    assert got == [first, second]


@pytest.mark.parametrize("text", ["nothing", "text|add_prefix", "text|len 3", "n|len", "n|== x", "parts|== a", "parts|int", "text|take_prefix x"])
def test_bad_pipes(rows, text):
    with pytest.raises(pipes.PipeError):
        pipes.compile_pipe(rows, text)


def test_conditions_and_templates(rows):
    assert pipes.get(rows.where("id = 1"), "n", "text|len") == (5, 10)
    assert [r.id for r in rows.where(pipes.condition(rows, ["n|0|< 3"])).collect()] == [2]
    assert [r.id for r in rows.where(pipes.condition(rows, [], ["n|> 4", "text|missing"])).orderBy("id").collect()] == [1, 2]
    with pytest.raises(pipes.PipeError):
        pipes.condition(rows, ["n"])
    made = rows.where("id = 1").select(pipes.compile_template(rows, "%(n)03d-%(text|take_prefix 2)s-%(num)d%%").alias("p")).first().p
    assert made == "005-ab-{num}%"
    with pytest.raises(pipes.PipeError):
        pipes.compile_template(rows, "%(n)q")


PAGE = "https://a.example/dir/page.html"


def scrub_one(text, options="defaults", remap=None, kind="html"):
    return getattr(scrub.Scrubber(PAGE, remap or {}, scrub.Options.parse(options)), kind)(text)


def test_scrub_html():
    known = {"https://a.example/b": "../b.htm", "https://a.example/i.png": "i.png"}
    assert scrub_one('<a href="/b#x">t</a><a href="c" ping="/p" onclick="go()">u</a>', remap=known) == '<a href="../b.htm#x">t</a><a href="https://a.example/dir/c">u</a>'
    assert scrub_one('<a href="c">u</a>', "/jumps") == '<a href="javascript:void(0)">u</a>'
    assert scrub_one('<img src=/i.png srcset="/i.png 2x, /j.png">', remap=known) == '<img src="i.png" srcset="i.png 2x, data:text/plain,%20">'
    assert scrub_one("<script>1<2</script>x", "-verbose") == "x"
    assert scrub_one("<script>1<2</script>x", "+scripts") == "<script>1<2</script>x"
    assert scrub_one("<noscript><p>shown</p></noscript>") == "<p>shown</p>"
    assert scrub_one('<meta http-equiv="Refresh" content="1"><link rel=preload href=/x>', "-verbose") == ""
    assert scrub_one('<base href="https://b.example/q/"><a href="r">t</a>') == '<a href="https://b.example/q/r">t</a>'
    assert scrub_one(f'<a href="{PAGE}#here">t</a><a href="mailto:x@y">m</a>') == '<a href="#here">t</a><a href="mailto:x@y">m</a>'
    assert scrub_one("<!--[if IE 6]>x<![endif]--><!-- kept -->") == "<!-- kept -->"
    assert scrub_one('<style>p{background:url(i.png)}</style>', remap={"https://a.example/dir/i.png": "i2.png"}) == '<style>p{background:url("i2.png")}</style>'
    with pytest.raises(ValueError):
        scrub.Options.parse("+nothing")


def test_scrub_css():
    assert scrub_one('@import "x.css";@import url(y.css) screen;p{background:url(\'z.png\')}', "*reqs", kind="css") == '@import "https://a.example/dir/x.css";@import "https://a.example/dir/y.css" screen;p{background:url("https://a.example/dir/z.png")}'


def test_relative_addresses(spark):
    pairs = [("a/b/c.htm", "a/d.htm", "../d.htm"), ("a/b.htm", "a/c.htm?x", "c.htm%3Fx"), ("x.htm", "y/z.htm", "y/z.htm"), ("a/x.htm", "a/x.htm", "x.htm"), ("a/b/x.htm", "c/y.htm", "../../c/y.htm")]
    df = spark.createDataFrame(pairs, "s string, t string, want string")
    assert all(r.got == r.want for r in df.select("want", links.relative(F.col("s"), F.col("t")).alias("got")).collect())


def test_plans_are_carried_out(spark, tmp_path):
    plan = spark.createDataFrame([("a/b.txt", "write", "one"), ("c.txt", "noop", "two"), ("d.txt", "replace", "three")], "path string, action string, text string")
    done = {r.path: r.done for r in layout.carry_out(plan, "text", str(tmp_path)).collect()}
    assert done == {"a/b.txt": True, "c.txt": False, "d.txt": True}
    assert (tmp_path / "a/b.txt").read_text() == "one" and not (tmp_path / "c.txt").exists() and len(list(tmp_path.rglob("*"))) == 3


def test_bundle_files_and_lists(spark, tmp_path):
    dumps = spark.createDataFrame([("x", 0, 0, 2, bytearray(b"b")), ("x", 0, 0, 1, bytearray(gzip.compress(b"a"))), ("x", 0, 1, 3, bytearray(b"c"))], "bucket string, lane long, bundle long, seq long, dump binary")
    made = {r.path: r.rows for r in sinks.write_bundle_files(dumps, str(tmp_path)).collect()}
    assert sorted(made.values()) == [1, 2] and gzip.decompress((tmp_path / "x/0_0.wrrb").read_bytes()) == b"ab"
    assert wrr.listed(b"a\0b c\0") == ["a", "b c"]
    with pytest.raises(ValueError):
        wrr.listed(b"a")


def test_cbor_and_python_rows(rows):
    one = sinks.cbor_rows(rows.where("id = 1"), F.col("id"), F.col("text"), F.col("raw"), F.col("parts")).first().value
    assert wrr.decode(bytes(one))[0] == [1, "ab/c d?x=1", b"\x01\x02", ["a", "b", "c"]]
    assert wrr.decode(sinks.cbor_stream([bytes(one)]))[0] == [[1, "ab/c d?x=1", b"\x01\x02", ["a", "b", "c"]]]
    assert rows.where("id = 1").select(sinks.python_rows(F.col("text"), F.lit("it's")).alias("v")).first().v == "['ab/c d?x=1', 'it\\'s']"


def test_nearest_join_in_slots(spark, monkeypatch):
    """A key with many rows is cut into slots; the result is that of all pairs."""
    import random

    rng = random.Random(3)
    at = lambda: 1_700_000_000 + rng.randrange(50_000)
    left = [(k, rng.choice("aab"), at()) for k in range(400)] + [(1000, "none", at())]
    right = [(k, rng.choice("aaab"), at()) for k in range(300)]
    l = spark.createDataFrame(left, "id long, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    r = spark.createDataFrame(right, "rid long, k string, t long").withColumn("rt", F.timestamp_seconds("t")).drop("t")
    want = {i: min(((abs(t - t2), t2, r2) for r2, k2, t2 in right if k2 == k), default=(0, 0, None))[2] for i, k, t in left}
    for hot in (5000, 40):
        monkeypatch.setattr(runtime, "HOT_ROWS", hot)
        got = {x.id: x.match and x.match.rid for x in versions.nearest_join(l, r, ["k"], "t", "rt", "rid", "id", how="left").collect()}
        assert got == want


def test_in_flight_events(spark, tmp_path):
    events = [("a", 1, "request", "GET /"), ("a", 2, "headers", "301"), ("a", 3, "redirect", None), ("a", 4, "headers", "200"), ("a", 5, "complete", None), ("b", 6, "request", "GET /b"), ("b", 7, "error", None)]
    spark.createDataFrame(events, "rid string, seq long, kind string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.in_flight(jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet"), "rid")
    jobs.run_now(stream, str(tmp_path / "out"), timeouts=True)
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, "GET /", "301", "redirect"), ("a", 1, "GET /", "200", "complete"), ("b", 0, "GET /b", None, "error")]


def test_streams_match(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 100), ("y", 2, 200), ("x", 3, 1000)], "k string, id long, t long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    rows.write.parquet(str(tmp_path / "a"))
    rows.withColumn("id", F.col("id") + 10).write.parquet(str(tmp_path / "b"))
    stream = jobs.matched(jobs.table_stream(spark, str(tmp_path / "a"), "*.parquet", 10), jobs.table_stream(spark, str(tmp_path / "b"), "*.parquet", 10), ["k"])
    jobs.run_now(stream, str(tmp_path / "out"))
    assert sorted((r.our_id, r.their_id) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()) == [(1, 11), (2, 12), (3, 13)]
