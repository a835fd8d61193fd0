import pytest
from pyspark.sql import functions as F

from webstrata.functions import urls

FORMS = [
    ("http://example.org", "http://example.org/", "http://example.org/", "http://example.org/"),
    ("http://example.org#hash", "http://example.org/", "http://example.org/", "http://example.org/"),
    ("http://%20example.org/", "http://example.org/", "http://example.org/", "http://example.org/"),
    ("http://example.org/one+two#hash", "http://example.org/one%2Btwo", "http://example.org/one+two", "http://example.org/one+two"),
    (
        "http://example.org/web/2/http://archived.example.org/one+two#hash",
        "http://example.org/web/2/http://archived.example.org/one%2Btwo",
        "http://example.org/web/2/http://archived.example.org/one+two",
        "http://example.org/web/2/http:/archived.example.org/one+two",
    ),
    ("http://example.org/unfinished/query?", "http://example.org/unfinished/query?", "http://example.org/unfinished/query?", "http://example.org/unfinished/query?"),
    ("http://example.org/a?param=0&param=", "http://example.org/a?param=0&param=", "http://example.org/a?param=0&param=", "http://example.org/a?param=0"),
    ("http://example.org/a?param", "http://example.org/a?param", "http://example.org/a?param", "http://example.org/a?"),
]


@pytest.mark.parametrize("raw,net,pretty,normal", FORMS)
def test_forms(spark, raw, net, pretty, normal):
    p = urls.parts(F.col("u"))
    row = spark.createDataFrame([(raw,)], "u string").select(p.alias("p")).select(urls.net_url(F.col("p")).alias("a"), urls.pretty_net_url(F.col("p")).alias("b"), urls.pretty_net_nurl(F.col("p")).alias("c")).first()
    assert (row.a, row.b, row.c) == (net, pretty, normal)


def test_parts(spark):
    row = spark.createDataFrame([("https://us%20er:pa@[::1]:8080/a/./b/../c?x=1&y&z=#f",)], "u string").select(urls.parts(F.col("u")).alias("p")).first().p
    assert (row.scheme, row.user, row.password, row.hostname, row.port, row.raw_path, row.oqm, row.raw_query, row.ofm, row.fragment) == ("https", "us%20er", "pa", "::1", "8080", "/a/./b/../c", "?", "x=1&y&z=", "#", "f")


def test_npath_and_query(spark):
    frame = spark.createDataFrame([("//first/./skipped/../second/", "a&b=&c=%20x+y;d=1")], "p string, q string")
    row = frame.select(urls.npath_parts(F.col("p")).alias("n"), urls.query_parts(F.col("q")).alias("q"), urls.unparse_query(urls.query_parts(F.col("q"))).alias("back")).first()
    assert row.n == ["first", "second"]
    assert [(x.k, x.v) for x in row.q] == [("a", None), ("b", ""), ("c", " x y"), ("d", "1")]
    assert row.back == "a&b=&c=+x+y&d=1"


@pytest.mark.parametrize("text", ["a b/ü~*", "100%", "%zz%41", "x+y", "", "-_.~!"])
def test_quote_like_the_standard_library(spark, text):
    from urllib.parse import quote, quote_plus, unquote

    row = spark.createDataFrame([(text,)], "t string").select(urls.quote(F.col("t")).alias("q"), urls.quote(F.col("t"), "", plus=True).alias("qp"), urls.quote(F.col("t"), "%:").alias("qs"), urls.unquote(F.col("t")).alias("u")).first()
    assert (row.q, row.qp, row.qs, row.u) == (quote(text), quote_plus(text), quote(text, safe="%:"), unquote(text))


def test_idn(spark):
    frame = spark.createDataFrame([("bücher.example",), ("plain.example",), (None,)], "h string")
    assert [r[0] for r in frame.select(urls.idn_host("h")).collect()] == ["xn--bcher-kva.example", "plain.example", None]


@pytest.mark.parametrize(
    "url,exts,want",
    [
        ("http://h/", [".htm", ".html"], (["index"], ".htm")),
        ("http://h/index.html", [".htm", ".html"], (["index"], ".html")),
        ("http://h/test", [".htm"], (["test", "index"], ".htm")),
        ("http://h/test.data", [".htm"], (["test.data"], ".htm")),
        ("http://h/test.data", [], (["test"], ".data")),
        ("http://h/test.data", [".txt"], (["test.data"], ".txt")),
    ],
)
def test_file_parts(spark, url, exts, want):
    frame = spark.createDataFrame([(url, exts)], "u string, e array<string>").withColumn("p", urls.parts(F.col("u")))
    row = frame.select(urls.file_parts(F.col("p"), F.col("e")).alias("f")).first().f
    assert (row.parts, row.ext) == want


@pytest.mark.parametrize(
    "base,link,want",
    [
        ("http://h/a/b?x#y", "c", "http://h/a/c"),
        ("http://h", "c", "http://h/c"),
        ("http://h/a/b", "/c", "http://h/c"),
        ("http://h/a/b", "//o/c", "http://o/c"),
        ("http://h/a/b", "?q=1", "http://h/a/b?q=1"),
        ("http://h/a/b", "#top", "http://h/a/b"),
        ("http://h/a/b", "https://o/", "https://o/"),
        ("http://h/a/b", "mailto:x@y", None),
    ],
)
def test_resolve(spark, base, link, want):
    assert spark.createDataFrame([(base, link)], "b string, l string").select(urls.resolve(F.col("b"), F.col("l"))).first()[0] == want
