from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from webstrata.functions import expressions as X
from webstrata.functions import http, mime


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value", ["text/html;charset=utf-8", "text/html ;charset=utf-8", 'text/html; charset="utf-8";', 'text/html;; charset="utf-8";; ', 'text/html; ; charset="utf-8"; ; '])
def test_content_type(spark, value):
    row = one(spark, value, http.content_type)
    assert (row.mime, [(p.k, p.v) for p in row.params]) == ("text/html", [("charset", "utf-8")])


def test_content_type_oddities(spark):
    row = one(spark, 'text/html; charset="\\"utf-8\\""; %%; lang=en', http.content_type)
    assert [(p.k, p.v) for p in row.params] == [("charset", '"utf-8"'), ("%%", ""), ("lang", "en")]
    assert one(spark, "bla; charset=utf-8", http.content_type).mime == "text/plain"


def test_parameters(spark):
    row = one(spark, "; a=1; charset=x; charset=y", lambda v: http.with_parameter(http.parameters(v), "charset", "utf-8"))
    assert [(p.k, p.v) for p in row] == [("a", "1"), ("charset", "utf-8")]


def test_link_header(spark):
    row = one(spark, ", <https://example.org>; rel=preconnect; crossorigin, ,<https://e.org/2>; rel=icon", http.link_header)
    assert [(x.url, [(p.k, p.v) for p in x.params]) for x in row] == [("https://example.org", [("rel", "preconnect"), ("crossorigin", "")]), ("https://e.org/2", [("rel", "icon")])]
    assert one(spark, "<https://e.org>; rel=icon; x", lambda v: http.unparse_link_header(http.link_header(v))) == "<https://e.org>; rel=icon; x"


@pytest.mark.parametrize("value", ["10;url=https://example.org/", "10; url=https://example.org/", "10 ;url=https://example.org/", " 10 ; url = https://example.org/ "])
def test_refresh(spark, value):
    row = one(spark, value, http.refresh_header)
    assert (row.seconds, row.url) == (10, "https://example.org/")


def test_srcset(spark):
    row = one(spark, "https://example.org/1.jpg 2.5x, https://example.org/2.jpg", http.srcset)
    assert [(x.url, x.condition) for x in row] == [("https://example.org/1.jpg", "2.5x"), ("https://example.org/2.jpg", None)]


@pytest.mark.parametrize("value,kind,data", [("data:text/plain;base64,SGVsbG8sIFdvcmxkIQ==", "text/plain", b"Hello, World!"), ("data:,Hello%2C%20World%21", "text/plain", b"Hello, World!"), ("data:bla,x", "text/plain", b"x")])
def test_data_url(spark, value, kind, data):
    row = one(spark, value, http.data_url)
    assert (row.mime, bytes(row.data)) == (kind, data)


def test_intervals():
    utc = timezone.utc
    assert http.interval("2024") == (datetime(2024, 1, 1, tzinfo=utc), datetime(2025, 1, 1, tzinfo=utc))
    assert http.interval("2024-12") == (datetime(2024, 12, 1, tzinfo=utc), datetime(2025, 1, 1, tzinfo=utc))
    assert http.middle("2024-03-05") == datetime(2024, 3, 5, 12, tzinfo=utc)
    assert http.interval("2024-03-05 10:30 +0130")[0] == datetime(2024, 3, 5, 9, tzinfo=utc)
    assert http.interval("@1700000000")[1] - http.interval("@1700000000")[0] == timedelta(seconds=1)
    with pytest.raises(ValueError):
        http.interval("yesterday")


def test_headers(spark):
    heads = [("A", b"1\n2"), ("b", b"x")]
    frame = spark.createDataFrame([(heads,)], "h array<struct<name:string,value:binary>>")
    row = frame.select(http.header_values(F.col("h"), "a").alias("a"), http.header_value(F.col("h"), "c").alias("c")).first()
    assert (row.a, row.c) == (["1", "2"], None)


SNIFFED = [
    (b"<!DOCTYPE html><html>", "text/html"), (b"\xef\xbb\xbf<!doctype html>", "text/html"), (b"<!-- x --><html>", "text/html"), (b"<a>test</a>", "text/html"),
    (b"<?xml version='1.0'?>\n<svg xmlns='x'>", "image/svg+xml"), (b"<?xml version='1.0'?><x/>", "text/xml"), (b"example", "text/plain"), (b"GIF89a..", "image/gif"),
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff\xe0\0\0JFIF", "image/jpeg"), (b"RIFF1234WEBPVP8 ", "image/webp"), (b"OggS\0", "application/ogg"), (b"ID3x", "audio/mpeg"),
    (b"%PDF-1.4", "application/pdf"), (b"\x1f\x8b\x08", "application/gzip"), (b"PK\x03\x04", "application/zip"), (b"a\0b", "application/octet-stream"), (b"x" * 34 + b"LP", "font/otf"), (b"", "text/plain"),
]


def test_sniff(spark):
    frame = spark.createDataFrame([(bytes(b), want) for b, want in SNIFFED] + [(None, None)], "b binary, want string")
    for row in frame.select("b", "want", mime.sniff(F.col("b")).alias("got")).collect():
        assert row.got == row.want, row.b


def test_discern(spark):
    frame = spark.createDataFrame([("application/json", b"<html>"), (None, b"<html>")], "t string, b binary")
    rows = {m: [r[0].mime for r in frame.select(mime.discern(F.col("t"), F.col("b"), m)).collect()] for m in ("default", "force", "paranoid")}
    assert rows["default"] == ["text/json", "text/html"] and rows["paranoid"] == ["text/json", "text/html"]


def test_expressions(spark):
    frame = spark.createDataFrame([("abcdef", None)], "s string, n string")
    row = frame.select(
        X.abbrev(F.col("s"), 4).alias("a"), X.take_suffix(F.col("s"), 9).alias("b"), X.default(F.col("n"), "").alias("c"), X.falsy(F.col("n"), "string").alias("d"), X.strict_bool(F.lit("False")).alias("e"), X.matches(F.col("s"), "b").alias("f"),
    ).first()
    assert tuple(row) == ("abef", "abcdef", "", True, True, False)
