"""Status, header and time columns of exchanges."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code sets of HTTP.
REDIRECT_CODES = (301, 302, 303, 307, 308)
DEFINITIVE_CODES = (200,)
TRANSIENT_CODES = (
    401, 402, 403, 404, 407, 408, 409, 412, 416, 418, 421, 423, 424, 425, 426, 429, 451, 500, 502, 503, 504, 507, 511,
    419, 440, 450, 495, 496, 509, 520, 521, 522, 523, 524, 525, 526, 530, 540, 598, 599,
)


def status(request_complete: Column, code: Column, response_complete: Column) -> Column:
    """C or I for the request, then N without a response, or its code and C or I."""
    flag = lambda c: F.when(c, "C").otherwise("I")
    return F.concat(flag(request_complete), F.when(code.isNull(), "N").otherwise(F.concat(code.cast("string"), flag(response_complete))))


def stime(response_started: Column, finished: Column) -> Column:
    return F.coalesce(response_started, finished)


def time_parts(ms: Column, prefix: str) -> list[Column]:
    """Year to second (UTC), milliseconds and their remainder of a time in epoch milliseconds."""
    at = F.timestamp_millis(ms)
    named = [("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour), ("minute", F.minute), ("second", F.second)]
    return [f(at).alias(f"{prefix}{n}") for n, f in named] + [ms.alias(f"{prefix}time_ms"), F.pmod(ms, F.lit(1000)).alias(f"{prefix}time_msq")]


def raw_headers(headers: Column) -> Column:
    """Headers with values that browsers squished together by line breaks taken apart."""
    split = lambda h: F.transform(F.split(h["value"].cast("string"), "\n"), lambda v: F.struct(h["name"].alias("name"), v.alias("value")))
    return F.flatten(F.transform(headers, split))


def header_values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(raw_headers(headers), lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def header_value(headers: Column, name: str) -> Column:
    return F.get(header_values(headers, name), F.lit(0))


_TOKEN = r"[A-Za-z0-9!#$&^_.+-]+"


def content_type(value: Column) -> Column:
    """(mime, params) of a Content-Type; invalid types are text/plain; params in order."""
    mime = F.regexp_extract(value, rf"^\s*({_TOKEN}/{_TOKEN})\s*(?:;|$)", 1)
    return F.struct(F.when(mime == "", "text/plain").otherwise(F.lower(mime)).alias("mime"), parameters(F.regexp_replace(value, r"^[^;]*", "")).alias("params"))


def parameters(value: Column) -> Column:
    """Array of (k, v) of ``; k=v; k="v"`` lists; a name alone has an empty value."""
    items = F.regexp_extract_all(value, F.lit(r'(;\s*[^;=\s]+\s*(?:=\s*(?:"(?:[^"\\]|\\.)*"|[^;\s]*))?)'), F.lit(1))

    def one(x: Column) -> Column:
        raw = F.regexp_extract(x, r"^;\s*[^;=\s]+\s*=\s*(.*)$", 1)
        bare = F.when(raw.startswith('"'), F.regexp_replace(F.regexp_extract(raw, r'^"(.*)"$', 1), r"\\(.)", "$1")).otherwise(raw)
        return F.struct(F.regexp_extract(x, r"^;\s*([^;=\s]+)", 1).alias("k"), bare.alias("v"))

    return F.transform(items, one)


def parameter(params: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(params, lambda p: F.lower(p["k"]) == name), lambda p: p["v"]), F.lit(0))


def with_parameter(params: Column, name: str, value: str) -> Column:
    """Replace the first parameter of that name and drop its repeats, or append it."""
    new = F.struct(F.lit(name).alias("k"), F.lit(value).alias("v"))
    at = F.array_position(F.transform(params, lambda p: F.lower(p["k"])), name)
    kept = F.filter(F.transform(params, lambda p, i: F.when(i == at - 1, new).otherwise(p)), lambda p, i: (F.lower(p["k"]) != name) | (i == at - 1))
    return F.when(at > 0, kept).otherwise(F.concat(params, F.array(new)))


def link_header(value: Column) -> Column:
    """Array of (url, params) of a Link header; empty elements are skipped."""
    items = F.regexp_extract_all(value, F.lit(r'(<[^<>]*>(?:[^,"<]|"(?:[^"\\]|\\.)*")*)'), F.lit(1))
    return F.transform(items, lambda x: F.struct(F.trim(F.regexp_extract(x, "^<([^<>]*)>", 1)).alias("url"), parameters(F.regexp_replace(x, "^<[^<>]*>", "")).alias("params")))


def unparse_link_header(links: Column) -> Column:
    plain = lambda p: F.concat(F.lit("; "), p["k"], F.when(p["v"] == "", "").otherwise(F.concat(F.lit("="), p["v"])))
    return F.array_join(F.transform(links, lambda x: F.concat(F.lit("<"), x["url"], F.lit(">"), F.array_join(F.transform(x["params"], plain), ""))), ", ")


def refresh_header(value: Column) -> Column:
    """(seconds, url) of a Refresh header."""
    pattern = r"(?i)^\s*(\d+)\s*(?:[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*?)['\"]?\s*)?$"
    return F.struct(F.regexp_extract(value, pattern, 1).try_cast("int").alias("seconds"), F.regexp_extract(value, pattern, 2).alias("url"))


def srcset(value: Column) -> Column:
    """Array of (url, condition) of a srcset attribute; without condition it is null."""
    items = F.regexp_extract_all(value, F.lit(r"([^\s,]\S*[^\s,](?:\s+[0-9.]+[wx])?)\s*(?:,|$)"), F.lit(1))
    condition = lambda x: F.regexp_extract(x, r"\s([0-9.]+[wx])$", 1)
    return F.transform(items, lambda x: F.struct(F.regexp_replace(x, r"\s+[0-9.]+[wx]$", "").alias("url"), F.when(condition(x) != "", condition(x)).alias("condition")))


def data_url(value: Column) -> Column:
    """(mime, params, data) of a data: URL; null for others."""
    from webstrata.functions.urls import unquote

    pattern = r"(?is)^data:([^,]*?)(\s*;\s*base64)?\s*,(.*)$"
    head, base64, body = (F.regexp_extract(value, pattern, k) for k in (1, 2, 3))
    kind = content_type(F.when(F.trim(head) == "", "text/plain;charset=US-ASCII").when(F.trim(head).startswith(";"), F.concat(F.lit("text/plain"), head)).otherwise(head))
    data = F.when(base64 != "", F.unbase64(F.regexp_replace(unquote(body), r"\s", ""))).otherwise(F.encode(unquote(body), "UTF-8"))
    return F.when(F.lower(value).startswith("data:"), F.struct(kind["mime"].alias("mime"), kind["params"].alias("params"), data.alias("data")))


_DATE = re.compile(r"^(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[ T_](\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?)?)?)?(?:\s*([+-]\d\d):?(\d\d))?\*?$")


def interval(text: str, tz: timezone = timezone.utc) -> tuple[datetime, datetime]:
    """The half-open interval that a date names: ``2024`` is a year, ``2024-03-05 10`` an hour,
    ``@1700000000`` a second."""
    text = text.strip()
    if text.startswith("@"):
        at = datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=float(text[1:].rstrip("*")))
        return at, at + (timedelta(seconds=1) if "." not in text else timedelta(milliseconds=1))
    m = _DATE.match(text)
    if not m:
        raise ValueError(f"not a date: {text!r}")
    fields = [int(x) for x in m.groups()[:6] if x is not None]
    if m[8]:
        tz = timezone(timedelta(hours=int(m[8]), minutes=int(m[9]) * (-1 if m[8][0] == "-" else 1)))
    start = datetime(*(fields + [1] * (3 - len(fields))), tzinfo=tz) if len(fields) < 3 else datetime(*fields, tzinfo=tz)
    if m[7]:
        size = timedelta(seconds=1) / 10 ** len(m[7])
        start += timedelta(seconds=int(m[7]) / 10 ** len(m[7]))
        return start, start + max(size, timedelta(microseconds=1))
    if len(fields) == 1:
        return start, start.replace(year=start.year + 1)
    if len(fields) == 2:
        return start, (start + timedelta(days=32)).replace(day=1)
    return start, start + {3: timedelta(days=1), 4: timedelta(hours=1), 5: timedelta(minutes=1), 6: timedelta(seconds=1)}[len(fields)]


def middle(text: str) -> datetime:
    a, b = interval(text)
    return a + (b - a) / 2


def human_count(n: Column) -> Column:
    ladder = F.when(n < 1000, n.cast("string"))
    for size, unit in ((10**3, "K"), (10**6, "M"), (10**9, "G"), (10**12, "T")):
        ladder = ladder.when(n < size * 1000, F.concat(F.round(n / size, 1).cast("string"), F.lit(unit)))
    return ladder.otherwise(F.concat(F.round(n / 10**15, 1).cast("string"), F.lit("P")))


def human_bytes(n: Column) -> Column:
    ladder = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        ladder = ladder.when(n < 1024 ** (power + 1), F.concat(F.round(n / 1024**power, 1).cast("string"), F.lit(unit)))
    return ladder.otherwise(F.concat(F.round(n / 1024**5, 1).cast("string"), F.lit("PiB")))


def unparse_refresh(seconds: Column, url: Column) -> Column:
    return F.concat(seconds.cast("string"), F.lit(";url="), url)


def unparse_srcset(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws(" ", x["url"], x["condition"])), ", ")


def unparse_data_url(mime: Column, params: Column, data: Column) -> Column:
    more = F.array_join(F.transform(params, lambda p: F.concat(F.lit(";"), p["k"], F.lit("="), p["v"])), "")
    return F.concat(F.lit("data:"), mime, more, F.lit(";base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


# Headers that a replay sends as they are, and rel words that only load ahead.
VERBATIM = ["content-language", "content-security-policy", "content-security-policy-report-only", "default-style", "x-ua-compatible"]
PRELOAD_RELS = ["dns-prefetch", "preconnect", "prefetch", "prerender", "preload", "modulepreload"]


def replayed_headers(headers: Column, remap: Column) -> Column:
    """Headers of a response as a replay sends them: array of (name, value).

    Locations, refreshes and links point to what ``remap`` (a map of absolute addresses) gives for them
    and go if it has nothing; links lose rel words that only load ahead; some headers stay as they are,
    all others go.
    """
    name = lambda h: F.lower(h["name"])
    text = lambda h: h["value"].cast("string")
    at = lambda url: F.element_at(remap, F.trim(url))

    def refreshed(h: Column) -> Column:
        found = refresh_header(text(h))
        return unparse_refresh(found["seconds"], at(found["url"]))

    def linked(h: Column) -> Column:
        rels = lambda p: F.array_join(F.filter(F.split(F.lower(p["v"]), r"\s+"), lambda r: ~r.isin(*PRELOAD_RELS)), " ")
        less = lambda params: F.transform(params, lambda p: F.struct(p["k"].alias("k"), F.when(F.lower(p["k"]) == "rel", rels(p)).otherwise(p["v"]).alias("v")))
        moved = F.transform(link_header(text(h)), lambda x: F.struct(at(x["url"]).alias("url"), less(x["params"]).alias("params")))
        kept = F.filter(moved, lambda x: x["url"].isNotNull() & ~F.exists(x["params"], lambda p: (F.lower(p["k"]) == "rel") & (p["v"] == "")))
        return F.when(F.size(kept) > 0, unparse_link_header(kept))

    value = lambda h: F.when(name(h) == "location", at(text(h))).when(name(h).isin(*VERBATIM), text(h)).when(name(h) == "refresh", refreshed(h)).when(name(h) == "link", linked(h))
    return F.filter(F.transform(headers, lambda h: F.struct(h["name"].alias("name"), value(h).alias("value"))), lambda h: h["value"].isNotNull())
