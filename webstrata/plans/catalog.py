"""Registered queries over the driver tables, with the SQL they are compared with.

``pages`` stands for archived documents, ``events`` for visits and capture logs, ``documents`` for
bodies. Every query applies an operator of the library to whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import expressions as X
from webstrata.functions import http, mime, pipes, scrub, urls
from webstrata.operators import capture, filters, layout, links, versions
from webstrata.plans.runtime import shared_dir
from webstrata.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
IDEAL = datetime(2024, 1, 15)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.parts(F.col("url")).alias("p"))


# --- summaries -------------------------------------------------------------------------------


@query(r"""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS visits,
       count(DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) AS paths
FROM pages GROUP BY 1
""")
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_rows(spark, sf_dir)
    return rows.groupBy(F.col("p.hostname").alias("host")).agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("p.raw_path").alias("paths"))


# --- filters ---------------------------------------------------------------------------------


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')")
def scan_filter_prefix(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "pages"), filters.text(F.col("url"), prefix=["https://blog."])).select("page_id", "url")


@query("SELECT event_id, event_type FROM events WHERE regexp_full_match(event_type, 'view|.*up') OR event_type = 'error'")
def filter_fullmatch_re(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "events"), filters.text(F.col("event_type"), exact=["error"], regex=["view|.*up"])).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE NOT coalesce(nullif(event_type, 'error') = 'view', false)")
def filter_not_null_safe(spark, sf_dir):
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    return filters.apply(table(spark, sf_dir, "events"), filters.negated(filters.text(kind, exact=["view"]))).select("event_id")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-10'")
def filter_before_after(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    ts = F.col("ts")
    return filters.apply(rows, filters.before(ts, datetime(2024, 1, 20), datetime(2024, 1, 25)), filters.after(ts, datetime(2024, 1, 10), datetime(2024, 1, 5))).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def filter_not_before(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "events"), filters.not_before(F.col("ts"), datetime(2024, 1, 20), datetime(2024, 1, 5))).select("event_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'token', 'i') OR regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def grep_or(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "documents"), filters.grep(F.array("text"), ["token"], ["[0-9]{3}-[0-9]{4}"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND regexp_matches(text, '[0-9]', '')")
def grep_and(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "documents"), filters.grep(F.array("text"), ["license"], ["[0-9]"], every=True)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def grep_smart_case(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "documents"), filters.grep(F.array("text"), ["License"])).select("doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE NOT coalesce(regexp_full_match(lang, 'e.') OR lang = 'fr', false) AND n_chars > 1000")
def filter_conjunction(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return filters.apply(rows, F.col("n_chars") > 1000, filters.negated(filters.text(F.col("lang"), exact=["fr"], regex=["e."])))


# --- URLs ------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS hostname,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS raw_path, regexp_extract(url, '\?([^#]*)', 1) AS raw_query, regexp_extract(url, '#(.*)$', 1) AS fragment,
       CASE WHEN contains(split_part(url, '#', 1), '?') THEN '?' ELSE '' END AS oqm
FROM pages
""")
def url_parts(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", *[F.col(f"p.{c}") for c in ("scheme", "hostname", "raw_path", "raw_query", "fragment", "oqm")])


@query(r"SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.')), '.') AS rhostname FROM pages")
def url_rhostname(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", urls.rhostname(F.col("p.hostname")).alias("rhostname"))


@query(r"SELECT page_id, array_to_string(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '|') AS parts FROM pages")
def url_path_parts(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", F.array_join(urls.path_parts(F.col("p.raw_path")), "|").alias("parts"))


@query(r"SELECT page_id, array_to_string(list_filter(string_split('/a/./b/../' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x NOT IN ('', '.', '..', 'b')), '|') AS parts FROM pages")
def url_npath(spark, sf_dir):
    longer = F.concat(F.lit("/a/./b/../"), F.col("p.raw_path"))
    return url_rows(spark, sf_dir).select("page_id", F.array_join(urls.npath_parts(longer), "|").alias("parts"))


@query(r"""
WITH q AS (SELECT page_id, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS q FROM pages)
SELECT page_id, array_to_string(list_transform(q, lambda x: split_part(x, '=', 1)), '|') AS keys,
       array_to_string(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN split_part(x, '=', 2) ELSE '-' END), '|') AS vals FROM q
""")
def url_query_parts(spark, sf_dir):
    pairs = urls.query_parts(F.col("p.raw_query"))
    return url_rows(spark, sf_dir).select("page_id", F.array_join(F.transform(pairs, lambda x: x["k"]), "|").alias("keys"), F.array_join(F.transform(pairs, lambda x: F.coalesce(x["v"], F.lit("-"))), "|").alias("vals"))


@query(r"SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1) || '&empty=&none', '&'), lambda x: regexp_matches(x, '=.')), '&') AS query FROM pages")
def url_query_nparts(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", urls.query_to_path(urls.query_nparts(F.concat(F.col("p.raw_query"), F.lit("&empty=&none")))).alias("query"))


@query(r"SELECT page_id, regexp_replace(split_part(url, '#', 1), '^([a-z]+://[^/?#]*)(\?.*)?$', '\1/\2') AS net_url FROM pages")
def url_net_url(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", urls.net_url(F.col("p")).alias("net_url"))


# --- exchanges: status and time --------------------------------------------------------------

_CODE = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'error' THEN 500 WHEN 'signup' THEN 404 END"


def exchange_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exchanges: a code by type, none for purchases; incomplete where value is below 1."""
    kind = F.col("event_type")
    code = F.when(kind == "view", 200).when(kind == "click", 301).when(kind == "error", 500).when(kind == "signup", 404)
    return table(spark, sf_dir, "events").withColumn("code", code).withColumn("complete", F.coalesce(F.col("value") >= 1, F.lit(False)))


@query(f"SELECT event_id, 'C' || coalesce(CAST({_CODE} AS VARCHAR) || CASE WHEN coalesce(value >= 1, false) THEN 'C' ELSE 'I' END, 'N') AS status FROM events")
def status_string(spark, sf_dir):
    return exchange_rows(spark, sf_dir).select("event_id", http.status(F.lit(True), F.col("code"), F.col("complete")).alias("status"))


@query("""
SELECT event_id, CAST(year(ts) AS INTEGER) AS syear, CAST(month(ts) AS INTEGER) AS smonth, CAST(day(ts) AS INTEGER) AS sday, CAST(hour(ts) AS INTEGER) AS shour,
       CAST(minute(ts) AS INTEGER) AS sminute, CAST(second(ts) AS INTEGER) AS ssecond, epoch_us(ts) // 1000 AS stime_ms, (epoch_us(ts) // 1000) % 1000 AS stime_msq FROM events
""")
def time_parts(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", *http.time_parts(ms, "s"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, o_orderdate) AS stime FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stime_coalesce(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("started"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", http.stime(F.col("started"), F.col("o_orderdate")).alias("stime"))


@query("SELECT o_orderkey, (o_orderkey * 7919) % 1000 AS msq FROM orders")
def time_msq(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)).alias("msq"))


# --- pipe expressions ------------------------------------------------------------------------


@query("SELECT page_id, left(sha256(url), 4) AS tag FROM pages")
def linst_sha256_prefix_hex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.to_hex(X.take_prefix(X.sha256(X.to_ascii(F.col("url"))), 2)).alias("tag"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || right(text, 60) END AS short FROM documents")
def linst_abbrev(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.abbrev(F.col("text"), 120).alias("short"))


@query("SELECT page_id, replace(url, '/', '__') AS flat FROM pages")
def linst_replace(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.replace(F.col("url"), "/", "__").alias("flat"))


@query("SELECT doc_id FROM documents WHERE coalesce(length(text) > 1024, false)")
def linst_len_gt(spark, sf_dir):
    return filters.apply(table(spark, sf_dir, "documents"), F.length(X.default(F.col("text"), "")) > 1024).select("doc_id")


@query("SELECT doc_id, left(text, 20) AS head, right(text, 20) AS tail FROM documents")
def linst_take_affix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.take_prefix(F.col("text"), 20).alias("head"), X.take_suffix(F.col("text"), 20).alias("tail"))


@query("SELECT page_id, '<' || url || '>' AS marked, regexp_matches(url, '^https') AS secure FROM pages")
def linst_add_affix(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.add_suffix(X.add_prefix(url, "<"), ">").alias("marked"), X.matches(url, "https").alias("secure"))


@query("SELECT doc_id, lang IS NULL AS no_lang, coalesce(length(text) = 0, true) AS empty FROM documents")
def linst_missing_not(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.missing(F.col("lang")).alias("no_lang"), X.falsy(F.col("text"), "string").alias("empty"))


@query("SELECT doc_id, CASE WHEN length(text) <= 256 THEN text ELSE left(text, 128) || ' ... ' || right(text, 128) END AS shown FROM documents")
def abridged_bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.abridge(F.col("text")).alias("shown"))


# --- layout ----------------------------------------------------------------------------------


@query("""
SELECT event_id, strftime(ts, '%Y/%m/%d') || '/' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '_' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '_'
       || CAST(row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS VARCHAR) AS path FROM events
""")
def template_short_path(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", *http.time_parts(ms, "s"), ms.alias("qtime_ms"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("sha256"))
    return layout.numbered(rows.withColumn("path", layout.template("short"))).select("event_id", "path")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS num FROM events")
def template_num(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("path"), F.col("event_id").cast("string").alias("sha256"), F.struct("ts", "event_id").alias("seq"))
    return layout.numbered(rows).select("event_id", "num")


@query("SELECT sha256(text) AS sha256, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("text").alias("content"), F.lit(".txt").alias("extension"))
    return layout.content_store(docs).select("sha256", "uses")


@query("SELECT page_id, '_content/sha256/' || left(sha256(html), 2) || '/' || sha256(html) || '.htm' AS path FROM pages")
def content_address_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", layout.content_path(F.sha2("html", 256), F.lit(".htm")).alias("path"))


_PLAN = """
WITH stored AS (SELECT event_type AS path, arg_max(CAST(event_id AS VARCHAR), struct_pack(t := ts, e := event_id)) AS sha, max(epoch_us(ts) // 1000) AS t FROM events WHERE user_id % 2 = 0 AND event_type <> 'error' GROUP BY 1),
fresh AS (SELECT event_type AS path, arg_max(CAST(event_id AS VARCHAR), struct_pack(t := ts, e := event_id)) AS sha256, max(epoch_us(ts) // 1000) AS t FROM events GROUP BY 1)
SELECT f.path, f.sha256, CASE WHEN s.sha = f.sha256 THEN 'noop' WHEN s.t > f.t THEN 'keep' WHEN s.path IS NOT NULL THEN 'replace' ELSE 'write' END AS action FROM fresh f LEFT JOIN stored s USING (path)
"""


@query(_PLAN)
def plan_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").cast("string").alias("sha256"), F.unix_millis(F.col("ts").cast("timestamp")).alias("stime_ms"), F.struct("ts", "event_id").alias("seq"), "user_id")
    old = versions.keep_latest(rows.where("user_id % 2 = 0 and path <> 'error'"), ["path"], "stime_ms", "seq")
    return layout.plan(rows, old, mode="latest").select("path", "sha256", "action")


@query(f"""
WITH RECURSIVE r AS (SELECT source AS bucket, doc_id // {layout.LANE} AS lane, doc_id AS seq, coalesce(octet_length(encode(text)), 0) AS size,
  row_number() OVER (PARTITION BY source, doc_id // {layout.LANE} ORDER BY doc_id) AS rn FROM documents),
walk AS (SELECT bucket, lane, seq, size, rn, CAST(0 AS BIGINT) AS bundle, size AS held FROM r WHERE rn = 1
  UNION ALL
  SELECT bucket, lane, seq, size, rn, b + CASE WHEN h > 0 AND h + size > 65536 THEN 1 ELSE 0 END, CASE WHEN h > 0 AND h + size > 65536 THEN size ELSE h + size END
  FROM (SELECT r.*, w.bundle + CASE WHEN w.held > 65536 THEN 1 ELSE 0 END AS b, CASE WHEN w.held > 65536 THEN 0 ELSE w.held END AS h
        FROM walk w JOIN r ON r.bucket IS NOT DISTINCT FROM w.bucket AND r.lane = w.lane AND r.rn = w.rn + 1))
SELECT bucket, lane, seq, CAST(size AS BIGINT) AS size, bundle FROM walk
""")
def bundle_bin_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), F.col("doc_id").alias("seq"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return layout.bundles(docs, 64 << 10)


# --- versions --------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def keep_latest(spark, sf_dir):
    return versions.keep_latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("SELECT user_id, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1")
def keep_oldest(spark, sf_dir):
    return versions.keep_oldest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("SELECT user_id, arg_min(event_id, struct_pack(d := abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')), t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def keep_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return versions.keep_nearest(rows, ["user_id"], "ts", "event_id", IDEAL).select("user_id", "event_id")


_NEAREST = """
WITH l AS (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS want FROM orders)
SELECT o_orderkey, arg_min(event_id, struct_pack(d := abs(epoch_us(want) - epoch_us(ts)), t := ts, e := event_id)) AS event_id
FROM l JOIN events USING (user_id) {where} GROUP BY o_orderkey
"""


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.make_dt_interval(mins=F.pmod("o_orderkey", F.lit(43200)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(150)).alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + minute).alias("want"))


@query(_NEAREST.format(where=""))
def asof_nearest_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    found = versions.nearest_join(_wanted(spark, sf_dir), events, ["user_id"], "want", "ts", "event_id", "o_orderkey")
    return found.select("o_orderkey", F.col("match.event_id").alias("event_id"))


@query(_NEAREST.format(where="WHERE event_type IN ('view', 'click')"))
def asof_nearest_pred(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    found = versions.nearest_join(_wanted(spark, sf_dir), events, ["user_id"], "want", "ts", "event_id", "o_orderkey", allowed=F.col("event_type").isin("view", "click"))
    return found.select("o_orderkey", F.col("match.event_id").alias("event_id"))


@query("SELECT user_id, event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def range_visits(spark, sf_dir):
    return versions.in_range(table(spark, sf_dir, "events"), "ts", datetime(2024, 1, 10), datetime(2024, 1, 12)).select("user_id", "event_id")


@query("""
WITH spans AS (SELECT user_id, min(ts) AS a, min(ts) + INTERVAL 3 DAY AS b FROM events GROUP BY 1)
SELECT e.user_id, e.event_id FROM events e JOIN spans s USING (user_id) WHERE e.ts BETWEEN a AND b
""")
def range_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    spans = events.groupBy("user_id").agg(F.min("ts").alias("a")).withColumn("b", F.col("a") + F.make_dt_interval(F.lit(3)))
    return versions.range_join(spans, events, ["user_id"], "ts", "a", "b").select("user_id", "event_id")


@query("SELECT user_id, count(*) AS visits, min(ts) AS first_visit, max(ts) AS last_visit FROM events GROUP BY 1")
def visits_by_url(spark, sf_dir):
    return versions.visits(table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT count(*) AS visits_total, count(DISTINCT url) AS urls FROM pages")
def visit_totals(spark, sf_dir):
    return capture.totals(table(spark, sf_dir, "pages"), "url")


@query("SELECT url FROM pages WHERE url GLOB 'https://blog.*.org/*'")
def url_pattern(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(versions.like(F.col("url"), "https://blog.*.org/*")).select("url")


_TARGETS = """
WITH l AS (SELECT event_id AS link_id, user_id % 40 AS net_url, ts AS page_time FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id % 40 AS net_url, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'error' THEN 500 WHEN 'signup' THEN 404 END AS code, ts, event_id FROM events WHERE event_type <> 'purchase' AND user_id % 40 < 38),
j AS (SELECT l.link_id, l.net_url, l.page_time, v.code, v.ts, v.event_id, row_number() OVER (PARTITION BY l.link_id ORDER BY abs(epoch_us(l.page_time) - epoch_us(v.ts)), v.ts, v.event_id) AS rk FROM l LEFT JOIN v USING (net_url)),
m AS (SELECT link_id, any_value(net_url) AS net_url, any_value(page_time) AS page_time, arg_min(code, rk) FILTER (code IN (200, 301)) AS code, arg_min(ts, rk) FILTER (code IN (200, 301)) AS met, count(code) AS n FROM j GROUP BY 1)
SELECT link_id, CASE WHEN n = 0 THEN 'unavailable' WHEN code IS NULL THEN 'other' WHEN code = 200 THEN 'web' ELSE 'redirect' END AS namespace,
       CASE WHEN code = 200 THEN met WHEN n > 0 THEN page_time END AS "at" FROM m
"""


@query(_TARGETS)
def replay_link_targets(spark, sf_dir):
    rows = exchange_rows(spark, sf_dir).withColumn("net_url", F.pmod("user_id", F.lit(40)))
    wanted = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("link_id"), "net_url", F.col("ts").alias("page_time"))
    seen = rows.where("event_type <> 'purchase' and net_url < 38").select("net_url", "code", "ts", "event_id")
    return versions.link_targets(wanted, seen, time="ts", seq="event_id").select("link_id", "namespace", "at")


# --- links -----------------------------------------------------------------------------------


@query("""SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""")
def link_extract(spark, sf_dir):
    return links.hrefs(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "href")


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""")
def link_out_degree(spark, sf_dir):
    found = links.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).where("kind = 'jump'")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


_EDGES = r"""
p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^/?#]*)', 1) AS section FROM pages),
edges AS (SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM p a JOIN p b ON a.origin = b.origin AND b.page_id > a.page_id AND b.page_id - a.page_id < 40)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between near pages of one site, as the test pages do not link to each other."""
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", origin.alias("origin"), F.explode(F.array(F.floor(F.col("page_id") / 40), F.floor(F.col("page_id") / 40) + 1)).alias("slot"))
    b = pages.select(F.col("page_id").alias("dst"), "origin", "slot")
    both = pages.select(F.col("page_id").alias("src"), "origin", "slot").join(b, ["origin", "slot"]).where("dst > src and dst - src < 40")
    return both.select("src", "dst").distinct()


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || replace(href, '&amp;', '&') AS target,
       regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || replace(href, '&amp;', '&') IN (SELECT split_part(url, '#', 1) FROM pages) AS archived FROM l
""")
def link_resolve_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = url_rows(spark, sf_dir).select(urls.net_url(F.col("p")).alias("net_url"))
    return links.resolved(links.extract(pages), index).select("page_id", "target", "archived")


@query(f"""
WITH RECURSIVE {_EDGES},
walk AS (SELECT page_id AS url, 0 AS depth FROM p WHERE url LIKE 'https://%' UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 2)
SELECT url, min(depth) AS depth FROM walk GROUP BY 1
""")
def link_bfs_depth2(spark, sf_dir):
    roots = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://")).select(F.col("page_id").alias("url"))
    return links.within(roots, _edges(spark, sf_dir).withColumn("kind", F.lit("jump")), 2)


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), v AS (SELECT p_partkey AS k, CASE WHEN p_size < 20 THEN 301 ELSE 200 END AS code, (p_partkey * 7) % n.n AS target FROM part, n),
walk AS (SELECT k AS link_id, k AS place, 0 AS hops, [k] AS seen FROM v
  UNION ALL
  SELECT w.link_id, v.target, w.hops + 1, list_append(w.seen, v.target) FROM walk w JOIN v ON v.k = w.place WHERE v.code = 301 AND NOT list_contains(w.seen, v.target) AND w.hops < 8),
ends AS (SELECT link_id, place, hops, row_number() OVER (PARTITION BY link_id ORDER BY hops DESC) AS rk FROM walk)
SELECT link_id, CASE WHEN v.code = 200 THEN 'u' || CAST(place AS VARCHAR) END AS final, hops FROM ends LEFT JOIN v ON v.k = place WHERE rk = 1
""")
def redirect_chase(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    at = F.lit(IDEAL).cast("timestamp")
    seen = part.select(name(F.col("p_partkey")).alias("net_url"), F.when(F.col("p_size") < 20, 301).otherwise(200).alias("code"), name(F.pmod(F.col("p_partkey") * 7, F.lit(part.count()))).alias("location"), at.alias("stime"), F.col("p_partkey").alias("seq"))
    wanted = part.select(F.col("p_partkey").alias("link_id"), name(F.col("p_partkey")).alias("target"), at.alias("page_time"))
    return links.chase(wanted, seen).select("link_id", "final", "hops")


# --- content ---------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN regexp_matches(html, '^\\s*<(!doctype\\shtml|html)', 'i') THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages")
def mime_sniff_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", mime.sniff(F.col("html").cast("binary")).alias("mime"))


@query("SELECT mime, count(*) AS n, any_value(ext) AS extension FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE 'text/json' END AS mime, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.json' END AS ext FROM documents) GROUP BY 1")
def mime_dim_join(spark, sf_dir):
    stated = F.when(F.pmod("doc_id", F.lit(2)) == 0, "text/plain").otherwise("application/json")
    docs = table(spark, sf_dir, "documents").select(mime.canonical(stated).alias("mime"))
    joined = docs.join(F.broadcast(mime.dimension(spark)), "mime")  # 32 fixed rows
    return joined.groupBy("mime").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("extensions")[0]).alias("extension"))


@query(r"""SELECT page_id, regexp_replace(html, '<script[^>]*>[^<]*(</p>)?[^<]*</script>', '', 'g') AS html FROM pages""")
def scrub_scripts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>", "").alias("html"))


@query(r"SELECT page_id, [regexp_extract('text/html; charset=utf-8; lang=' || left(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1), 2), 'lang=(.*)$', 1)][1] AS lang FROM pages")
def content_type_params(spark, sf_dir):
    value = F.concat(F.lit('text/html;; charset="utf-8"; lang='), F.left(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)", 1), F.lit(2)))
    return table(spark, sf_dir, "pages").select("page_id", http.parameter(http.content_type(value)["params"], "lang").alias("lang"))


# --- capture logs ----------------------------------------------------------------------------


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a capture log, with every state and code band."""
    rows = exchange_rows(spark, sf_dir)
    n = F.col("event_id")
    return rows.select(
        "event_id", "user_id", "event_type", "ts", "value",
        F.when(n % 97 == 0, "SNAPSHOT").otherwise("HTTP/1.1").alias("protocol"), (n % 11 != 0).alias("submitted"), (n % 7 != 0).alias("responded"), (n % 29 != 0).alias("request_complete"), (n % 13 != 0).alias("response_complete"),
        F.coalesce("code", F.lit(101)).alias("status_code"), (n % 5 == 0).alias("from_cache"), F.when(n % 10 == 0, 0).otherwise(10).alias("body_length"), F.when(n % 3 == 0, 10).alias("content_length"),
        (n % 31 == 0).alias("request_buggy"), F.lit(False).alias("response_buggy"), F.when(n % 17 == 0, F.array(F.lit("webRequest::capture::X"))).when(n % 19 == 0, F.array(F.lit("webRequest::NS_ERROR_ABORT"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


_CAPTURE = f"""
c AS (SELECT event_id, user_id, event_type, ts, value, event_id % 97 = 0 AS snap, event_id % 11 <> 0 AS submitted, event_id % 7 <> 0 AS responded, event_id % 29 <> 0 AS rqc, event_id % 13 <> 0 AS rsc,
  coalesce({_CODE}, 101) AS code, event_id % 5 = 0 AS cached, event_id % 31 = 0 AS buggy, event_id % 17 = 0 AS important, event_id % 17 <> 0 AND event_id % 19 = 0 AS other FROM events),
s AS (SELECT *, CASE WHEN snap THEN 'snapshot' WHEN NOT submitted THEN 'canceled' WHEN NOT responded THEN 'no_response' WHEN NOT rsc THEN 'incomplete'
  WHEN cached AND code = 200 AND event_id % 10 = 0 AND event_id % 3 = 0 THEN 'incomplete_fc' WHEN cached THEN 'complete_fc' ELSE 'complete' END AS net_state FROM c),
k AS (SELECT *, net_state NOT IN ('canceled', 'no_response', 'incomplete', 'incomplete_fc') AS picked,
  net_state IN ('no_response', 'incomplete') OR (buggy AND submitted AND NOT cached) OR (responded AND code IN (500, 404)) AS marked FROM s),
classified AS (SELECT *, marked OR ((important OR other) AND (important OR picked)) AS problematic FROM k)
"""


@query(f"WITH {_CAPTURE} SELECT event_id, net_state, picked, problematic FROM classified")
def classify_net_state(spark, sf_dir):
    return capture.classify(capture_rows(spark, sf_dir)).select("event_id", "net_state", "picked", "problematic")


@query("SELECT event_type AS reason, CAST(user_id % 3 AS BIGINT) AS store, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS size, bool_and(event_id % 50 <> 0) AS real, bool_and(user_id % 2 = 0) AS recoverable, max(ts) AS latest FROM events GROUP BY 1, 2")
def issue_by_reason(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), F.pmod("user_id", F.lit(3)).alias("store"), F.pmod("event_id", F.lit(100)).alias("size"), (F.col("event_id") % 50 != 0).alias("real"), (F.col("user_id") % 2 == 0).alias("recoverable"), F.col("ts").alias("at"))
    return capture.issues(rows)


@query(f"""
WITH {_CAPTURE}
SELECT CASE WHEN grouping(w) = 1 AND grouping(user_id) = 1 THEN 'all' WHEN grouping(user_id) = 1 THEN 'window' ELSE 'tab' END AS grain, w AS window_id, user_id AS tab_id, count(*) AS rows,
       CAST(sum(event_id % 100) AS BIGINT) AS size, count(*) FILTER (picked) AS picked, count(*) FILTER (problematic) AS problematic
FROM (SELECT *, user_id % 10 AS w FROM classified) GROUP BY GROUPING SETS ((), (w), (user_id))
""")
def stats_grouping_sets(spark, sf_dir):
    rows = capture.classify(capture_rows(spark, sf_dir)).select(F.pmod("user_id", F.lit(10)).alias("window_id"), F.col("user_id").alias("tab_id"), F.pmod("event_id", F.lit(100)).alias("size"), "picked", "problematic")
    return capture.statistics(rows, ["picked", "problematic"]).select("grain", "window_id", "tab_id", "rows", "size", "picked", "problematic")


@query(f"""
WITH {_CAPTURE}, later AS (SELECT user_id, event_type, max(event_id) AS any_, max(event_id) FILTER (picked) AS p FROM classified GROUP BY 1, 2)
SELECT event_id, problematic AND NOT (coalesce(p, -1) > event_id OR (NOT picked AND any_ > event_id)) AS problematic FROM classified JOIN later USING (user_id, event_type)
""")
def unmark_similar(spark, sf_dir):
    rows = capture.classify(capture_rows(spark, sf_dir)).select("event_id", F.col("user_id").alias("session_id"), F.lit("GET").alias("method"), F.col("event_type").alias("url"), "picked", "problematic", F.col("event_id").alias("seq"))
    return capture.unmark_similar(rows).select("event_id", "problematic")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1024")
def ring_buffer_last_n(spark, sf_dir):
    return capture.last_rows(table(spark, sf_dir, "events").select("event_id"), 1024, seq="event_id")


@query("WITH w AS (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 50) SELECT event_id, event_id IN (SELECT event_id FROM w) AS popped FROM events")
def limit_partition(spark, sf_dir):
    return capture.first_and_rest(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") == "error", 50, seq="event_id").select("event_id", "popped")


_RECENT = """
WITH r AS (SELECT event_type || ' u' || CAST(user_id % 7 AS VARCHAR) AS kind, event_id AS seq FROM events),
l AS (SELECT kind, max(seq) AS last, row_number() OVER (ORDER BY max(seq) DESC) AS rk FROM r GROUP BY 1)
SELECT CAST(count(*) AS VARCHAR) || 'x ' || r.kind AS label, count(*) AS n, max(seq) AS last FROM r JOIN l USING (kind) WHERE rk <= 3 AND seq > coalesce((SELECT last FROM l WHERE rk = 4), -1) GROUP BY r.kind
"""


@query(_RECENT)
def recent_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(7)).cast("string")).alias("url"), F.col("event_id").alias("seq"))
    return capture.recent_groups(rows)


@query("SELECT CAST(conv_id AS VARCHAR) AS page, count(*) AS parts FROM conversations GROUP BY 1")
def page_group_root(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_url"), F.col("role").alias("url"))
    return capture.page_groups(rows)


@query("SELECT event_id, CAST(5 & ~(event_id % 8) AS BIGINT) AS missing FROM events WHERE (5 & ~(event_id % 8)) <> 0")
def archive_missing_stores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(8)).cast("int").alias("archived"))
    return capture.to_archive(rows, capture.EXPORTED | capture.SAVED).select("event_id", F.col("missing").cast("long").alias("missing"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def distinct_keys(spark, sf_dir):
    return capture.distinct_where(table(spark, sf_dir, "events"), F.col("event_type") == "error", "user_id")


# --- streams ---------------------------------------------------------------------------------


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as four files, one a micro-batch, so that state is carried from batch to batch."""
    path = f"{shared_dir(spark)}/webstrata/events-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4, "event_id").write.parquet(path)
    return jobs.table_stream(spark, path, "*.parquet")


def _ran(stream: DataFrame, name: str, mode: str) -> DataFrame:
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/webstrata/{name}-{uuid.uuid4().hex}"
    jobs.run_now(stream, path, mode)
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id FROM events")
def stream_dedup(spark, sf_dir):
    twice = _events_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _ran(jobs.distinct(twice, ["event_id"], "ts", delay="60 days").select("event_id"), "dedup", "append")


@query("SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def stream_latest(spark, sf_dir):
    stream = _events_stream(spark, sf_dir).select("user_id", "event_id", "ts")
    return _ran(jobs.latest(stream, ["user_id"], "ts", "event_id").select("user_id", "event_id"), "latest", "complete")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000 AS started_ms, count(*) AS rows FROM s GROUP BY user_id, n
""")
def stream_session_settle(spark, sf_dir):
    bursts = jobs.settled(_events_stream(spark, sf_dir), "user_id", "ts", gap="1 hour", delay="60 days")
    return _ran(bursts.select("user_id", F.unix_millis("started").alias("started_ms"), "rows"), "settle", "complete")


@query("SELECT event_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS size FROM events GROUP BY 1")
def stream_totals(spark, sf_dir):
    return _ran(jobs.totals(_events_stream(spark, sf_dir), ["event_type"], "event_id"), "totals", "complete")


# --- pipes, templates, scrubbing, headers ---------------------------------------------------


@query("SELECT doc_id, left(sha256(coalesce(text, '')), 4) AS tag, coalesce(lang, 'none') || '!' AS lang FROM documents WHERE length(coalesce(text, '')) > 1024 AND (source LIKE 'web%' OR coalesce(lang, '') <> 'en')")
def linst_compiled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("none", F.lit("none"))
    chosen = filters.apply(docs, pipes.condition(docs, every=["text|es|len|> 1024"], some=["source|~= web", "lang|es|!= en"]))
    return chosen.select("doc_id", pipes.compile_pipe(docs, "text|es|to_utf8|sha256|take_prefix 2|to_hex").alias("tag"), pipes.compile_pipe(docs, "lang|none|add_suffix '!'").alias("lang"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d') || '/' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || '_' || event_type || '_{num}' AS path FROM events")
def template_text(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", *http.time_parts(ms, "s"))
    return rows.select("event_id", layout.template("format:%(syear)d/%(smonth)02d/%(sday)02d/%(shour)02d_%(event_type)s_%(num)d", rows).alias("path"))


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '?' ELSE '' END || regexp_extract(url, '\?([^#]*)', 1) AS path FROM pages
""")
def template_url(spark, sf_dir):
    p = F.col("p")
    rows = url_rows(spark, sf_dir).select("page_id", p["hostname"].alias("netloc"), urls.parts_to_path(urls.npath_parts(p["raw_path"])).alias("mq_npath"), p["oqm"].alias("oqm"), F.when(p["raw_query"] == "", "").otherwise(urls.query_to_path(urls.query_parts(p["raw_query"]))).alias("mq_query"))
    return rows.select("page_id", layout.template("url").alias("path"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<!-- censored out a script from here -->', 'g'), '<a href="/([^"]*)">', '<a href="' || regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/\1">', 'g') AS html FROM pages
""")
def scrub_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", scrub.scrubbed("html")("html", "url", F.lit(None).cast("map<string,string>")).alias("html"))


@query(r"""
WITH p AS (SELECT page_id, url, html, 'p/' || CAST(page_id AS VARCHAR) || '.htm' AS path FROM pages)
SELECT path, sha256(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<a href="/([^"]*)">', '<a href="javascript:void(0)">', 'g')) AS sha256 FROM p
""")
def mirror_closed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".htm")))
    found = links.extract(pages.select("path", "url", "html"))
    saved = pages.select(F.regexp_replace("url", "#.*$", "").alias("net_url"), "path").dropDuplicates(["net_url"])
    return links.mirror(pages.select("path", "url", "html"), found, saved, "/all_refs,-verbose").select("path", "sha256")


@query("SELECT page_id, url || '|https://x.example/' AS urls, 'preconnect|next' AS rels FROM pages")
def link_header_parse(spark, sf_dir):
    value = F.concat(F.lit("<"), F.col("url"), F.lit('>; rel=preconnect; crossorigin, , <https://x.example/>; rel="next"'))
    found = http.link_header(value)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(found, lambda x: x["url"]), "|").alias("urls"), F.array_join(F.transform(found, lambda x: http.parameter(x["params"], "rel")), "|").alias("rels"))


@query("SELECT page_id, CAST(page_id % 100 AS INTEGER) AS seconds, url, CAST(page_id % 100 AS VARCHAR) || ';url=' || url AS again FROM pages")
def refresh_parse(spark, sf_dir):
    found = http.refresh_header(F.concat(F.pmod("page_id", F.lit(100)).cast("string"), F.lit("; url="), F.col("url")))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("r"))
    return rows.select("page_id", "r.seconds", "r.url", http.unparse_refresh(F.col("r.seconds"), F.col("r.url")).alias("again"))


@query("SELECT page_id, 'http://xn--bcher-kva.example/' || CAST(page_id AS VARCHAR) AS net_url FROM pages")
def net_url_idn(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.parts(F.concat(F.lit("http://B\u00fccher.example/"), F.col("page_id").cast("string"))).alias("p"))
    return rows.select("page_id", urls.net_url(F.col("p"), urls.idn_host(F.col("p.hostname"))).alias("net_url"))


@query("SELECT doc_id, sha256(text) AS sha256, 'text/css' AS mime FROM documents WHERE text IS NOT NULL")
def data_url_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    packed = http.unparse_data_url(F.lit("text/css"), F.array().cast("array<struct<k:string,v:string>>"), F.encode("text", "UTF-8"))
    rows = docs.select("doc_id", http.data_url(packed).alias("d"))
    return rows.select("doc_id", F.sha2("d.data", 256).alias("sha256"), F.col("d.mime").alias("mime"))


_SIGNS = [(m, signs[0][1]) for m, signs in mime.MAGIC if len(signs) == 1 and signs[0][0] == 0]


@query(f"SELECT doc_id, [{', '.join(repr(m) for m, _ in _SIGNS)}][doc_id % {len(_SIGNS)} + 1] AS mime FROM documents")
def mime_sniff_magic(spark, sf_dir):
    sign = F.element_at(F.array(*[F.lit(x) for _, x in _SIGNS]), (F.pmod("doc_id", F.lit(len(_SIGNS))) + 1).cast("int"))
    data = F.concat(F.unhex(sign), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", mime.sniff(data).alias("mime"))


_DECLARED = [("text/plain", "text/plain", None), ("application/json; charset=utf-8", "text/json", "json,text"), ("application/rss+xml", "application/rss+xml", "xml,text"), ("image/x-odd", "image/x-odd", "image"), ("application/octet-stream", "application/octet-stream", "unknown"), ("chemical/x-pdb", "chemical/x-pdb", None)]


@query(f"SELECT doc_id, [{', '.join(repr(m) for _, m, _ in _DECLARED)}][doc_id % 6 + 1] AS mime, [{', '.join('NULL' if k is None else repr(k) for *_, k in _DECLARED)}][doc_id % 6 + 1] AS kinds FROM documents")
def content_type_normal(spark, sf_dir):
    stated = F.element_at(F.array(*[F.lit(h) for h, *_ in _DECLARED]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", mime.normalize(stated).alias("n"))
    return rows.select("doc_id", "n.mime", F.array_join("n.kinds", ",").alias("kinds"))


@query("SELECT page_id, 'Location=/r/' || CAST(page_id AS VARCHAR) || '|Content-Language=en|Link=</r/' || CAST(page_id AS VARCHAR) || '>; rel=next' AS headers FROM pages")
def replay_headers(spark, sf_dir):
    head = lambda name, value: F.struct(F.lit(name).alias("name"), F.encode(value, "UTF-8").alias("value"))
    url = F.col("url")
    headers = F.array(head("Location", url), head("Server", F.lit("x")), head("Content-Language", F.lit("en")), head("Link", F.concat(F.lit("<"), url, F.lit('>; rel="prefetch next", <https://gone.example/>; rel=next'))))
    out = http.replayed_headers(headers, F.create_map(url, F.concat(F.lit("/r/"), F.col("page_id").cast("string"))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(out, lambda h: F.concat(h["name"], F.lit("="), h["value"])), "|").alias("headers"))


# --- more of versions and capture logs -------------------------------------------------------


@query("SELECT event_id, ts, false AS exact FROM events WHERE user_id = 7 ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts, event_id LIMIT 1")
def replay_day(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("net_url", F.col("user_id").cast("string"))
    return versions.replay(rows, "2024-01-15", "7", time="ts", seq="event_id").select("event_id", "ts", "exact")


@query("SELECT CAST(user_id AS VARCHAR) AS net_url, count(*) AS visits, min(ts) AS first_visit, max(ts) AS last_visit FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%' AND ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16' GROUP BY 1")
def replay_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("net_url", F.col("user_id").cast("string"))
    return versions.replay(rows, "2024-01-15*", "1*", time="ts", seq="event_id")


@query("""
WITH l AS (SELECT event_id AS link_id, user_id % 40 AS net_url, CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '2024-01-15' END AS want FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id % 40 AS net_url, ts, event_id FROM events WHERE event_type <> 'purchase')
SELECT link_id, arg_min(event_id, struct_pack(d := abs(epoch_us(want) - epoch_us(ts)), t := ts, e := event_id)) AS event_id FROM l JOIN v USING (net_url) GROUP BY link_id
""")
def hybrid_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("net_url", F.pmod("user_id", F.lit(40)))
    kind = F.when(F.col("event_id") % 2 == 0, "requisite").otherwise("jump")
    wanted = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("link_id"), "net_url", kind.alias("kind"), F.col("ts").alias("page_time"))
    index = rows.where("event_type <> 'purchase'").select("net_url", "ts", "event_id")
    found = versions.hybrid_join(wanted.limit(0).select("net_url"), wanted, index, IDEAL, time="ts", seq="event_id")
    return found.select("link_id", F.col("match.event_id").alias("event_id"))


@query("SELECT event_type, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS urls FROM events GROUP BY 1")
def inverse_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("net_url"))
    return versions.inverse(rows, "event_type").select("event_type", F.array_join("urls", ",").alias("urls"))


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS same FROM events")
def repeats_lag(spark, sf_dir):
    return versions.repeats(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "same")


@query("SELECT event_id + 1000000 AS their_id, event_id AS our_id, 1 AS score FROM events")
def capture_match(spark, sf_dir):
    head = F.array(F.struct(F.lit("X-Id").alias("name"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value")))
    ours = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), head.alias("headers"))
    theirs = ours.withColumn("id", F.col("id") + 1000000).withColumn("at_ms", F.col("at_ms") + 5)
    return capture.match(ours, theirs, ["user_id", "event_type"])


@query("SELECT event_id AS request_id, event_type AS a, value AS b FROM events")
def capture_halves(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    first = rows.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("a"), F.lit(None).cast("double").alias("b"))
    second = rows.select(F.col("event_id").alias("request_id"), F.lit(None).cast("string").alias("a"), F.col("value").alias("b"))
    return capture.halves(first.unionByName(second))


@query("SELECT event_id, event_type = 'error' AS moved FROM events")
def rotate_order(spark, sf_dir):
    rows = capture.rotated(table(spark, sf_dir, "events"), F.col("event_type") == "error", "event_id")
    return rows.select(F.col("new_seq.seq").alias("event_id"), F.col("new_seq.moved").alias("moved"))


from webstrata.plans import site  # noqa: E402, F401  registers its queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
