"""Queries over a site that is made of ``events``: every user is a page, every event a visit of it.

Pages link to each other by arithmetic on user numbers, so links are read from real markup here, and SQL
can work them out without any. Some pages redirect always, some in some visits, some in a circle.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import capture, index, links, mirror, patterns, versions
from webstrata.plans.catalog import query, table
from webstrata.plans.runtime import shared_dir, stored
from webstrata.streaming import flight, jobs, stores

IDEAL = datetime(2024, 1, 15)
ORIGIN = "https://events.example/u"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the site, with ``u``, the user's number."""
    events = table(spark, sf_dir, "events")
    n = events.agg((F.max("user_id") + 1).alias("n"))
    u, kind, n_ = F.col("u"), F.col("event_type"), F.col("n")
    ones = u % 10
    code = F.when((ones == 4) | (ones == 7) | ((ones == 9) & (kind == "click")), 301).when(kind == "error", 500).otherwise(200)
    to = F.when(ones == 4, u + 5).when(u % 20 == 7, u + 10).when(u % 20 == 17, u - 10).otherwise(3 * u + 1) % n_
    rows = events.withColumnRenamed("user_id", "u").crossJoin(F.broadcast(n))  # one row
    return rows.select(
        F.col("event_id").alias("visit"), "u", "n", F.concat(F.lit(ORIGIN), u.cast("string")).alias("net_url"), F.col("ts").alias("stime"), F.col("event_id").alias("seq"), code.alias("code"),
        F.when(code == 301, F.concat(F.lit(ORIGIN), to.cast("string"))).alias("location"), (~kind.isin("purchase", "error")).alias("normal"), (kind != "purchase").alias("complete"),
        F.concat(F.lit("v/"), u.cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".htm")).alias("path"),
    )


def pages(rows: DataFrame) -> DataFrame:
    """The documents of visits: a link, a form, and for two users in three an image."""
    u, n = F.col("u"), F.col("n")
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    image = F.when(u % 3 != 0, F.concat(F.lit('<img src="'), name(u - 1), F.lit('">'))).otherwise("")
    html = F.concat(F.lit('<html><body><a href="/'), name((7 * u + 1) % n), F.lit('#top">next</a>'), image, F.lit('<form action="'), name((11 * u + 3) % n), F.lit('"></form></body></html>'))
    return rows.select("visit", F.col("net_url").alias("url"), html.alias("html"))


def roots(rows: DataFrame) -> DataFrame:
    good = rows.where("normal and code = 200 and u % 25 = 0").select("net_url", "visit", "stime", "seq")
    return versions.keep_latest(good, ["net_url"], "stime", "seq")


def _chased(hops: int = 8) -> str:
    """SQL for the visit that each link of each visit leads to: one step a hop, written out."""
    steps = ["""
n AS (SELECT max(user_id) + 1 AS n FROM events),
v0 AS (SELECT event_id AS visit, user_id AS u, ts, n, event_type <> 'purchase' AS complete, event_type NOT IN ('purchase', 'error') AS normal,
  CASE WHEN user_id % 10 IN (4, 7) OR (user_id % 10 = 9 AND event_type = 'click') THEN 301 WHEN event_type = 'error' THEN 500 ELSE 200 END AS code,
  (CASE WHEN user_id % 10 = 4 THEN user_id + 5 WHEN user_id % 20 = 7 THEN user_id + 10 WHEN user_id % 20 = 17 THEN user_id - 10 ELSE 3 * user_id + 1 END) % n AS loc FROM events, n),
v AS MATERIALIZED (SELECT * FROM v0),
link AS (SELECT visit, u AS page, 'jump' AS kind, (7 * u + 1) % n AS tgt, TIMESTAMP '2024-01-15' AS want FROM v
  UNION ALL SELECT visit, u, 'requisite', u - 1, ts FROM v WHERE u % 3 <> 0
  UNION ALL SELECT visit, u, 'action', (11 * u + 3) % n, TIMESTAMP '2024-01-15' FROM v),
w0 AS MATERIALIZED (SELECT DISTINCT kind = 'action' AS act, tgt, want, tgt AS place, [tgt] AS seen FROM link)"""]
    for k in range(hops + 1):
        steps.append(f"""
m{k} AS MATERIALIZED (SELECT act, tgt, want, any_value(seen) AS seen, arg_min(struct_pack(code := code, loc := loc, visit := visit), struct_pack(d := abs(epoch_us(want) - epoch_us(ts)), t := ts, v := visit)) AS m
  FROM w{k} JOIN v ON v.u = place AND CASE WHEN act THEN complete ELSE normal END GROUP BY act, tgt, want),
w{k + 1} AS MATERIALIZED (SELECT act, tgt, want, m.loc AS place, list_append(seen, m.loc) AS seen FROM m{k} WHERE m.code = 301 AND NOT list_contains(seen, m.loc))""")
    ends = " UNION ALL ".join(f"SELECT act, tgt, want, m.visit AS dst FROM m{k} WHERE m.code <> 301" for k in range(hops + 1))
    steps.append(f"""
ends AS ({ends}),
edge AS MATERIALIZED (SELECT link.*, dst FROM link LEFT JOIN ends ON (kind = 'action') = act AND link.tgt = ends.tgt AND link.want = ends.want),
root AS (SELECT arg_max(visit, struct_pack(t := ts, v := visit)) AS visit FROM v WHERE normal AND code = 200 AND u % 25 = 0 GROUP BY u)""")
    return ",".join(steps)


def mirror_sql(depth: int) -> str:
    return f"""
WITH RECURSIVE {_chased()},
walk AS (SELECT visit, 0 AS depth FROM root UNION SELECT dst, depth + CASE WHEN kind = 'requisite' THEN 0 ELSE 1 END FROM walk JOIN edge USING (visit)
  WHERE dst IS NOT NULL AND depth + CASE WHEN kind = 'requisite' THEN 0 ELSE 1 END <= {depth}),
saved AS (SELECT visit, min(depth) AS depth FROM walk GROUP BY visit)
"""


@query(mirror_sql(2) + "SELECT visit, CAST(depth AS INTEGER) AS depth FROM saved")
def mirror_plan(spark, sf_dir):
    rows = visits(spark, sf_dir)
    return mirror.plan(rows.drop("u", "n"), pages(rows), roots(rows), 2, IDEAL).saved.select("visit", "depth")


@query(mirror_sql(1) + """
SELECT edge.visit, kind, CASE WHEN d.visit IS NOT NULL THEN 'v/' || CAST(v.u AS VARCHAR) || '/' || CAST(v.visit AS VARCHAR) || '.htm' ELSE 'events.example/u' || CAST(tgt AS VARCHAR) || CASE kind WHEN 'requisite' THEN '/index.png' ELSE '/index.htm' END END AS to_path,
       CASE WHEN d.visit IS NOT NULL THEN 'saved' ELSE 'fallback' END AS status
FROM edge JOIN saved USING (visit) LEFT JOIN saved d ON d.visit = dst LEFT JOIN v ON v.visit = d.visit
""")
def mirror_destinations(spark, sf_dir):
    rows = visits(spark, sf_dir)
    found = mirror.plan(rows.drop("u", "n"), pages(rows), roots(rows), 1, IDEAL)
    return mirror.destinations(found, rows, fallbacks=True).select("visit", "kind", "to_path", "status")


@query(f"""
WITH RECURSIVE {_chased()}
SELECT visit AS link_id, dst IS NOT NULL AS found FROM edge WHERE kind = 'requisite'
""")
def redirect_mixed(spark, sf_dir):
    """Redirects of which some depend on the time: where every image of every visit leads."""
    rows = visits(spark, sf_dir)
    wanted = rows.where("u % 3 <> 0").select(F.col("visit").alias("link_id"), F.concat(F.lit(ORIGIN), (F.col("u") - 1).cast("string")).alias("target"), F.col("stime").alias("page_time"))
    return links.chase(wanted, rows.where("normal")).select("link_id", F.col("final").isNotNull().alias("found"))


@query("""
WITH RECURSIVE o AS (SELECT event_type, event_id AS our_id, epoch_us(ts) // 1000 AS ms, user_id % 3 AS h FROM events WHERE event_id % 2 = 0),
t AS (SELECT event_type, event_id AS their_id, epoch_us(ts) // 1000 AS ms, user_id % 3 AS h, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
pair AS MATERIALIZED (SELECT event_type, k, their_id, our_id, CASE WHEN o.h = t.h THEN 1 ELSE -1000 END AS score, abs(o.ms - t.ms) AS gap FROM o JOIN t USING (event_type) WHERE abs(o.ms - t.ms) <= 7200000),
walk AS (SELECT DISTINCT event_type, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS taken, NULL::BIGINT AS their_id, NULL::BIGINT AS our_id, NULL::INTEGER AS score FROM t
  UNION ALL
  SELECT w.event_type, t.k, CASE WHEN c.our_id IS NULL THEN taken ELSE list_append(taken, c.our_id)[-256:] END, t.their_id, c.our_id, c.score
  FROM walk w JOIN t ON t.event_type = w.event_type AND t.k = w.k + 1 LEFT JOIN LATERAL
    (SELECT our_id, score FROM pair p WHERE p.their_id = t.their_id AND NOT list_contains(w.taken, p.our_id) ORDER BY score DESC, gap, our_id LIMIT 1) c ON true)
SELECT their_id, our_id, score FROM walk WHERE our_id IS NOT NULL
""")
def capture_contest(spark, sf_dir):
    """Twice as many records of one observer as of the other, so that many want the same."""
    head = F.array(F.struct(F.lit("X-Group").alias("name"), F.encode(F.pmod("user_id", F.lit(3)).cast("string"), "UTF-8").alias("value")))
    theirs = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), head.alias("headers"))
    return capture.match(theirs.where("id % 2 = 0"), theirs, ["event_type"], window_ms=7_200_000)


@query(r"""
WITH p AS (SELECT DISTINCT '*://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || left(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), 2) || '*' AS pattern FROM pages
  UNION SELECT 'h*' UNION SELECT '*?' || CAST(r_regionkey AS VARCHAR) FROM region UNION SELECT '*[' || left(lower(n_name), 3) || ']/*' FROM nation UNION SELECT '*no such address*')
SELECT page_id, pattern FROM pages JOIN p ON url GLOB pattern
""")
def pattern_table(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1)
    asked = rows.select(F.concat(F.lit("*://"), host, F.lit("/"), F.left(path, F.lit(2)), F.lit("*")).alias("pattern"))
    asked = asked.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("*?"), F.col("r_regionkey").cast("string")).alias("pattern")))
    asked = asked.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("*["), F.left(F.lower("n_name"), F.lit(3)), F.lit("]/*")).alias("pattern")))
    asked = asked.unionByName(spark.createDataFrame([("h*",), ("*no such address*",)], "pattern string"))
    return patterns.pattern_join(rows, asked, url="url").select("page_id", "pattern")


@query("SELECT o_orderkey, count(*) AS visits, min(event_id) AS first_event FROM orders JOIN events ON user_id = o_custkey % 150 GROUP BY 1")
def url_index_lookup(spark, sf_dir):
    """Visits added to the index in four batches of a stream."""
    rows = visits(spark, sf_dir).select("net_url", "stime", "seq", "code")
    folder, name = f"{shared_dir(spark)}/webstrata/index-{uuid.uuid4().hex}", f"url_index_{uuid.uuid4().hex}"
    rows.repartition(4, "seq").write.parquet(f"{folder}/in")
    index.create(spark, name, rows, f"{folder}/table", buckets=8)
    jobs.run_batches(jobs.table_stream(spark, f"{folder}/in", "*.parquet"), index.appender(name, buckets=8), f"{folder}/state")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(ORIGIN), F.pmod("o_custkey", F.lit(150)).cast("string")).alias("net_url"))
    return index.lookup(asked, name).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("visits"), F.min("seq").alias("first_event"))


#: Files of a batch of a stream.
FILES = 8


def _in_batches(rows: DataFrame, batch: Column, n: int, name: str) -> DataFrame:
    """A stream of ``rows`` in ``n`` batches, in order, each of as many files, so that no task writes a whole batch."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/webstrata/{name}-{uuid.uuid4().hex}"
    kept = stored(rows.withColumn("_batch", batch), name)
    sizes = {r["_batch"]: r["count"] for r in kept.where(F.col("_batch").between(0, n - 1)).groupBy("_batch").count().collect()}  # n rows at most
    files = max(1, min(FILES, *sizes.values(), FILES)) if len(sizes) == n else 1
    for k in range(n):
        some = kept.where(F.col("_batch") == k).drop("_batch")
        # dealt in turn from one task while there are few, so that no file is without rows
        dealt = some.coalesce(1) if files == 1 or sizes[k] < 10_000 * files else some
        (dealt.repartition(files) if files > 1 else dealt).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


@query("""
WITH e AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS request_id, epoch_us(ts) // 1000 AS ms, least((dayofmonth(ts) - 1) // 8, 3) AS b FROM events),
w AS (SELECT max(ms) FILTER (b <= 1) AS passed FROM e)
SELECT request_id, 0 AS part, 'GET /' || u AS request, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '301' ELSE '200' END AS status,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'redirect' WHEN 'purchase' THEN CASE WHEN b <= 1 AND ms + 3600000 <= passed THEN 'timeout' ELSE 'flush' END ELSE 'complete' END AS ended
FROM e, w
UNION ALL SELECT request_id, 1, 'GET /' || u, '200', 'complete' FROM e WHERE event_type = 'click'
""")
def stream_in_flight(spark, sf_dir):
    """Exchanges that end, redirect or fail; purchases never end: time runs out for the early ones, a flush sends the others out.

    Of each fifth exchange the headers come before the request.
    """
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    event = lambda n, name, value: F.struct(F.lit(n).alias("n"), F.lit(name).alias("kind"), value.cast("string").alias("value"))
    request = F.struct(F.when(F.col("event_id") % 5 == 0, 2).otherwise(0).alias("n"), F.lit("request").alias("kind"), F.concat(F.lit("GET /"), F.col("user_id").cast("string")).alias("value"))
    log = F.array_compact(F.array(
        request, F.when(kind != "error", event(1, "headers", F.when(kind == "click", "301").otherwise("200"))), F.when(kind == "click", event(3, "redirect", F.lit(None))), F.when(kind == "click", event(4, "headers", F.lit("200"))),
        F.when(kind == "error", event(5, "error", F.lit(None))).when(kind != "purchase", event(5, "complete", F.lit(None))),
    ))
    events = rows.select(F.col("event_id").cast("string").alias("request_id"), "event_id", "at", F.explode(log).alias("e")).select("request_id", (F.col("event_id") * 10 + F.col("e.n")).alias("seq"), "at", "e.kind", "e.value")
    end = spark.range(1).select(F.lit(None).cast("string").alias("request_id"), F.lit(1 << 60).alias("seq"), F.lit(datetime(2024, 1, 31)).cast("timestamp").alias("at"), F.lit("flush").alias("kind"), F.lit(None).cast("string").alias("value"))
    stream = _in_batches(events.unionByName(end), F.least(F.floor((F.dayofmonth("at") - 1) / 8), F.lit(3)), 4, "in_flight")
    out = flight.in_flight(stream, 3_600_000, lanes=8)
    path = f"{shared_dir(spark)}/webstrata/in_flight-{uuid.uuid4().hex}"
    flight.run_stateful(out, path)
    return spark.read.schema(out.schema).parquet(path)


@query("""
WITH RECURSIVE o AS (SELECT event_type, event_id AS our_id, epoch_us(ts) // 1000 AS ms, user_id % 3 AS h FROM events WHERE event_id % 2 = 0),
t AS (SELECT event_type, event_id AS their_id, epoch_us(ts) // 1000 AS ms, user_id % 3 AS h, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
pair AS MATERIALIZED (SELECT event_type, k, their_id, our_id, CASE WHEN o.h = t.h THEN 1 ELSE -1000 END AS score, abs(o.ms - t.ms) AS gap FROM o JOIN t USING (event_type) WHERE abs(o.ms - t.ms) <= 3600000),
walk AS (SELECT DISTINCT event_type, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS taken, NULL::BIGINT AS their_id, NULL::BIGINT AS our_id, NULL::INTEGER AS score FROM t
  UNION ALL
  SELECT w.event_type, t.k, CASE WHEN c.our_id IS NULL THEN taken ELSE list_append(taken, c.our_id)[-256:] END, t.their_id, c.our_id, c.score
  FROM walk w JOIN t ON t.event_type = w.event_type AND t.k = w.k + 1 LEFT JOIN LATERAL
    (SELECT our_id, score FROM pair p WHERE p.their_id = t.their_id AND NOT list_contains(w.taken, p.our_id) ORDER BY score DESC, gap, our_id LIMIT 1) c ON true),
won AS (SELECT their_id, our_id, score FROM walk WHERE our_id IS NOT NULL)
SELECT * FROM won UNION ALL SELECT their_id, NULL, NULL FROM t WHERE their_id NOT IN (SELECT their_id FROM won) UNION ALL SELECT NULL, our_id, NULL FROM o WHERE our_id NOT IN (SELECT our_id FROM won)
""")
def stream_contest(spark, sf_dir):
    """The match of two observers over a stream of four batches, with what stays alone; a last row of each kind ends the watermark's wait."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.create_map(F.lit("X-Group"), F.pmod("user_id", F.lit(3)).cast("string")).alias("headers"))
    both = rows.withColumn("side", F.lit(1)).unionByName(rows.where("id % 2 = 0").withColumn("side", F.lit(0)))
    end = rows.select("k", F.lit(-1).cast("long").alias("id"), F.lit(datetime(2024, 3, 1)).cast("timestamp").alias("at"), "headers", F.lit(0).alias("side")).dropDuplicates(["k"])
    later = end.withColumn("at", F.lit(datetime(2024, 4, 1)).cast("timestamp"))
    day = F.when(F.month("at") == 1, F.floor((F.dayofmonth("at") - 1) / 8)).otherwise(F.month("at") + 1)
    stream = _in_batches(both.unionByName(end).unionByName(later), day, 6, "contest")
    out = flight.matched(stream, ["k"], within_ms=3_600_000)
    path = f"{shared_dir(spark)}/webstrata/contest-{uuid.uuid4().hex}"
    flight.run_stateful(out, path)
    return spark.read.schema(out.schema).parquet(path).where(F.coalesce("our_id", F.lit(0)) >= 0)


@query("""
WITH e AS (SELECT event_id, least((dayofmonth(ts) - 1) // 8, 3) AS b, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 1 END AS want FROM events)
SELECT event_id, CAST(CASE WHEN want = 5 AND b = 0 THEN 1 ELSE want END AS INTEGER) AS archived, CAST(CASE WHEN want = 5 AND b < 2 THEN 2 - b ELSE 0 END AS INTEGER) AS attempts,
       CASE WHEN want = 5 AND b = 0 THEN 'given up' ELSE 'archived' END AS state, CASE WHEN want = 5 AND b < 2 THEN 'no room' END AS reason FROM e
""")
def archive_retries(spark, sf_dir):
    """Two stores, of which one takes nothing in the first two of four batches; rows are given up after two attempts."""
    folder = f"{shared_dir(spark)}/webstrata/stores-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 2 == 0, 5).otherwise(1).alias("want"))
    stream = _in_batches(rows, F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)), 4, "archived")

    def first(some: DataFrame, batch_id: int) -> None:
        some.write.mode("overwrite").parquet(f"{folder}/first/{batch_id}")

    def second(some: DataFrame, batch_id: int) -> None:
        if batch_id < 2:
            raise OSError("no room")
        some.write.mode("overwrite").parquet(f"{folder}/second/{batch_id}")

    jobs.run_batches(stream, stores.archiver({1: first, 4: second}, folder, "event_id", "ts", max_attempts=2), f"{folder}/progress")
    return stores.state(spark, folder, 3).select("event_id", "archived", "attempts", "state", "reason")
