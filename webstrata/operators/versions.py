"""Versions of a URL in time: keep one of each, nearest-in-time joins, ranges, and replay lookups.

Ties: of two visits equally near the earlier one wins, then the one with the smaller ``seq`` column.
Keeping one of each aggregates before it shuffles (min_by / max_by). The nearest-in-time joins lay both
sides out along time and look one row back and one ahead, so no pairs of a key are made; a key with many
rows is cut into slots by rank in time, and slots pass their edges on.
"""

from __future__ import annotations

import fnmatch
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import http
from webstrata.plans import runtime


def _others(df: DataFrame, *keys: str) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def _one(df: DataFrame, keys: list[str], pick) -> DataFrame:
    kept = df.groupBy(*keys).agg(pick(_others(df, *keys)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def keep_latest(df: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """The last row of each key; of equal times the later arrival."""
    return _one(df, keys, lambda row: F.max_by(row, F.struct(time, seq)))


def keep_oldest(df: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    return _one(df, keys, lambda row: F.min_by(row, F.struct(time, seq)))


def keep_nearest(df: DataFrame, keys: list[str], time: str, seq: str, ideal: datetime) -> DataFrame:
    """The row of each key nearest to one point in time."""
    return _one(df, keys, lambda row: F.min_by(row, F.struct(distance(F.col(time), F.lit(ideal)), time, seq)))


def keep_last_arrival(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Overwriting imports: the last arrival wins, whatever its time."""
    return _one(df, keys, lambda row: F.max_by(row, F.col(seq)))


def distance(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", a, b))


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, right_seq: str, left_id: str, allowed: Column | None = None, how: str = "inner") -> DataFrame:
    """As-of join in both directions: each left row with the nearest right row of its key.

    ``allowed`` filters right rows before the join. Columns of the match come as the struct ``match``,
    null for left rows without one (``how="left"``). Keys of few rows are one lane each. Of keys with many
    rows each different time is asked for once; times are cut into slots of equal numbers of rows
    (``time_slots``), slots hand their edges on, and the answers are joined back to the rows.
    """
    usable = right if allowed is None else right.where(allowed)
    usable = usable.where(reduce(and_, [F.col(c).isNotNull() for c in on]))
    others = F.struct(*[c for c in usable.columns if c not in on])
    once = usable.groupBy(*on, F.col(right_time).alias("_t")).agg(F.min_by(others, F.col(right_seq)).alias("match"))
    rest = [c for c in left.columns if c not in on]
    ours = left.select(*on, F.col(left_time).alias("_t"), F.struct(*rest).alias("_left"))
    hot = runtime.hot_keys(usable.select(*on).unionByName(left.select(*on)), on)
    if hot is None:
        out = _nearer(_neighbours(_along(once, ours), on))
    else:
        keys = F.broadcast(hot.select(*on))  # at most three times as many as partitions
        calm = _nearer(_neighbours(_along(once.join(keys, on, "left_anti"), ours.join(keys, on, "left_anti")), on))
        busy = ours.join(keys, on, "left_semi")
        slots = time_slots(_along(once.join(keys, on, "left_semi"), busy.select(*on, "_t").distinct()), on)
        seen = _neighbours(slots, [*on, "_slot"]).join(_edges(slots, on), [*on, "_slot"], "left")
        seen = seen.withColumn("_back", F.coalesce("_back", "_before")).withColumn("_ahead", F.coalesce("_ahead", "_after"))
        out = calm.unionByName(busy.join(_nearer(seen).select(*on, "_t", "match"), [*on, "_t"], "left").select(*calm.columns))
    out = out if how == "left" else out.where(F.col("match").isNotNull())
    return out.select(*[c if c in on else F.col(f"_left.{c}") for c in left.columns], "match")


def _along(once: DataFrame, asks: DataFrame) -> DataFrame:
    """Both sides in one table: kind 0 has a match, kind 1 asks for one."""
    return once.withColumn("_kind", F.lit(0)).unionByName(asks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)


def time_slots(rows: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_slot``, in order of time within a key: ranges of key and time with about as many rows each.

    No two rows of a kind have the same key and time, so a burst is cut as well as quiet times are. The
    table is checkpointed, as all its readers have to see the same slots.
    """
    tasks = 3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runtime.cut(rows.repartitionByRange(tasks, *on, "_t").withColumn("_slot", F.spark_partition_id()))


def _neighbours(rows: DataFrame, lane: list[str]) -> DataFrame:
    """Rows that ask, with the last match before and the first one after them in their lane."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*lane).orderBy("_t", "_kind").rowsBetween(*upto)
    ahead = Window.partitionBy(*lane).orderBy(F.desc("_t"), "_kind").rowsBetween(*upto)
    here = F.when(F.col("_kind") == 0, F.struct("_t", "match"))
    seen = rows.select("*", F.last(here, True).over(back).alias("_back"), F.last(here, True).over(ahead).alias("_ahead"))
    return seen.where("_kind = 1").drop("match", "_kind")


def _edges(slots: DataFrame, on: list[str]) -> DataFrame:
    """What the slots before and after each slot of a key end and begin with; a key has no more slots than there are ranges."""
    here = F.struct("_t", "match")
    ends = slots.where("_kind = 0").groupBy(*on, "_slot").agg(F.max_by(here, "_t").alias("_last"), F.min_by(here, "_t").alias("_first"))
    every = slots.select(*on, "_slot").distinct().join(ends, [*on, "_slot"], "left")
    before = Window.partitionBy(*on).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*on).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    return every.select(*on, "_slot", F.last("_last", True).over(before).alias("_before"), F.last("_first", True).over(after).alias("_after"))


def _nearer(seen: DataFrame) -> DataFrame:
    nearer = F.col("_back").isNotNull() & (F.col("_ahead").isNull() | (distance(F.col("_t"), F.col("_back._t")) <= distance(F.col("_ahead._t"), F.col("_t"))))
    return seen.withColumn("match", F.when(nearer, F.col("_back.match")).otherwise(F.col("_ahead.match"))).drop("_back", "_ahead", "_before", "_after")


def in_range(df: DataFrame, time: str, start: datetime, end: datetime) -> DataFrame:
    return df.where((F.col(time) >= F.lit(start)) & (F.col(time) <= F.lit(end)))


def range_join(left: DataFrame, right: DataFrame, on: list[str], time: str, start: str, end: str, slot: str = "1 day") -> DataFrame:
    """Visits of a key within each left row's interval.

    Both sides are joined by key and slot of time, so a busy key is spread over its slots; an interval
    takes part in each slot that it touches.
    """
    length = int(slot.split()[0]) * {"hour": 3600, "day": 86400}[slot.split()[1].rstrip("s")] * 10**6
    place = lambda c: F.floor(F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")) / length)
    spans = left.where(F.col(start) <= F.col(end)).withColumn("_slot", F.explode(F.sequence(place(start), place(end))))
    return spans.join(right.withColumn("_slot", place(time)), [*on, "_slot"]).where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_slot")


def hybrid_join(roots: DataFrame, links: DataFrame, index: DataFrame, ideal: datetime, time: str = "stime", seq: str = "seq") -> DataFrame:
    """Hybrid version choice: link_id and ``match`` of ``links`` (link_id, net_url, kind, page_time).

    Requisites take the visit nearest to their page, jumps and actions the one nearest to ``ideal``.
    ``roots`` (net_url) take the latter as well, with a null link_id.
    """
    want = F.when(F.col("kind") == "requisite", F.col("page_time")).otherwise(F.lit(ideal).cast("timestamp_ntz"))
    asked = links.select("link_id", "net_url", want.alias("want")).unionByName(roots.select("net_url", F.lit(ideal).cast("timestamp_ntz").alias("want")), allowMissingColumns=True)
    return nearest_join(asked, index, ["net_url"], "want", time, seq, "link_id").select("link_id", "net_url", "match")


def visits(df: DataFrame, url: str, time: str) -> DataFrame:
    """Each URL with its number of visits and their first and last times."""
    return df.groupBy(url).agg(F.count(F.lit(1)).alias("visits"), F.min(time).alias("first_visit"), F.max(time).alias("last_visit"))


def like(url: Column, pattern: str) -> Column:
    """A shell pattern over whole URLs."""
    return url.rlike(rf"\A{fnmatch.translate(pattern)}".replace(r"\Z", r"\z"))


OLDEST = ("-inf", "0", "1", "oldest", "old", "first")
LATEST = ("+inf", "2", "latest", "last", "newest", "new")


def replay(df: DataFrame, selector: str, url: str, usable: Column | None = None, key: str = "net_url", time: str = "stime", seq: str = "seq") -> DataFrame:
    """The visit of ``url`` that a replay selector means, with ``exact``: whether it lies in the named
    interval, one of at most a second; if not, a client would be redirected to the visit's own time.

    A selector ending in ``*`` lists the visits of all URLs like the pattern in that interval instead.
    """
    if usable is not None:
        df = df.where(usable)
    if selector.endswith("*"):
        found = df.where(like(F.col(key), url))
        if selector != "*":
            found = in_range(found, time, *http.interval(selector))
        return visits(found, key, time)
    found = df.where(F.col(key).isin(url, url + "?") if "?" not in url else F.col(key) == url)
    own = (F.col(key) != url).cast("int").alias("_other")
    if selector in OLDEST or selector in LATEST:
        order = F.struct(own, F.col(time), F.col(seq)) if selector in OLDEST else F.struct(own, -F.unix_micros(F.col(time).cast("timestamp")), F.col(seq))
        return found.orderBy(order).limit(1).withColumn("exact", F.lit(False))
    start, end = http.interval(selector)
    ideal = http.middle(selector)
    inside = (F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end))
    short = (end - start).total_seconds() <= 1
    return found.orderBy(own, distance(F.col(time), F.lit(ideal)), time, seq).limit(1).withColumn("exact", inside & F.lit(short))


def suggestions(df: DataFrame, url: str, key: str = "net_url", pretty: str = "pretty_net_url", time: str = "stime") -> DataFrame:
    """For a URL without visits: those whose readable form has it within."""
    wanted = F.col(pretty).rlike(r"\A" + fnmatch.translate(url).replace(r"\Z", r"\z")) if "*" in url else F.contains(F.col(pretty), F.lit(url.split("://")[-1].rstrip("/")))
    return visits(df.where(wanted), key, time)


def link_targets(links: DataFrame, visits_: DataFrame, time: str = "stime", seq: str = "seq", take_any: bool = False) -> DataFrame:
    """Where the links of replayed pages point, by walking each target's visits from the nearest.

    The first visit with a definitive code (or any, with ``take_any``) is a ``web`` link at its own
    time; a redirect met before that is a ``redirect`` link at the page's time; other codes are passed
    over and give an ``other`` link if nothing else comes; links without visits are ``unavailable``.
    ``links`` has link_id, net_url and page_time; ``visits_`` net_url, code, the time and a sequence.
    """
    final = F.lit(True) if take_any else F.col("code").isin(*http.DEFINITIVE_CODES)
    stop = F.coalesce(final | F.col("code").isin(*http.REDIRECT_CODES), F.lit(False))
    stops = visits_.where(stop).select("net_url", time, seq, F.coalesce(final, F.lit(False)).alias("final"))
    met = nearest_join(links, stops, ["net_url"], "page_time", time, seq, "link_id", how="left")
    known = visits_.groupBy("net_url").agg(F.count("code").alias("n"))
    best = met.join(known, "net_url", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.when(F.col("n") == 0, "unavailable").when(F.col("match").isNull(), "other").when(F.col("match.final"), "web").otherwise("redirect")
    return best.select("link_id", "net_url", place.alias("namespace"), F.when(F.col("match.final"), F.col(f"match.{time}")).when(F.col("n") > 0, F.col("page_time")).alias("at"))


def replay_location(found: DataFrame, prefix: str = "/web", key: str = "net_url", time: str = "stime") -> DataFrame:
    """Add ``location``: where a client is sent for the exact visit, null if it has it already."""
    at = F.date_format(F.col(time), "yyyy-MM-dd_HH:mm:ss.SSS")
    return found.withColumn("location", F.when(~F.col("exact"), F.concat(F.lit(prefix + "/"), at, F.lit("/"), F.col(key))))


def by_place(df: DataFrame, rhostname: str = "rhostname", pretty: str = "pretty_net_url", net: str = "net_url") -> DataFrame:
    """URLs in the order of an index: by reversed host, readable form, sent form."""
    return df.orderBy(rhostname, pretty, net)


def repeats(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Add ``same``: whether a row's value equals that of the row before it (of its key)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(seq))
    return df.withColumn("same", F.coalesce(before == F.col(value), F.lit(False)))


def inverse(df: DataFrame, value: str, url: str = "net_url") -> DataFrame:
    """Each value with the different URLs that have it, in order."""
    return df.select(value, url).distinct().groupBy(value).agg(F.array_sort(F.collect_list(url)).alias("urls"))
