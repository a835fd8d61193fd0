"""Planning and rendering a mirror: which visits of which URLs to save, and where their links lead.

``visits`` is the index, a row for each visit: visit (its id), net_url, stime, seq, code, location
(absolute), path (where it would be saved), and two flags: ``normal`` documents take part as pages and
requisites, ``complete`` responses as targets of actions. ``pages`` has the documents: visit, url and html.

The plan is a fixpoint over visits. Only documents that are reached are parsed. A step takes the new
visits' links, follows redirects through the index, and takes the version nearest to the page's time, or
for jumps and actions to ``ideal`` if that is given. Requisites belong to the level of their page and are
closed over before the next level begins; jumps and actions cost one level. Each step is checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import http, mime, urls
from webstrata.operators import layout, links
from webstrata.operators.versions import nearest_join
from webstrata.plans.runtime import stored


@dataclass
class Plan:
    """``saved``: visit, depth and role (page or requisite). ``links``: visit, place, tag, attribute, link, kind,
    mime, target, and ``to``, the visit that the link leads to (null if there is none)."""

    saved: DataFrame
    links: DataFrame


def _asked(url: Column, action: Column) -> Column:
    """Targets of actions and of other links are looked up among different visits: a key for both."""
    return F.when(url.isNotNull(), F.struct(action.alias("action"), url.alias("url")))


def _index(visits: DataFrame) -> DataFrame:
    """Usable visits by what may lead to them; redirects without a target are passed over."""
    both = visits.withColumn("_action", F.explode(F.array_compact(F.array(F.when(F.col("normal"), F.lit(False)), F.when(F.col("complete"), F.lit(True))))))
    moved = F.coalesce(F.col("code").isin(*http.REDIRECT_CODES), F.lit(False))
    keyed = both.where(~moved | F.col("location").isNotNull()).select("visit", _asked(F.col("net_url"), F.col("_action")).alias("net_url"), "stime", "seq", "code", _asked(F.col("location"), F.col("_action")).alias("location"), moved.alias("moved"))
    return keyed


def plan(visits: DataFrame, pages: DataFrame, roots: DataFrame, depth: int = 0, ideal: datetime | None = None, max_hops: int = 8) -> Plan:
    """All that a mirror of ``roots`` (visit) saves, at most ``depth`` jumps away, and every link of it."""
    index = stored(_index(visits), "mirror_index")
    nodes = links.redirect_nodes(index, max_hops)
    times = visits.select("visit", F.col("stime").alias("page_time"))

    def linked(new: DataFrame) -> DataFrame:
        """The links of new visits with the visits that they lead to."""
        found = links.extract(pages.select("visit", "url", "html").join(new.select("visit"), "visit", "left_semi")).join(times.join(new.select("visit"), "visit", "left_semi"), "visit")
        free = F.col("kind") == "requisite"
        want = F.col("page_time") if ideal is None else F.when(free, F.col("page_time")).otherwise(F.lit(ideal).cast(index.schema["stime"].dataType))
        net = F.when(F.col("target").isNotNull(), urls.net_url(urls.parts(F.col("target"))))
        found = stored(found.withColumn("want", want).withColumn("asked", _asked(net, F.col("kind") == "action")).drop("page_time"), "mirror_found")
        asks = found.where("asked is not null").select("asked", "want").distinct().select(F.struct("asked", "want").alias("link_id"), F.col("asked").alias("target"), F.col("want").alias("page_time"))
        ends = stored(links.chase(asks, index, max_hops, nodes).where("final is not null").select("link_id.asked", "link_id.want", F.col("final").alias("net_url")), "mirror_ends")
        # only the visits of what is asked for are sorted by time
        usable = index.where(~F.col("moved")).join(ends.select("net_url").distinct(), "net_url", "left_semi")
        met = nearest_join(ends, usable, ["net_url"], "want", "stime", "seq", "asked").select("asked", "want", F.col("match.visit").alias("to"))
        return stored(found.join(met, ["asked", "want"], "left").drop("asked", "want"), "mirror_links")

    def further(found: DataFrame, kinds: Column, saved: DataFrame, level: int, role: str) -> DataFrame | None:
        new = found.where(kinds & F.col("to").isNotNull()).select(F.col("to").alias("visit")).distinct().join(saved.select("visit"), "visit", "left_anti")
        new = stored(new.select("visit", F.lit(level).alias("depth"), F.lit(role).alias("role")), "mirror_new")
        return None if new.isEmpty() else new

    saved = stored(roots.select("visit").distinct().select("visit", F.lit(0).alias("depth"), F.lit("page").alias("role")), "mirror_new")
    every, new, level = None, saved, 0
    while True:
        here = None
        while new is not None:  # requisites of the level's visits, and theirs
            found = linked(new)
            here = found if here is None else here.unionByName(found)
            new = further(found, F.col("kind") == "requisite", saved, level, "requisite")
            saved = saved if new is None else saved.unionByName(new)
        every = here if every is None else every.unionByName(here)
        if level == depth:
            break
        level += 1
        new = further(here, F.col("kind") != "requisite", saved, level, "page")
        if new is None:
            break
        saved = saved.unionByName(new)
    return Plan(saved, every)


def fallback_path(df: DataFrame, url: str = "target", expected: str = "mime", alias: str = "hupq") -> DataFrame:
    """Add ``fallback``: where a document of the expected type would be saved by a layout of hosts and paths."""
    p = F.col("_p")
    out = df.withColumn("_p", urls.parts(F.col(url))).withColumn("_f", urls.file_parts(p, mime.extensions_of(F.col(expected))))
    rows = out.select(
        *df.columns, p["scheme"].alias("scheme"), p["hostname"].alias("hostname"), urls.rhostname(p["hostname"]).alias("rhostname"), p["oqm"].alias("oqm"),
        F.when(p["raw_query"] == "", "").otherwise(urls.query_to_path(urls.query_parts(p["raw_query"]))).alias("mq_query"),
        F.when(p["raw_query"] == "", "").otherwise(urls.query_to_path(urls.query_nparts(p["raw_query"]))).alias("mq_nquery"),
        F.col("_f.parts").alias("filepath_parts"), F.col("_f.ext").alias("filepath_ext"),
    )
    return rows.select(*df.columns, F.when(F.col(url).isNotNull(), layout.template(alias)).alias("fallback"))


def destinations(found: Plan, visits: DataFrame, fallbacks: bool = False, alias: str = "hupq") -> DataFrame:
    """The plan's links with ``own`` (the page's path), ``place`` of the link, ``to_path`` and ``status``.

    ``saved`` links lead to the file of a visit that the mirror saves, with ``fallbacks`` the others to
    the path that their target would have; without, they are ``void``: null, and voided when rendered.
    """
    kept = found.saved.join(visits.select("visit", "path"), "visit")
    with_own = found.links.join(kept.select("visit", F.col("path").alias("own")), "visit")
    named = fallback_path(with_own, alias=alias) if fallbacks else with_own.withColumn("fallback", F.lit(None).cast("string"))
    out = named.join(kept.select(F.col("visit").alias("to"), F.col("path").alias("_to")), "to", "left")
    status = F.when(F.col("_to").isNotNull(), "saved").when(F.col("fallback").isNotNull(), "fallback").otherwise("void")
    return out.withColumn("to_path", F.coalesce("_to", "fallback")).withColumn("status", status).drop("_to", "fallback")


def rendered(found: DataFrame, pages: DataFrame, visits: DataFrame, saved: DataFrame, options: str = "defaults", absolute: str | None = None, meta: DataFrame | None = None) -> DataFrame:
    """path, content and sha256 of every saved document, its links pointing to ``destinations``.

    Of a page's links to one address the first decides. ``meta`` may hold what is put into the head of
    pages (visit, meta: see ``scrub.header_meta``). All lookups are joins; a page is then rendered on its own.
    """
    from webstrata.functions import scrub

    to = F.col("to_path")
    place = F.concat(F.lit(absolute), F.replace(to, F.lit("?"), F.lit("%3F"))) if absolute is not None else links.relative(F.col("own"), to)
    first = found.where(to.isNotNull() & F.col("target").isNotNull()).groupBy("visit", "target").agg(F.min_by(place, "place").alias("place"))
    remap = first.groupBy("visit").agg(F.map_from_entries(F.collect_list(F.struct("target", "place"))).alias("remap"))
    rows = pages.select("visit", "url", "html").join(saved.select("visit"), "visit", "left_semi").join(visits.select("visit", "path"), "visit").join(remap, "visit", "left")
    out = rows.select("visit", "path", scrub.scrubbed("html", options)("html", "url", "remap").alias("content"))
    if meta is not None:
        out = out.join(meta.select("visit", "meta"), "visit", "left").withColumn("content", scrub.with_meta(F.col("content"), F.col("meta"))).drop("meta")
    return out.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
