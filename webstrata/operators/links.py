"""Links of pages: extraction, classes, resolution against the archive, redirects and traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import http, urls
from webstrata.operators.versions import nearest_join
from webstrata.plans.runtime import cut

PAGES, IMAGES, SCRIPTS, STYLES = "text/html", "image/png", "text/javascript", "text/css"
MEDIA, TRACKS, ANY = "video/mp4", "text/vtt", "application/octet-stream"
SOUND = "audio/mpeg"

# Element, attribute, kind of link, expected type.
ATTRIBUTES = [
    ("a", "href", "jump", PAGES), ("area", "href", "jump", PAGES), ("blockquote", "cite", "jump", PAGES), ("del", "cite", "jump", PAGES), ("ins", "cite", "jump", PAGES),
    ("object", "data", "jump", PAGES), ("q", "cite", "jump", PAGES), ("a", "ping", "action", PAGES), ("area", "ping", "action", PAGES), ("button", "formaction", "action", PAGES),
    ("form", "action", "action", PAGES), ("input", "formaction", "action", PAGES), ("audio", "src", "requisite", SOUND), ("embed", "src", "requisite", ANY),
    ("frame", "src", "requisite", PAGES), ("iframe", "src", "requisite", PAGES), ("img", "src", "requisite", IMAGES), ("input", "src", "requisite", IMAGES),
    ("script", "src", "requisite", SCRIPTS), ("source", "src", "requisite", MEDIA), ("track", "src", "requisite", TRACKS), ("video", "poster", "requisite", IMAGES), ("video", "src", "requisite", MEDIA),
]
# Rel words that make a link element a requisite, and those that only preload.
STYLE_RELS = "stylesheet ie-optimized-stylesheet-desk ie-optimized-onevent-stylesheet kinetic-stylesheet".split()
ICON_RELS = "icon shortcut apple-touch-icon apple-touch-startup-image apple-touch-icon-precomposed fluid-icon mask-icon rich-pin-icon".split()
PRELOAD_RELS = "dns-prefetch preconnect prefetch prerender preload modulepreload".split()


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the source of a tag; null if it is not there."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s"'>]+)""", 1)
    single = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*'([^']*)'""", 1)
    bare = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*([^\s"'>]+)""", 1)
    text = F.when(value != "", value).when(single != "", single).otherwise(bare)
    return F.when(tag.rlike(rf"(?is)\s{name}\s*="), F.trim(unescape(text)))


def _attributes(tag: Column) -> Column:
    """Array of (name, value) of the attributes in the source of a tag that have a value, the first of each name."""
    inner = F.regexp_replace(tag, r"^<[^\s/>]+|/?>$", "")
    pieces = F.regexp_extract_all(inner, F.lit(r"""([^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))"""), F.lit(1))

    def read(piece: Column) -> Column:
        text = F.regexp_replace(piece, r"(?s)^[^=]*=\s*", "")
        bare = F.when(text.startswith('"') | text.startswith("'"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
        return F.struct(F.lower(F.regexp_extract(piece, r"^([^\s=]+)", 1)).alias("name"), F.trim(unescape(bare)).alias("value"))

    # the array around the pairs binds them, so they are read once
    first = lambda pairs: F.filter(pairs, lambda x, k: F.array_position(F.transform(pairs, lambda y: y["name"]), x["name"]) == k + 1)
    return F.get(F.transform(F.array(F.transform(pieces, read)), first), F.lit(0))


def unescape(text: Column) -> Column:
    """The character references that URLs need."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _tags(html: Column) -> Column:
    """Start tags in page order, without those in scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|(<(script|style)\b[^>]*>).*?(?:</\2\s*>|\z)", "$1")
    return F.regexp_extract_all(bare, F.lit(r"""(<[A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>)"""), F.lit(1))


def only_preloads(rel: Column) -> Column:
    """Whether a link element does no more than load something ahead."""
    words = F.filter(F.split(F.lower(F.trim(rel)), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*PRELOAD_RELS))


def rel_kind(rel: Column) -> Column:
    """(kind, type) of a link element: any requisite word makes it a requisite."""
    words = F.split(F.lower(F.trim(rel)), r"\s+")
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    return F.when(has(STYLE_RELS), F.struct(F.lit("requisite").alias("kind"), F.lit(STYLES).alias("mime"))).when(has(ICON_RELS), F.struct(F.lit("requisite").alias("kind"), F.lit(IMAGES).alias("mime"))).otherwise(F.struct(F.lit("jump").alias("kind"), F.lit(PAGES).alias("mime")))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for every link of every page: (page columns, place, tag, attribute, link, kind, mime, target).

    Targets are resolved against the page's first ``base`` and its URL; ones that cannot be fetched
    are null. Pages are pruned to their key columns.
    """
    keys = [c for c in pages.columns if c != html]
    tags = pages.select(*keys, _tags(F.col(html)).alias("tags"))
    base = F.get(F.filter(F.transform("tags", lambda t: F.when(t.rlike(r"(?i)^<base\b"), attribute(t, "href"))), lambda b: b.isNotNull()), F.lit(0))
    tags = tags.withColumn("base", F.coalesce(urls.resolve(F.col(url), base), F.col(url)))
    wanted = sorted({t for t, *_ in ATTRIBUTES} | {"link", "img", "source"})
    each = tags.select(*keys, "base", F.posexplode("tags").alias("place", "source")).withColumn("tag", F.lower(F.regexp_extract("source", r"^<([^\s/>]+)", 1)))
    each = each.where(F.col("tag").isin(*wanted)).withColumn("attributes", _attributes(F.col("source"))).drop("source")
    known = F.create_map(*[x for t, a, k, m in ATTRIBUTES for x in (F.lit(f"{t} {a}"), F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mime")))])
    one = lambda name, link, what: F.struct(name.alias("attribute"), link.alias("link"), what["kind"].alias("kind"), what["mime"].alias("mime"))
    value = lambda name: F.get(F.filter("attributes", lambda x: x["name"] == name), F.lit(0))["value"]
    key = lambda x: F.concat(F.col("tag"), F.lit(" "), x["name"])
    named = F.transform(F.filter("attributes", lambda x: F.map_contains_key(known, key(x))), lambda x: one(x["name"], x["value"], F.element_at(known, key(x))))
    linked = F.when((F.col("tag") == "link") & value("href").isNotNull(), F.array(one(F.lit("href"), value("href"), rel_kind(value("rel")))))
    image = F.struct(F.lit("requisite").alias("kind"), F.lit(IMAGES).alias("mime"))
    images = F.when(F.col("tag").isin("img", "source") & value("srcset").isNotNull(), F.transform(http.srcset(value("srcset")), lambda x: one(F.lit("srcset"), x["url"], image)))
    out = each.select(*keys, "base", "place", "tag", F.explode(F.flatten(F.array_compact(F.array(named, linked, images)))).alias("_l"))
    return out.select(*keys, "place", "tag", "_l.*", urls.resolve(F.col("base"), F.col("_l.link")).alias("target"))


def hrefs(pages: DataFrame, html: str = "html") -> DataFrame:
    """The plain case: href values of anchors, one row each."""
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def redirect_nodes(visits: DataFrame, max_hops: int = 8) -> DataFrame:
    """Where each URL leads, whatever the time: (net_url, path, stop), from one shuffle of its visits.

    ``path`` has the URLs after it for as long as each redirects to one place only, ``max_hops`` at most.
    ``stop`` is what stands at the end: ``final`` where no visit redirects, ``mixed`` where visits differ, so
    that the time decides, ``pointer`` where there are more redirects, null where nothing is archived. Paths double in each
    round, so there are log2(max_hops) joins of one row a URL. Redirects without a target count as no visits.
    """
    moved = F.col("code").isin(*http.REDIRECT_CODES)
    to = F.when(moved, F.col("location"))
    seen = visits.where(~F.coalesce(moved, F.lit(False)) | F.col("location").isNotNull())
    reduced = seen.groupBy("net_url").agg(F.min(to).alias("least"), F.max(to).alias("most"), F.count(to).alias("moves"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("moves") == 0, "final").when((F.col("moves") == F.col("n")) & (F.col("least") == F.col("most")), "pointer").otherwise("mixed")
    reduced = cut(reduced.select("net_url", kind.alias("kind"), "least"))
    kinds = reduced.select(F.col("net_url").alias("_last"), F.col("kind").alias("stop"))
    paths = reduced.where("kind = 'pointer'").select("net_url", F.array("least").alias("path"))
    size = 1
    while size < max_hops:
        further = paths.select(F.col("net_url").alias("_last"), F.col("path").alias("_more"))
        # a path that is shorter has ended: its last URL is no pointer
        longer = paths.withColumn("_last", F.when(F.size("path") == size, F.element_at("path", -1))).join(further, "_last", "left")
        paths = cut(longer.select("net_url", F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.slice(F.concat("path", "_more"), 1, max_hops)).alias("path")))
        size *= 2
    ended = paths.withColumn("_last", F.element_at("path", -1)).join(kinds, "_last", "left").select("net_url", "path", "stop")
    none = F.slice(F.array("net_url"), 1, 0)
    return cut(ended.unionByName(reduced.where("kind <> 'pointer'").select("net_url", none.alias("path"), F.col("kind").alias("stop"))))


def chase(links: DataFrame, visits: DataFrame, max_hops: int = 8, nodes: DataFrame | None = None) -> DataFrame:
    """Follow redirects through the archive: (link_id, target, final, hops); ``final`` is null where
    a target is not archived, is in a cycle, or needs more hops.

    ``links`` has link_id, target and page_time; ``visits`` net_url, code, location (absolute), stime
    and seq; ``nodes`` may hold its ``redirect_nodes``. Links that ask for the same page at the same time are
    followed once, along whole paths; only where a URL's visits differ, the one nearest in time is looked up.
    """
    nodes = redirect_nodes(visits, max_hops) if nodes is None else nodes
    mixed = nodes.where("stop = 'mixed' and size(path) = 0").select("net_url")
    varied = not mixed.isEmpty()
    asked = links.select("target", "page_time").distinct()
    open_, done = asked.withColumn("seen", F.array("target")), None
    at = nodes.select(F.col("net_url").alias("_place"), "path", "stop")
    for _ in range(max_hops + 1):
        walked = open_.withColumn("_place", F.element_at("seen", -1)).join(at, "_place", "left")
        whole = F.when(F.col("path").isNull(), F.col("seen")).otherwise(F.concat("seen", "path"))
        again = F.array_min(F.filter(F.sequence(F.lit(1), F.size("_whole")), lambda k: F.array_position(F.col("_whole"), F.get("_whole", k - 1)) < k))
        length = F.least(F.coalesce(again - 1, F.size("_whole")), F.lit(max_hops + 1))
        walked = walked.withColumn("_whole", whole).withColumn("seen", F.slice("_whole", 1, length))
        ended = F.size("seen") == F.size("_whole")
        walked = walked.select("target", "page_time", "seen", F.when(ended, F.col("stop")).alias("stop"))
        more = F.coalesce(F.col("stop") == "mixed", F.lit(False))
        ends = walked.where(~more).select("target", "page_time", F.when(F.col("stop") == "final", F.element_at("seen", -1)).alias("final"), (F.size("seen") - 1).alias("hops"))
        done = ends if done is None else done.unionByName(ends)
        if not varied:
            break
        waiting = cut(walked.where(more).select("target", "page_time", "seen", F.element_at("seen", -1).alias("net_url")))
        if waiting.isEmpty():
            break
        differing = visits.join(waiting.select("net_url").distinct(), "net_url", "left_semi")  # all of them are mixed
        targeted = ~F.coalesce(F.col("code").isin(*http.REDIRECT_CODES), F.lit(False)) | F.col("location").isNotNull()
        near = cut(nearest_join(waiting, differing, ["net_url"], "page_time", "stime", "seq", "target", targeted))
        to = F.when(F.col("match.code").isin(*http.REDIRECT_CODES), F.col("match.location"))
        stuck = to.isNotNull() & (F.array_contains("seen", to) | (F.size("seen") > max_hops))
        done = done.unionByName(near.where(to.isNull() | stuck).select("target", "page_time", F.when(to.isNull(), F.col("net_url")).alias("final"), (F.size("seen") - 1).alias("hops")))
        open_ = near.where(to.isNotNull() & ~stuck).select("target", "page_time", F.concat("seen", F.array(to)).alias("seen"))
    done = done.select(F.col("target").alias("_target"), F.col("page_time").alias("_time"), "final", "hops")
    return links.join(done, (F.col("target") == F.col("_target")) & F.col("page_time").eqNullSafe(F.col("_time"))).select("link_id", "target", "final", "hops")


def within(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Breadth-first traversal: (url, depth) of all pages at most ``depth`` links from a root.

    ``edges`` has src, dst and kind; requisites are reached with their page whatever the depth, jumps
    and actions cost one. Each step joins only the frontier and drops what was seen before.
    """
    seen = roots.select(F.col("url")).distinct().withColumn("depth", F.lit(0))
    free, paid = edges.where(F.col("kind") == "requisite").select("src", "dst"), edges.where(F.col("kind") != "requisite").select("src", "dst")
    frontier = seen
    for level in range(depth + 1):
        while True:  # requisites of the level's pages, and of those requisites
            more = _step(frontier, free, seen, level)
            if more is None:
                break
            seen, frontier = seen.unionByName(more), more
        if level == depth:
            break
        frontier = seen.where(F.col("depth") == level)
        more = _step(frontier, paid, seen, level + 1)
        if more is None:
            break
        seen, frontier = seen.unionByName(more), more
    return seen


def _step(frontier: DataFrame, edges: DataFrame, seen: DataFrame, level: int) -> DataFrame | None:
    """New pages one link away, checkpointed so that plans stay short; None if there are none."""
    more = frontier.select("url").join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
    more = cut(more.withColumn("depth", F.lit(level)))
    return None if more.isEmpty() else more


# The addresses of links that lead nowhere.
VOID_REQUISITE, VOID_LINK = "data:text/plain,%20", "javascript:void(0)"


def resolved(found: DataFrame, index: DataFrame, net: str = "net_url") -> DataFrame:
    """Links of ``extract`` with ``archived``: whether the index (a row for each URL) has their target."""
    known = index.select(F.col(net).alias("target")).distinct().withColumn("archived", F.lit(True))
    return found.join(known, "target", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


def relative(source: Column, target: Column) -> Column:
    """The address of the file ``target`` from within the file ``source``, both below one folder; ? is escaped."""
    a, b = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    at = F.sequence(F.lit(0), F.least(F.size(a), F.size(b) - 1))
    same = F.array_max(F.filter(at, lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)))
    ups = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.replace(F.array_join(F.concat(ups, F.slice(b, same + 1, F.size(b))), "/"), F.lit("?"), F.lit("%3F"))


def remaps(found: DataFrame, paths: DataFrame, own: str = "path", fallback: Column | None = None, absolute: str | None = None) -> DataFrame:
    """``remap`` of every page: the map of link targets to the files that take their place.

    ``found`` has the page's own path as ``own`` and ``target``; ``paths`` net_url and path of all saved
    documents. ``fallback`` is a path for targets that were not saved, as a column of ``found`` and is
    used where it is not null; with ``absolute`` all addresses begin with that prefix.
    """
    joined = found.join(paths.select(F.col("net_url").alias("target"), F.col("path").alias("_to")), "target", "left")
    to = F.coalesce("_to", fallback) if fallback is not None else F.col("_to")
    place = F.concat(F.lit(absolute), F.replace(to, F.lit("?"), F.lit("%3F"))) if absolute is not None else relative(F.col(own), to)
    pairs = joined.where(F.col("target").isNotNull() & to.isNotNull()).select(own, "target", place.alias("place")).distinct()
    return pairs.groupBy(own).agg(F.map_from_entries(F.collect_list(F.struct("target", "place"))).alias("remap"))


def mirror(pages: DataFrame, found: DataFrame, paths: DataFrame, options: str = "defaults", absolute: str | None = None) -> DataFrame:
    """path, content and sha256 of every page (url, html, path) with its links pointing to saved files.

    ``found`` are the pages' links with the page's path; all lookups are joins, so rendering is one pass
    over the pages, each on its own.
    """
    from webstrata.functions import scrub

    run = scrub.scrubbed("html", options)
    joined = pages.join(remaps(found, paths, absolute=absolute), "path", "left")
    out = joined.select("path", run("html", "url", "remap").alias("content"))
    return out.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
