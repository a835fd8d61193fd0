"""Main-text extraction from HTML with site template removal.

1. Every page is read into its tree of elements, and every subtree gets two hashes from the bottom up:
   one of its source (tags, attributes, text) and one of its shape (tags, class, id and role words,
   which kinds of children), in which the words of a menu or an advert do not count.
2. Spark counts both per host over pages with different content, so copies of a page count once. A
   subtree on ``LEAST_PAGES`` of them is the site's template, however many pages the host has.
3. The page's template subtrees go. What they leave is cut into blocks of text.

The element that holds the main text (the smallest container with most of the page's text outside of
links and ``GONE`` elements, or the ``article`` or ``main`` around it) and those around it are never
template. A subtree's shape counts if its text is mostly links or if it lies beyond an article. Within
the main text only containers may be template, so paragraphs and headings stay however often their like
recurs.

A host with too few pages shows no template. What recurrence has not decided is therefore decided by
what HTML says of an element: its tag (``DROPPED``), its ARIA role, or a class or id that consists of
``WORDS`` (and ``GLUE``) on a container; never for an element that holds the main text. Of the rest
the text within ``article`` (or else ``main``) elements counts, if the page has any; on pages without,
lists that are mostly links go.

A block is the text between block-level tags; character references are decoded, white space becomes
one space, blocks are joined by newlines.

Defined cases: an empty table gives no rows; a null html has an empty text; a null url or one without
a host counts as host ""; unclosed elements end with their parent, a tag cut off at the end of the page
is dropped; repeated rows get equal texts and count once; extra columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import BROADCAST_BYTES, join_salted, row_key, stored

LEAST_PAGES = 5
#: Share of a subtree's text that has to be links for its shape to count without an article.
LINKED = 0.6

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; it ends at their own end tag only.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends open elements of the value, unless one of the third kind is in between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
FENCE = frozenset("ul ol dl table select article main section div menu html".split())
#: Elements whose text nobody reads in the page.
GONE = frozenset("head script style noscript template title textarea select option datalist iframe object embed svg canvas audio video map noframes noembed".split())
#: Elements that are no part of an article by their own name.
DROPPED = GONE | frozenset("nav aside footer form button input dialog menu".split())
CONTAINERS = frozenset("div section ul ol dl table nav header footer aside form center figure details fieldset menu".split())
HOLDERS = CONTAINERS | frozenset("html body article main td".split())
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class names and ids that say what a container is for, and words that only go along with them.
WORDS = frozenset(
    """ad ads adv advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay
    sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations newsletter
    subscribe subscription signup comment comments disqus respond replies pagination pager skip banner widget login paywall disclaimer""".split()
)
GLUE = frozenset("list lists box block bar links link buttons button wrapper wrap container area section item items inner outer site page main top bottom left right post posts article articles form group panel region holder slot unit icons icon thread up side sign bars".split())

PARTS = "host string, page bigint, hashes array<bigint>"
TEXTS = "page_id bigint, url string, text string, n_chars bigint, template_chars bigint"


def attributes(source: str) -> dict[str, str]:
    """The attributes of a start tag, names lower-cased; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def furniture(tag: str, found: dict[str, str], inside: bool) -> bool:
    """Whether an element's tag or attributes say that it is no part of an article, or hide it."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if tag not in CONTAINERS:
        return False
    for token in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if any(w in WORDS for w in words) and all(w in WORDS or w in GLUE for w in words):
            return True
    return False


class Element:
    """An element: places in the source, text sums before and after it, and its two hashes."""

    __slots__ = ("tag", "start", "end", "named", "inside", "before", "after", "roots", "source", "shape", "parts", "kinds", "parent")

    def __init__(self, tag: str, start: int, named: bool, inside: bool, before: tuple, parent: "Element | None", head: bytes, kind: bytes):
        self.tag, self.start, self.end, self.named, self.inside, self.before, self.parent = tag, start, start, named, inside, before, parent
        self.after, self.roots, self.source, self.shape = before, False, 0, 0
        self.parts, self.kinds = [head], {kind}

    def size(self, k: int) -> int:
        return self.after[k] - self.before[k]


class Page:
    """A page's elements, and its text runs and breaks in source order; everything in one pass."""

    def __init__(self, source: str):
        self.source = source
        self.elements: list[Element] = []
        self.text: list[tuple[int, str | None]] = []  # place and text; None is a break
        #: Sums so far: text, text that is read, text in links, links.
        self.sums = (0, 0, 0, 0)
        self._read()
        self.holder = self._holder()
        self.around = set()
        e = self.holder
        while e is not None:
            self.around.add(id(e))
            e = e.parent

    def _read(self) -> None:
        source, text = self.source, self.text
        stack: list[Element] = []
        articles = gone = links = named = at = 0
        self.roots: dict[tuple[str, bool], list[Element]] = {}

        def close(to: int, end: int) -> None:
            nonlocal articles, gone, links, named
            while len(stack) > to:
                e = stack.pop()
                e.end, e.after = end, self.sums
                articles -= e.tag in ("article", "main")
                gone -= e.tag in GONE
                links -= e.tag == "a"
                named -= e.named
                e.source = xxhash.xxh3_64_intdigest(b"\0".join(e.parts)) - (1 << 63)
                e.shape = xxhash.xxh3_64_intdigest(b"shape" + b"\0".join(sorted(e.kinds))) - (1 << 63)
                e.parts = e.kinds = ()
                if e.parent is not None:
                    e.parent.parts.append(e.source.to_bytes(8, "big", signed=True))
                    e.parent.kinds.add(e.shape.to_bytes(8, "big", signed=True))
                if e.tag in BLOCK:
                    text.append((end - 1 if end > e.start else end, None))

        def run(place: int, piece: str) -> None:
            text.append((place, piece))
            bare = piece.strip()
            if bare:
                n = len(bare)
                a, b, c, d = self.sums
                self.sums = (a + n, b + n * (not gone and not links), c + n * (links > 0), d)
                if stack:
                    stack[-1].parts.append(b"t" + bare.encode("utf-8", "surrogatepass"))

        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                run(at, source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k].tag
                    if name == tag:
                        close(k, at)
                        break
                    if name in ("article", "main", "table", "body") and tag in ("p", "li", "b", "i", "a", "span", "em", "strong"):
                        break
                continue
            if tag in BLOCK:
                for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    name = stack[k].tag
                    if name == "p":
                        close(k, m.start())
                        break
                    if name in BLOCK:
                        break
            for k in range(len(stack) - 1, -1, -1) if tag in ENDS else ():
                name = stack[k].tag
                if name in ENDS[tag]:
                    close(k, m.start())
                elif name in FENCE:
                    break
            found = attributes(m[3]) if m[3] else {}
            head = f"{tag} {m[3].strip()}".encode("utf-8", "surrogatepass")
            kind = _DIGITS.sub("", " ".join([tag, *sorted(found.get("class", "").split()), "#" + found.get("id", ""), found.get("role", "")])).encode("utf-8", "surrogatepass")
            if tag in VOID:
                text.append((m.start(), None if tag in BLOCK else " " if tag == "br" else ""))
                if stack:
                    stack[-1].parts.append(head)
                    stack[-1].kinds.add(kind)
                continue
            inside = articles > 0
            if tag in BLOCK:
                text.append((m.start(), None))
            e = Element(tag, m.start(), tag not in ("html", "body", "article", "main") and furniture(tag, found, inside), inside, self.sums, stack[-1] if stack else None, head, kind)
            self.elements.append(e)
            if tag == "a":
                a, b, c, d = self.sums
                self.sums = (a, b, c, d + 1)
            if tag in ("article", "main") and not inside:  # outermost ones, best outside of furniture
                self.roots.setdefault((tag, named > 0), []).append(e)
            stack.append(e)
            articles += tag in ("article", "main")
            gone += tag in GONE
            links += tag == "a"
            named += e.named
            if m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
                close(len(stack) - 1, at)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if stop > at:
                    if tag in GONE:
                        e.parts.append(source[at:stop].encode("utf-8", "surrogatepass"))
                    else:
                        run(at, source[at:stop])
                at = stop
        if at < len(source):
            run(at, source[at:])
        close(0, len(source))

    def _holder(self) -> Element | None:
        """The smallest container with more than half of the text that is read, or the article around it."""
        best, half = None, self.sums[1] / 2
        for e in self.elements:  # parents come before their children
            if e.size(1) > half and e.tag in HOLDERS:
                best = e
        roots, e = {id(r) for r in self.articles()}, best
        while e is not None:
            if id(e) in roots:
                return e
            e = e.parent
        return best

    def articles(self) -> list[Element]:
        for key in (("article", False), ("article", True), ("main", False), ("main", True)):
            if key in self.roots:
                return self.roots[key]
        return []

    def hashes(self, e: Element) -> tuple[int, ...]:
        """The hashes by which an element may be template."""
        if id(e) in self.around or e.end - e.start <= 8 or e.tag not in CONTAINERS and e.tag not in LOOSE:
            return ()
        h = self.holder
        beyond = h is None or not (h.start <= e.start and e.end <= h.end)
        if not beyond and e.tag not in CONTAINERS:
            return ()
        linked = e.size(3) >= 2 and e.size(2) >= LINKED * max(1, e.size(0))
        return (e.source, e.shape) if linked or beyond and h is not None and h.tag in ("article", "main") else (e.source,)

    def signature(self) -> int:
        """Hash of the main text's source: equal for copies of a page."""
        h = self.holder
        return h.source if h is not None else xxhash.xxh3_64_intdigest(self.source.encode("utf-8", "surrogatepass")) - (1 << 63)

    def main_text(self, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
        """The text of what is left, and how much text the template had."""
        recurring = _merged([(e.start, e.end) for e in self.elements if any(h in template for h in self.hashes(e))]) if template else []
        roots = self.articles()
        named = [(e.start, e.end) for e in self.elements if e.named and (id(e) not in self.around or e.tag in GONE)]
        if not roots:
            named += self._link_lists()
        gone = _merged(recurring + named)
        kept = _merged([(r.start, r.end) for r in roots]) if roots else [(0, len(self.source))]
        blocks, now, dropped = [], [], 0
        i = j = k = 0
        for place, piece in self.text:
            while i < len(kept) and kept[i][1] <= place:
                i += 1
            while j < len(gone) and gone[j][1] <= place:
                j += 1
            while k < len(recurring) and recurring[k][1] <= place:
                k += 1
            if piece is None:
                if now:
                    blocks.append("".join(now))
                    now = []
                continue
            if k < len(recurring) and recurring[k][0] <= place:
                dropped += len(piece.strip())
            if i < len(kept) and kept[i][0] <= place and not (j < len(gone) and gone[j][0] <= place):
                now.append(piece)
        if now:
            blocks.append("".join(now))
        clean = (" ".join(html_module.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in clean if b), dropped

    def _link_lists(self) -> list[tuple[int, int]]:
        """Lists that are mostly links, on pages that do not mark their article."""
        return [(e.start, e.end) for e in self.elements if e.tag in ("ul", "ol") and id(e) not in self.around and e.size(3) >= 3 and e.size(2) >= 0.8 * e.size(0) > 0]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        pages, hashes = [], []
        for source in part.column(1).to_pylist():
            page = Page(source or "")
            pages.append(page.signature())
            hashes.append(sorted({h for e in page.elements for h in page.hashes(e)}))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "page", "hashes"])


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        hashes = [sorted({h for page in [Page(source or "")] for e in page.elements for h in page.hashes(e)}) for source in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64()))], names=["row", "host", "hashes"])


def _texts(part: pa.RecordBatch, templates: list) -> pa.RecordBatch:
    found = [Page(source or "").main_text(t) for source, t in zip(part.column(3).to_pylist(), templates)]
    return pa.RecordBatch.from_arrays(
        [part.column(0), part.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=[x.split()[0] for x in TEXTS.split(", ")]
    )


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def templates(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur on ``least`` pages of the host with different main texts."""
    hashed = stored(pages.select(host_of().alias("host"), F.col("html")).mapInArrow(_hash_batches, PARTS), "subtrees")
    each = hashed.select("host", "page", F.explode("hashes").alias("hash")).distinct()
    return stored(each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("host", "hash"), "templates")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars and template_chars (text in recurring subtrees) of every page.

    The table of template hashes is broadcast if its counted size allows. Otherwise it is joined to the
    pages' own hashes, hot ones salted, so that a page gets no more than it has.
    """
    spark = pages.sparkSession
    found = templates(pages)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of().alias("host"), "html")
    if found.count() * 128 <= broadcast_bytes:
        by_host: dict[str, set[int]] = {}
        for host, hash_ in zip(*(c.to_pylist() for c in found.toArrow().columns)):
            by_host.setdefault(host, set()).add(hash_)
        held = spark.sparkContext.broadcast(by_host)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                yield _texts(part, [held.value.get(h, ()) for h in part.column(2).to_pylist()])

        return rows.mapInArrow(read, TEXTS)

    def read_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield _texts(part, [set(t or ()) for t in part.column(4).to_pylist()])

    keyed = rows.withColumn("row", row_key("page_id", "html"))
    own = stored(keyed.select("row", "host", "html").mapInArrow(_own_hashes, "row binary, host string, hashes array<bigint>"), "page_subtrees").dropDuplicates(["row", "host"])
    mine = join_salted(own.select("row", "host", F.explode("hashes").alias("hash")), found, ["host", "hash"], "inner").groupBy("row", "host").agg(F.collect_list("hash").alias("template"))
    joined = join_salted(keyed, stored(mine, "page_templates"), ["row", "host"], "left")
    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(read_own, TEXTS)


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
