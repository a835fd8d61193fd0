"""MIME types: canonical names, the type dimension, and sniffing by magic bytes, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Other names of a type.
CANONICAL = {
    "application/x-grip": "application/gzip",
    "application/rar-compressed": "application/rar", "application/x-rar": "application/rar", "application/x-rar-compressed": "application/rar",
    "application/font-cff": "font/otf", "application/font-off": "font/otf", "application/font-sfnt": "font/otf", "application/vnd.ms-fontobject": "font/otf",
    "application/vnd.ms-opentype": "font/otf", "font/sfnt": "font/otf", "application/font-ttf": "font/ttf", "application/font-woff": "font/woff",
    "application/font-woff2": "font/woff2", "image/jpg": "image/jpeg",
    "application/ecmascript": "text/javascript", "application/javascript": "text/javascript", "application/x-ecmascript": "text/javascript",
    "application/x-javascript": "text/javascript", "text/ecmascript": "text/javascript", "text/javascript1.0": "text/javascript",
    "text/javascript1.1": "text/javascript", "text/javascript1.2": "text/javascript", "text/javascript1.3": "text/javascript",
    "text/javascript1.4": "text/javascript", "text/javascript1.5": "text/javascript", "text/jscript": "text/javascript", "text/livescript": "text/javascript",
    "text/x-ecmascript": "text/javascript", "text/x-javascript": "text/javascript", "application/json": "text/json", "application/xml": "text/xml",
}

# Type, kinds, file extensions.
TYPES = [
    ("application/gzip", ["archive"], [".gz", ".gzip"]),
    ("application/ogg", ["audio", "video"], [".ogg"]),
    ("application/pdf", ["dyndoc"], [".pdf"]),
    ("application/postscript", ["dyndoc"], [".ps"]),
    ("application/rar", ["archive"], [".rar"]),
    ("application/zip", ["archive", "dyndoc"], [".zip", ".epub", ".apk"]),
    ("audio/aiff", ["audio"], [".aif", ".aiff", ".aifc"]),
    ("audio/midi", ["audio"], [".mid", ".midi"]),
    ("audio/mpeg", ["audio"], [".mp3"]),
    ("audio/wave", ["audio"], [".wav", ".pcm"]),
    ("font/collection", ["font"], [".ttc"]),
    ("font/otf", ["font"], [".otf", ".ttf"]),
    ("font/ttf", ["font"], [".ttf", ".otf"]),
    ("font/woff", ["font"], [".woff"]),
    ("font/woff2", ["font"], [".woff2"]),
    ("image/bmp", ["image"], [".bmp"]),
    ("image/gif", ["image"], [".gif"]),
    ("image/jpeg", ["image"], [".jpg", ".jpeg"]),
    ("image/png", ["image"], [".png"]),
    ("image/svg+xml", ["image", "xml", "text"], [".svg"]),
    ("image/webp", ["image"], [".webp"]),
    ("image/x-icon", ["image"], [".ico"]),
    ("text/css", ["css", "text"], [".css", ".mcss"]),
    ("text/html", ["html", "text"], [".htm", ".html", ".xhtm", ".xhtml"]),
    ("text/javascript", ["javascript", "text"], [".js", ".mjs"]),
    ("text/json", ["json", "text"], [".json"]),
    ("text/plain", ["text"], [".txt"]),
    ("text/vtt", ["media", "text"], [".vtt"]),
    ("text/xml", ["xml", "text"], [".xml"]),
    ("video/avi", ["video"], [".avi"]),
    ("video/mp4", ["video"], [".mp4"]),
    ("video/webm", ["video"], [".webm"]),
]

# Type, offset, magic bytes in hex; first the certain ones, then the less certain.
MAGIC = [
    ("image/gif", ((0, "474946383761"),)), ("image/gif", ((0, "474946383961"),)), ("image/webp", ((0, "52494646"), (8, "574542505650"))), ("image/png", ((0, "89504E470D0A1A0A"),)),
    ("image/jpeg", ((0, "FFD8FF"), (6, "4A464946"))), ("audio/aiff", ((0, "464F524D"), (8, "41494646"))), ("audio/mpeg", ((0, "494433"),)), ("application/ogg", ((0, "4F67675300"),)),
    ("audio/midi", ((0, "4D54686400000006"),)), ("audio/wave", ((0, "52494646"), (8, "57415645"))), ("video/avi", ((0, "52494646"), (8, "41564920"))), ("font/collection", ((0, "74746366"),)),
    ("font/otf", ((0, "4F54544F"),)), ("font/woff", ((0, "774F4646"),)), ("font/woff2", ((0, "774F4632"),)), ("application/pdf", ((0, "255044462D"),)),
    ("application/postscript", ((0, "252150532D41646F62652D"),)), ("application/gzip", ((0, "1F8B08"),)), ("application/zip", ((0, "504B0304"),)), ("application/rar", ((0, "526172201A0700"),)),
    ("image/x-icon", ((0, "00000100"),)), ("image/x-icon", ((0, "00000200"),)), ("image/bmp", ((0, "424D"),)), ("image/jpeg", ((0, "FFD8FF"),)), ("font/ttf", ((0, "00010000"),)), ("font/otf", ((34, "4C50"),)),
]

# Tags that open an HTML document.
HTML_TAGS = [
    "!doctype\\shtml", "html", "head", "meta", "link", "title", "body", "frameset", "frame", "iframe", "style", "font", "script", "header", "nav", "article", "section", "footer",
    "table", "thead", "tbody", "tfoot", "th", "tr", "td", "h1", "h2", "h3", "h4", "h5", "div", "p", "span", "b", "strong", "i", "em", "strike", "br", "a",
]
_LEAD = r"(?is)^[﻿\s]*"
_PROLOG = _LEAD + r"(?:<\?xml(?:\s[^>]*)?>\s*)?(?:<!--.*?-->\s*)*"


def canonical(mime: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.coalesce(F.element_at(pairs, mime), mime)


def dimension(spark: SparkSession) -> DataFrame:
    """mime, kinds, extensions: a fixed, small table."""
    return spark.createDataFrame(TYPES, "mime string, kinds array<string>, extensions array<string>")


def extensions_of(mime: Column) -> Column:
    table = F.create_map(*[x for m, _, e in TYPES for x in (F.lit(m), F.array(*[F.lit(v) for v in e]))])
    return F.coalesce(F.element_at(table, mime), F.array().cast("array<string>"))


def kinds_of(mime: Column) -> Column:
    table = F.create_map(*[x for m, k, _ in TYPES for x in (F.lit(m), F.array(*[F.lit(v) for v in k]))])
    return F.coalesce(F.element_at(table, mime), F.array(F.lit("unknown")))


def sniff(data: Column) -> Column:
    """MIME type by content. Magic bytes first; then byte order marks, markup, or a NUL for binaries."""
    out = None
    for mime, signs in MAGIC:
        hit = F.lit(True)
        for offset, sign in signs:
            hit = hit & (F.substring(data, offset + 1, len(sign) // 2) == F.unhex(F.lit(sign)))
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    head = F.hex(F.substring(data, 1, 3))
    text = F.when(head.startswith("FFFE"), F.decode(data, "UTF-16LE")).when(head.startswith("FEFF"), F.decode(data, "UTF-16BE")).otherwise(F.decode(data, "ISO-8859-1"))
    text = F.when(head == "EFBBBF", F.substring(F.decode(data, "ISO-8859-1"), 4, 1 << 30)).otherwise(text)
    marked = head.startswith("FFFE") | head.startswith("FEFF") | (head == "EFBBBF")
    out = out.when(~marked & (F.instr(F.decode(data, "ISO-8859-1"), "\u0000") > 0), "application/octet-stream")
    out = out.when(text.rlike(_PROLOG + "<(?:" + "|".join(HTML_TAGS) + r")(?:\s[^>]*)?>"), "text/html")
    out = out.when(text.rlike(_PROLOG + r"<svg(?:\s[^>]*)?>"), "image/svg+xml").when(text.rlike(_LEAD + r"<\?xml(?:\s[^>]*)?>"), "text/xml")
    return F.when(data.isNotNull(), out.otherwise("text/plain"))


def discern(declared: Column, data: Column, mode: str = "default") -> Column:
    """(mime, kinds): ``default`` trusts a known declaration, ``force`` keeps what declaration and
    content agree on, ``paranoid`` allows for either."""
    stated = canonical(F.lower(declared))
    vague = stated.isNull() | stated.isin("application/octet-stream", "binary/octet-stream", "application/binary", "unknown/unknown", "text/plain")
    found = sniff(data)
    own, seen = kinds_of(stated), kinds_of(found)
    if mode == "default":
        mime = F.when(vague, found).otherwise(stated)
        return F.struct(mime.alias("mime"), kinds_of(mime).alias("kinds"))
    if mode == "force":
        both = F.array_intersect(own, seen)
        return F.struct(F.when(vague | (F.size(both) == 0), found).otherwise(stated).alias("mime"), F.when(vague | (F.size(both) == 0), seen).otherwise(both).alias("kinds"))
    if mode == "paranoid":
        return F.struct(F.coalesce(stated, found).alias("mime"), F.array_union(F.when(stated.isNull(), seen).otherwise(own), seen).alias("kinds"))
    raise ValueError(f"unknown sniff mode {mode!r}")


def censor(body: Column, kinds: Column, banned: list[str], note: bool = True) -> Column:
    """Blank documents of banned kinds, with a comment in their place if ``note``."""
    hit = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in banned]))
    return F.when(hit, F.when(F.lit(note) & F.array_contains(kinds, "text"), F.concat(F.lit("/* censored out "), F.array_join(kinds, ", "), F.lit(" */"))).otherwise("")).otherwise(body)


# Declarations that say nothing, as servers send them for any file.
VAGUE_HEADERS = ["text/plain", "text/plain; charset=ISO-8859-1", "text/plain; charset=iso-8859-1", "text/plain; charset=UTF-8"]


def normalize(header: Column) -> Column:
    """(kinds, mime, charset, extensions) of a Content-Type header; kinds are null where content has to tell."""
    from webstrata.functions import http

    parsed = http.content_type(header)
    own = canonical(parsed["mime"])
    vague = header.isin(*VAGUE_HEADERS)
    mime = F.when(vague, parsed["mime"]).otherwise(own)
    known = F.array(*[F.lit(m) for m, *_ in TYPES])
    like = F.when(F.array_contains(known, own), own).when(own.endswith("+zip"), "application/zip").when(own.endswith("+xml"), "text/xml").when(own.endswith("+json"), "text/json")
    family = F.when(own.startswith("image/"), "image").when(own.startswith("audio/"), "audio").when(own.startswith("video/"), "video").when(own.startswith("font/") | own.startswith("application/font-"), "font")
    none = F.array().cast("array<string>")
    exact = F.array_contains(known, own)
    kinds = F.when(vague, F.lit(None)).when(exact, kinds_of(own)).when(own == "application/octet-stream", F.array(F.lit("unknown"))).when(family.isNotNull(), F.array(family)).when(like.isNotNull(), kinds_of(like))
    charset = http.parameter(parsed["params"], "charset")
    extensions = F.when(vague, none).when(exact, extensions_of(own)).when(family.isNotNull(), none).when(like.isNotNull(), extensions_of(like)).otherwise(none)
    return F.struct(kinds.alias("kinds"), mime.alias("mime"), F.when(vague | (own != "application/octet-stream"), charset).alias("charset"), extensions.alias("extensions"))


def may_sniff(headers: Column) -> Column:
    """Whether a response's content may tell its type: unless a header forbids it."""
    from webstrata.functions import http

    return F.coalesce(F.lower(F.trim(http.header_value(headers, "x-content-type-options"))) != "nosniff", F.lit(True))


def expected(possible: Column, wanted: Column) -> Column:
    """Of the types that a link expects those that a document may be, in their order."""
    return F.filter(wanted, lambda m: F.array_contains(possible, m))
