"""Scrubbing of HTML and CSS: links are remapped, and what runs, tracks or loads by itself is cut out.

Every link's target has been looked up before, by joins: ``remap`` is a map from the absolute target to
the address that takes its place. So documents are rewritten each on their own, in Arrow batches. Tags
are rewritten one by one as they stand in the source; text is left as it is.
"""

from __future__ import annotations

import html as html_module
import re
from dataclasses import dataclass, fields
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F, types as T

# Signs of the ways to treat links without a target, names of options.
POLICIES = {"+": "id", "-": "void", "*": "open", "/": "closed", "&": "fallback"}
REFERENCES = ("jumps", "actions", "reqs")
DYNAMIC = ("styles", "scripts", "iepragmas", "iframes", "prefetches", "tracking", "navigations")
# Schemes that are remapped and schemes that are left alone, rel words that only load ahead.
REMAPPED, LEFT = ("http", "https", "ftp", "ftps"), ("mailto", "irc", "magnet")
PRELOADS = ("dns-prefetch", "preconnect", "prefetch", "prerender", "preload", "modulepreload")
# The address of a link that leads nowhere.
VOID_REQUISITE, VOID_LINK = "data:text/plain,%20", "javascript:void(0)"


@dataclass(frozen=True)
class Options:
    """What is kept (true) and how links without a target are treated."""

    jumps: str = "open"
    actions: str = "fallback"
    reqs: str = "fallback"
    styles: bool = True
    scripts: bool = False
    iepragmas: bool = False
    iframes: bool = True
    prefetches: bool = False
    tracking: bool = False
    navigations: bool = False
    verbose: bool = True
    unknown: bool = True

    @classmethod
    def parse(cls, text: str) -> "Options":
        """Options of ``+scripts,-styles,*all_refs`` lists; ``defaults`` names none."""
        known = {f.name for f in fields(cls)}
        out: dict[str, object] = {}
        for item in [] if text == "defaults" else text.split(","):
            sign, name = item[:1], item[1:]
            if name == "all_refs" or name in REFERENCES:
                if sign not in POLICIES:
                    raise ValueError(f"unknown option {item!r}")
                out |= dict.fromkeys(REFERENCES if name == "all_refs" else (name,), POLICIES[sign])
            elif sign in ("+", "-") and (name == "all_dyns" or name in known):
                out |= dict.fromkeys(DYNAMIC if name == "all_dyns" else (name,), sign == "+")
            else:
                raise ValueError(f"unknown option {item!r}")
        return cls(**out)


#: Element and attribute of links, by kind; links of ``link`` and ``srcset`` are told apart below.
KINDS = {
    "jumps": {("a", "href"), ("area", "href"), ("blockquote", "cite"), ("del", "cite"), ("ins", "cite"), ("q", "cite"), ("object", "data")},
    "actions": {("a", "ping"), ("area", "ping"), ("button", "formaction"), ("form", "action"), ("input", "formaction")},
    "reqs": {("audio", "src"), ("embed", "src"), ("frame", "src"), ("iframe", "src"), ("img", "src"), ("input", "src"), ("script", "src"), ("source", "src"), ("track", "src"), ("video", "poster"), ("video", "src")},
}
_KIND_OF = {pair: kind for kind, pairs in KINDS.items() for pair in pairs}
_TRACKING = {("a", "ping"), ("area", "ping")}
_NAVIGATION = ("refresh",)
_TAG = re.compile(r"""<!--(?P<comment>.*?)-->|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\s*([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_PRAGMA = re.compile(r"^\s*\[if\s|<!\[endif\]\s*$", re.I)
# comments and strings are tokens of their own, so what looks like a link inside them stays
_CSS_URL = re.compile(r"""/\*.*?(?:\*/|\Z)|@import\s+(?:url\(\s*)?(?P<q>["']?)(?P<import>[^"')\s;]+)(?P=q)\s*\)?(?P<rest>[^;]*;?)|url\(\s*(?:(?P<p>["'])(?P<quoted>(?:\\.|(?!(?P=p)).)*)(?P=p)|(?P<bare>[^"')\s]*))\s*\)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.I | re.S)
# an address ends at white space, but for commas at its end; then come a width or density, and a comma
_CANDIDATE = re.compile(r"[\s,]*(?P<url>\S*[^\s,])(?P<none>,+)?(?(none)|\s*(?P<size>[^,(]*(?:\([^)]*\)[^,(]*)*))")


class Scrubber:
    """Rewrites the documents of one page address."""

    def __init__(self, page: str, remap: dict[str, str], options: Options):
        self.page = self.base = page or ""
        self.remap, self.options = remap, options

    def link(self, url: str, kind: str) -> str | None:
        """The address that takes the place of a link; None if the attribute goes."""
        void = VOID_REQUISITE if kind == "reqs" else VOID_LINK
        try:
            whole = urljoin(self.base, url.strip())
            scheme = urlsplit(whole).scheme.lower()
        except ValueError:
            return void if kind == "reqs" else url
        if scheme in LEFT:
            return url
        if scheme not in REMAPPED:
            return void if kind == "reqs" and scheme != "data" else url
        target, fragment = urldefrag(whole)
        tail = f"#{fragment}" if fragment else ""
        if target == urldefrag(self.page)[0]:
            return tail or "#"
        if target in self.remap:
            return self.remap[target] + tail
        # closed: only what the archive has is linked; fallback: a path that was made up, given by remap
        return {"id": whole, "open": whole, "void": void, "closed": void, "fallback": void}[getattr(self.options, kind)]

    def css(self, text: str) -> str:
        def one(m: re.Match) -> str:
            if m["import"] is not None:
                return f'@import "{self.link(m["import"], "reqs")}"{m["rest"]}'
            url = m["quoted"] or m["bare"]
            return f'url("{self.link(url, "reqs")}")' if url and not url.startswith("data:") else m[0]

        return _CSS_URL.sub(one, text)

    def _note(self, what: str) -> str:
        return f"<!-- censored out {what} from here -->" if self.options.verbose else ""

    def _tag(self, name: str, attrs: str) -> str:
        """A start tag with its attributes rewritten; empty if the element goes."""
        found = [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)]
        values = {k: html_module.unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in found}
        options, rels = self.options, set(values.get("rel", "").lower().split())
        if name == "base":
            self.base = urljoin(self.page, values.get("href", "")) or self.base
            return ""
        if name == "meta" and values.get("http-equiv", "").lower() in _NAVIGATION and not options.navigations:
            return self._note("a meta " + values["http-equiv"].lower())
        if name == "link":
            if rels and rels <= set(PRELOADS) and not options.prefetches:
                return self._note("a prefetch")
            if "stylesheet" in rels and not options.styles:
                return self._note("a stylesheet link")
        out = []
        for key, raw in found:
            value = values[key]
            if key.startswith("on") and not options.scripts:
                continue
            if (name, key) in _TRACKING and not options.tracking or key in ("integrity", "crossorigin", "nonce"):
                continue
            if key == "style":
                if not options.styles:
                    continue
                value = self.css(value)
            elif key == "srcset":
                value = ", ".join(" ".join(x for x in (self.link(c["url"], "reqs"), (c["size"] or "").strip()) if x) for c in _CANDIDATE.finditer(value))
            elif (name, key) in _KIND_OF or (name, key) == ("link", "href"):
                kind = _KIND_OF.get((name, key)) or ("reqs" if rels & {"stylesheet", "icon", "apple-touch-icon", "mask-icon"} else "jumps")
                if value.lower().startswith("javascript:") and not options.scripts:
                    value = VOID_LINK
                else:
                    value = self.link(value, kind)
            out.append(f'{key}="{html_module.escape(value)}"' if raw or value else key)
        slash = " /" if attrs.rstrip().endswith("/") else ""
        return f"<{' '.join([name, *out])}{slash}>"

    def html(self, text: str) -> str:
        """The document without what the options leave out; an element's content goes with it."""
        options, out, at = self.options, [], 0
        gone = {"script": options.scripts, "style": options.styles, "iframe": options.iframes, "frame": options.iframes}
        while True:
            m = _TAG.search(text, at)
            if m is None:
                return "".join(out) + text[at:]
            out.append(text[at : m.start()])
            at = m.end()
            if m["comment"] is not None:
                if options.iepragmas or not _PRAGMA.search(m["comment"]):
                    out.append(m[0])
                continue
            name = m["name"].lower()
            if m["close"]:
                if name != "noscript" or options.scripts:
                    out.append(m[0])
                continue
            if name in ("script", "style", "iframe"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(text, at)
                inner = text[at : end.start() if end else len(text)]
                at = end.end() if end else len(text)
                if not gone[name]:
                    out.append(self._note(f"a {name}"))
                else:
                    out.append(self._tag(name, m["attrs"]) + (self.css(inner) if name == "style" else inner) + f"</{name}>")
            elif name in ("textarea", "title"):  # text, whatever it looks like
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(text, at)
                stop = end.end() if end else len(text)
                out.append(self._tag(name, m["attrs"]) + text[at:stop])
                at = stop
            elif name == "noscript" and not options.scripts:
                continue  # what stands in for scripts is shown
            elif not gone.get(name, True):
                out.append(self._note(f"a {name}"))
            else:
                out.append(self._tag(name, m["attrs"]))


def scrubbed(kind: str, options: Options | str = "defaults"):
    """A function of columns (document, page address, map of targets) to the scrubbed document.

    ``kind`` is html or css. Null documents stay null.
    """
    chosen = Options.parse(options) if isinstance(options, str) else options

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series, page: pd.Series, remap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else getattr(Scrubber(p, dict(m) if m is not None else {}, chosen), kind)(t) for t, p, m in zip(text, page, remap)])

    return run


def banned_kinds(options: Options) -> list[str]:
    """Kinds of documents that are left out whole; see ``mime.censor``."""
    out = [] if options.scripts else ["javascript"]
    out += [] if options.styles else ["css"]
    out += [] if options.scripts and options.styles else ["dyndoc"]
    return out + ([] if options.unknown else ["unknown"])


def with_meta(html: Column, meta: Column) -> Column:
    """The document with ``meta`` at the beginning of its head, or in front if it has none."""
    head = F.regexp_instr(html, F.lit(r"(?i)<head(?=[\s>])[^>]*>"))
    size = F.length(F.regexp_extract(html, r"(?i)(<head(?=[\s>])[^>]*>)", 1))
    at = F.when(head > 0, head - 1 + size).otherwise(0)
    return F.when(F.coalesce(meta, F.lit("")) == "", html).otherwise(F.concat(F.substring(html, F.lit(1), at), meta, F.substring(html, at + 1, F.length(html))))


def header_meta(headers: Column) -> Column:
    """Headers that a saved page keeps as ``meta`` elements."""
    kept = F.filter(headers, lambda h: F.lower(h["name"]).isin("default-style", "x-ua-compatible", "content-security-policy", "link", "refresh"))
    one = lambda h: F.concat(F.lit('<meta http-equiv="'), h["name"], F.lit('" content="'), F.replace(F.replace(h["value"].cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('">'))
    return F.array_join(F.transform(kept, one), "")
