"""URL functions as Spark columns.

Everything is built from SQL functions, so it stays in generated code; only host names that are not
plain ASCII need ``idn_host``, an Arrow UDF that a caller asks for.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F, types as T

# The schemes an archive may hold.
SCHEMES = ("http", "https", "ftp", "ftps", "ws", "wss")
#: Bytes that url_encode leaves alone or escapes unlike percent-encoding does.
_SAFE_ALWAYS = "~"


def quote(value: Column, safe: str = "/", plus: bool = False) -> Column:
    """Percent-encode UTF-8, keeping letters, digits, ``_.-~`` and ``safe``; blanks are %20 or +."""
    out = F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))
    if not plus:
        out = F.replace(out, F.lit("+"), F.lit("%20"))
    for char in _SAFE_ALWAYS + "".join(sorted(set(safe) - {"%"})) + ("%" if "%" in safe else ""):
        code = "".join(f"%{b:02X}" for b in char.encode())
        if char not in "-_." and not char.isalnum():
            out = F.replace(out, F.lit(code), F.lit(char))
    return out


def unquote(value: Column, plus: bool = False) -> Column:
    """Percent-decode; invalid escapes stay, bad UTF-8 is replaced."""
    out = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(out if plus else F.replace(out, F.lit("+"), F.lit("%2B")))


_GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parts(url: Column) -> Column:
    """scheme, user, password, raw_hostname, hostname, port, raw_path, oqm, raw_query, ofm, fragment.

    ``hostname`` is lower-cased, trimmed and has ``_`` rewritten to ``-``, as browsers do.
    """
    get = lambda k: F.regexp_extract(url, _GENERIC, k)
    netloc = get(2)
    userinfo = F.regexp_extract(netloc, r"^(.*)@[^@]*$", 1)
    host = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = host.startswith("[")
    raw = F.when(bracketed, F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(host, r"^([^:]*)", 1))
    port = F.when(bracketed, F.regexp_extract(host, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(host, r"^[^:]*:(.*)$", 1))
    clean = F.lower(F.replace(F.trim(unquote(raw)), F.lit("_"), F.lit("-")))
    return F.struct(
        F.lower(get(1)).alias("scheme"),
        quote(unquote(F.regexp_extract(userinfo, r"^([^:]*)", 1)), "").alias("user"),
        quote(unquote(F.regexp_extract(userinfo, r"^[^:]*:(.*)$", 1)), "").alias("password"),
        bracketed.alias("brackets"),
        raw.alias("raw_hostname"),
        clean.alias("hostname"),
        port.alias("port"),
        get(3).alias("raw_path"),
        F.when((get(4) != "") | url.endswith("?"), "?").otherwise("").alias("oqm"),
        get(4).alias("raw_query"),
        F.when((get(5) != "") | url.endswith("#"), "#").otherwise("").alias("ofm"),
        get(5).alias("fragment"),
    )


@F.pandas_udf(T.StringType())
def idn_host(host: pd.Series) -> pd.Series:
    """Punycode form of host names; names that cannot be encoded stay as they are."""
    try:
        import idna

        encode = lambda h: idna.encode(h, uts46=True).decode("ascii")
    except ImportError:
        encode = lambda h: h.encode("idna").decode("ascii")
    known: dict[str, str] = {}

    def one(h: str | None) -> str | None:
        if not h or h.isascii():
            return h
        if h not in known:
            try:
                known[h] = encode(h)
            except Exception:
                known[h] = h
        return known[h]

    return host.map(one)


def rhostname(hostname: Column) -> Column:
    return F.array_join(F.reverse(F.split(hostname, "[.]")), ".")


def path_parts(raw_path: Column) -> Column:
    return F.transform(F.split(raw_path, "/"), lambda x: unquote(x))


def npath_parts(raw_path: Column) -> Column:
    """Path parts without empty ones and dots; ``..`` removes the part before it, if there is one."""
    none = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(path_parts(raw_path), none, step)


def query_parts(raw_query: Column) -> Column:
    """Array of (k, v): ``a`` has a null value, ``a=`` an empty one; ``&`` and ``;`` separate."""

    def one(x: Column) -> Column:
        at = F.instr(x, "=")
        return F.struct(unquote(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x), plus=True).alias("k"), unquote(F.when(at > 0, F.substring(x, at + 1, F.length(x))), plus=True).alias("v"))

    return F.transform(F.split(raw_query, "[&;]"), one)


def query_nparts(raw_query: Column) -> Column:
    return F.filter(query_parts(raw_query), lambda p: F.coalesce(p["v"], F.lit("")) != "")


def unparse_path(parts_: Column) -> Column:
    return F.array_join(F.transform(parts_, lambda x: quote(x, ":")), "/")


def unparse_query(pairs: Column) -> Column:
    one = lambda p: F.when(p["v"].isNull(), quote(p["k"], "", plus=True)).otherwise(F.concat(quote(p["k"], "", plus=True), F.lit("="), quote(p["v"], "", plus=True)))
    return F.array_join(F.transform(pairs, one), "&")


def _only(value: Column, chars: str) -> Column:
    """Percent-escape just ``%`` and ``chars``: the quoting of file names."""
    for char in "%" + chars:
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return value


def parts_to_path(parts_: Column) -> Column:
    return F.array_join(F.transform(parts_, lambda x: _only(x, "/?")), "/")


def query_to_path(pairs: Column) -> Column:
    one = lambda p: F.when(p["v"].isNull(), _only(p["k"], "/&=")).otherwise(F.concat(_only(p["k"], "/&="), F.lit("="), _only(p["v"], "/&")))
    return F.array_join(F.transform(pairs, one), "&")


def _netloc(p: Column, host: Column) -> Column:
    auth = F.when(p["user"] == "", "").when(p["password"] == "", F.concat(p["user"], F.lit("@"))).otherwise(F.concat(p["user"], F.lit(":"), p["password"], F.lit("@")))
    host = F.when(p["brackets"], F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.concat(auth, host, F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"])))


def net_url(p: Column, host: Column | None = None) -> Column:
    """The form that is sent: quoted path and query, no fragment. ``host``: an encoded host name."""
    path = unparse_path(path_parts(p["raw_path"]))
    nl = _netloc(p, p["hostname"] if host is None else host)
    slash = F.when((path == "") & (p["raw_hostname"] != ""), "/").otherwise("")
    query = F.when(p["raw_query"] == "", "").otherwise(unparse_query(query_parts(p["raw_query"])))
    return F.concat(p["scheme"], F.lit(":"), F.when(p["raw_hostname"] == "", "").otherwise(F.concat(F.lit("//"), nl)), path, slash, p["oqm"], query)


def pretty_net_url(p: Column) -> Column:
    slash = F.when((p["raw_path"] == "") & (p["raw_hostname"] != ""), "/").otherwise("")
    query = F.when(p["raw_query"] == "", "").otherwise(query_to_path(query_parts(p["raw_query"])))
    return F.concat(p["scheme"], F.lit(":"), F.when(p["raw_hostname"] == "", "").otherwise(F.concat(F.lit("//"), _netloc(p, p["hostname"]))), parts_to_path(path_parts(p["raw_path"])), slash, p["oqm"], query)


def pretty_net_nurl(p: Column) -> Column:
    """As ``pretty_net_url`` with dots resolved and empty query values left out."""
    npath = parts_to_path(npath_parts(p["raw_path"]))
    ends = p["raw_path"].endswith("/")
    query = F.when(p["raw_query"] == "", "").otherwise(query_to_path(query_nparts(p["raw_query"])))
    with_host = F.concat(F.lit("//"), _netloc(p, p["hostname"]), F.lit("/"), npath, F.when(ends & (npath != ""), "/").otherwise(""))
    return F.concat(p["scheme"], F.lit(":"), F.when(p["raw_hostname"] == "", F.concat(npath, F.when(ends, "/").otherwise(""))).otherwise(with_host), p["oqm"], query)


def with_fragment(url: Column, p: Column) -> Column:
    return F.concat(url, p["ofm"], p["fragment"])


def file_parts(p: Column, extensions: Column, default: str = "index") -> Column:
    """Where a document of a MIME type with these extensions would be saved: (parts, ext)."""
    own = npath_parts(p["raw_path"])
    first = F.coalesce(F.get(extensions, F.lit(0)), F.lit(".data"))
    last = F.lower(F.element_at(own, -1))
    ext = F.regexp_extract(last, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(last, F.lit(1), F.length(last) - F.length(ext))
    head = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    put = lambda parts_, e: F.struct(parts_.alias("parts"), e.alias("ext"))
    index = put(F.concat(own, F.array(F.lit(default))), first)
    return (
        F.when((F.size(own) == 0) | p["raw_path"].endswith("/"), index)
        .when(ext == "", index)
        .when(F.array_contains(extensions, ext), put(F.concat(head, F.array(stem)), ext))
        .when(F.size(extensions) > 0, put(F.concat(head, F.array(last)), first))
        .when(ext == ".data", put(F.concat(head, F.array(stem)), ext))
        .otherwise(put(F.concat(head, F.array(last)), F.lit(".data")))
    )


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link on a page, without fragment; null for other schemes than http(s)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]*/.*/|://[^/]*/)[^/]*$", "$1")
    folder = F.when(folder.rlike("://[^/]*$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    bare = F.regexp_replace(F.trim(link), "#.*$", "")
    joined = (
        F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), bare))
        .when(bare.startswith("/"), F.concat(origin, bare))
        .when(bare.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), bare))
        .when(bare == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(folder, bare))
    )
    return F.when(joined.rlike("(?i)^https?://"), joined)
