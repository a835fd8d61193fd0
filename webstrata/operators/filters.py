"""The filter algebra: clauses of an option are alternatives, options are ANDed, and every clause has
a negated twin. Missing values match nothing, so their negation holds (two-valued logic).

Positive clauses stay bare: WHERE drops unknown rows itself, and Spark pushes comparisons of plain
columns to the scan. Only ``negated`` has to make unknown false first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import http, mime


def _known(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def any_of(clauses: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, clauses)


def all_of(clauses: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses)


def negated(predicate: Column) -> Column:
    return ~_known(predicate)


def _time(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else http.interval(value)[0]


def before(stime: Column, *dates: str | datetime) -> Column:
    """Earlier than all of the dates: one comparison with the least, which can be pushed down."""
    return stime < F.lit(min(map(_time, dates)))


def after(stime: Column, *dates: str | datetime) -> Column:
    return stime > F.lit(max(map(_time, dates)))


def not_before(stime: Column, *dates: str | datetime) -> Column:
    """None of the dates is later; an unknown time passes. Written so that it can be pushed down."""
    return stime.isNull() | (stime >= F.lit(max(map(_time, dates))))


def not_after(stime: Column, *dates: str | datetime) -> Column:
    return stime.isNull() | (stime <= F.lit(min(map(_time, dates))))


def text(value: Column, exact: Iterable[str] = (), prefix: Iterable[str] = (), regex: Iterable[str] = ()) -> Column:
    """Equal to one, starting with one, or matched from end to end by one."""
    exact, prefix, regex = list(exact), list(prefix), list(regex)
    clauses = [value.isin(exact)] if exact else []
    clauses += [value.startswith(p) for p in prefix]
    clauses += [value.rlike(rf"\A(?:{r})\z") for r in regex]
    return any_of(clauses)


def url(net_url: Column, pretty_url: Column | None = None, exact: Iterable[str] = (), prefix: Iterable[str] = (), regex: Iterable[str] = ()) -> Column:
    """As ``text`` on the normalised form; a regex may match the readable form as well."""
    regex = list(regex)
    clauses = [text(net_url, exact, prefix, regex)]
    if pretty_url is not None and regex:
        clauses.append(text(pretty_url, regex=regex))
    return any_of(clauses)


def mime_type(value: Column, exact: Iterable[str] = (), prefix: Iterable[str] = (), regex: Iterable[str] = ()) -> Column:
    """As ``text``, with the wanted types made canonical."""
    return text(value, [mime.CANONICAL.get(m, m) for m in exact], prefix, regex)


def _pattern(piece: str, is_regex: bool, case: str) -> str:
    body = piece if is_regex else re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", piece)
    blind = case == "ignore" or (case == "smart" and piece.islower())
    return ("(?iu)" if blind else "") + body


def grep(values: Column, pieces: Iterable[str] = (), regex: Iterable[str] = (), every: bool = False, case: str = "smart") -> Column:
    """Search strings for literals and regexes: any of them, or all (each in some string).

    ``case`` is sensitive, ignore, or smart: ignored if the pattern has no upper case.
    """
    patterns = [_pattern(p, False, case) for p in pieces] + [_pattern(r, True, case) for r in regex]

    def found(pattern: str) -> Column:
        return F.exists(values, lambda v: _known(v.rlike(pattern)))

    hits = [found(p) for p in patterns]
    return all_of(hits) if every else any_of(hits)


def header_lines(headers: Column) -> Column:
    return F.transform(http.raw_headers(headers), lambda h: F.concat(h["name"], F.lit(": "), h["value"]))


def body_text(body: Column) -> Column:
    """Bytes as one character each: a search for latin text works on any encoding's bytes."""
    return F.array(F.decode(body, "ISO-8859-1"))


def apply(df: DataFrame, *clauses: Column | None, name: str | None = None) -> DataFrame:
    """Rows that pass all clauses (None is left out). With ``name`` the run reports, as observed
    metrics of that name, how many rows each clause alone lets through (``clause_0`` ...), out of ``rows``."""
    used = [c for c in clauses if c is not None]
    if name is not None:
        df = df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(_known(c)).alias(f"clause_{k}") for k, c in enumerate(used)])
    return df.where(all_of(used)) if used else df


def redundant(metrics: dict[str, int]) -> list[str]:
    """Names of clauses that let through none or all of the rows."""
    return [k for k, v in metrics.items() if k != "rows" and v in (0, metrics["rows"])]


# Default filters on the status column.
COMPLETE_STATUS = r".(200|30[012378])C"
ROOT_STATUS = r".[23]00C"


def default_inputs(status: Column, *more: str) -> Column:
    """What mirrors and replays index; more patterns widen it."""
    return text(status, regex=[COMPLETE_STATUS, *more])


def default_roots(status: Column, *more: str) -> Column:
    return text(status, regex=[ROOT_STATUS, *more])


def boring_url(url_: Column, own_server: str | None = None) -> Column:
    """URLs of the browser itself, of files, and of the archiving server."""
    hit = url_.rlike(r"(?i)^(about|chrome|moz-extension|chrome-extension|data|file|extension|view-source|resource|blob):")
    return hit | url_.startswith(own_server) if own_server else hit


def rows(session: int | None = None, window: int | None = None, tab: int | None = None, flags: dict[str, bool] | None = None, stores: dict[int, bool] | None = None, method: str | None = None, url_is: str | None = None, url_has: str | None = None, url_matches: str | None = None) -> Column:
    """Filter of capture-log rows. ``flags`` names boolean columns (picked, problematic, in_limbo ...);
    ``stores`` maps a bit of ``archived`` (1 exported, 2 submitted, 4 saved) to whether it is set."""
    clauses = [F.col(c) == v for c, v in (("session_id", session), ("window_id", window), ("tab_id", tab), ("method", method), ("url", url_is)) if v is not None]
    clauses += [F.col(c) == F.lit(v) for c, v in (flags or {}).items()]
    clauses += [(F.col("archived").bitwiseAND(F.lit(bit)) != 0) == F.lit(v) for bit, v in (stores or {}).items()]
    clauses += [F.contains(F.col("url"), F.lit(url_has))] if url_has is not None else []
    clauses += [text(F.col("url"), regex=[url_matches])] if url_matches is not None else []
    return all_of(clauses) if clauses else F.lit(True)
