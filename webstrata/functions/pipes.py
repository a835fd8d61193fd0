"""Pipe expressions and path templates written as text, as Spark columns.

A pipe is commands separated by ``|``; each is a name with arguments, quoted as in a shell. It starts
from a missing value. The name of a column, or a constant, fills in where the value is missing; the
other names are functions of it. Types are those that Spark finds for the column so far, so arguments
are read as what they are compared with.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T
from pyspark.sql.utils import AnalysisException

from webstrata.functions import expressions as X
from webstrata.functions import http, mime, scrub, urls


class PipeError(ValueError):
    """A pipe that cannot be compiled: unknown name, wrong number of arguments, or wrong type."""


# The expressions that have a name.
PRESETS = {
    "dot": ".",
    "raw_qbody": "request.body|eb",
    "raw_sbody": "response.body|eb",
    "id": "response.body|eb|scrub response +all_refs",
    "void": "response.body|eb|scrub response -all_refs",
    "open": "response.body|eb|scrub response *all_refs",
    "closed": "response.body|eb|scrub response /all_refs",
    "all": "response.body|eb|scrub response &all_refs",
    "semi": "response.body|eb|scrub response *jumps,/actions,/reqs",
}
CONSTANTS = {"es": "", "eb": bytearray(), "false": False, "true": True, "0": 0, "1": 1}
_TEXTS = (T.StringType, T.BinaryType)
_NUMBERS = (T.IntegralType, T.FractionalType)


def _kind(kind: T.DataType) -> str:
    for name, types in (("string", T.StringType), ("binary", T.BinaryType), ("array", T.ArrayType), ("boolean", T.BooleanType), ("number", _NUMBERS)):
        if isinstance(kind, types):
            return name
    return kind.simpleString()


def _argument(kind: T.DataType, text: str) -> Column:
    """An argument as a literal of the type it is compared with."""
    try:
        value = {"string": lambda: text, "binary": lambda: bytearray(text.encode()), "boolean": lambda: text != "", "number": lambda: float(text) if isinstance(kind, T.FractionalType) else int(text)}[_kind(kind)]()
    except KeyError:
        raise PipeError(f"cannot compare {kind.simpleString()}") from None
    except ValueError:
        raise PipeError(f"{text!r} is no {kind.simpleString()}") from None
    return F.lit(value)


def _cast(to: str) -> Callable[[Column, T.DataType], Column]:
    def run(value: Column, kind: T.DataType) -> Column:
        own = _kind(kind)
        if own == to:
            return value
        if (own, to) == ("binary", "string"):
            return F.decode(value, "UTF-8")
        if (own, to) == ("string", "binary"):
            return X.to_utf8(value)
        if to == "boolean" and own in ("string", "binary"):
            return X.strict_bool(value)
        if to == "boolean" and own == "number":
            return value != 0
        if own in ("string", "number", "boolean") and to in ("bigint", "double", "string"):
            return value.cast(to)
        raise PipeError(f"cannot make {to} of {kind.simpleString()}")

    return run


def _length(value: Column, kind: T.DataType) -> Column:
    if _kind(kind) not in ("string", "binary", "array"):
        raise PipeError(f"{kind.simpleString()} has no length")
    return F.size(value) if _kind(kind) == "array" else F.length(value)


def _slice(value: Column, kind: T.DataType, n: int, end: bool) -> Column:
    if _kind(kind) == "array":
        return F.slice(value, F.greatest(F.size(value) - n + 1, F.lit(1)), F.lit(n)) if end else F.slice(value, 1, n)
    return X.take_suffix(value, n) if end else X.take_prefix(value, n)


def _join(value: Column, kind: T.DataType, text: str, after: bool) -> Column:
    part = _argument(kind, text)
    return F.concat(value, part) if after else F.concat(part, value)


def _number(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise PipeError(f"{text!r} is no number") from None


#: Name: number of arguments, function of (value, its type, arguments).
ATOMS: dict[str, tuple[int, Callable[..., Column]]] = {
    "missing": (0, lambda v, t: v.isNull()),
    "not": (0, lambda v, t: X.falsy(v, _kind(t))),
    "len": (0, _length),
    "str": (0, _cast("string")),
    "bytes": (0, _cast("binary")),
    "bool": (0, _cast("boolean")),
    "int": (0, _cast("bigint")),
    "float": (0, _cast("double")),
    "echo": (1, lambda v, t, a: F.lit(a)),
    "quote": (1, lambda v, t, a: urls.quote(v, a)),
    "quote_plus": (1, lambda v, t, a: urls.quote(v, a, plus=True)),
    "unquote": (0, lambda v, t: urls.unquote(v)),
    "unquote_plus": (0, lambda v, t: urls.unquote(v, plus=True)),
    "to_ascii": (0, lambda v, t: X.to_ascii(v) if _kind(t) == "string" else v),
    "to_utf8": (0, lambda v, t: X.to_utf8(v) if _kind(t) == "string" else v),
    "to_hex": (0, lambda v, t: X.to_hex(v)),
    "from_hex": (0, lambda v, t: X.from_hex(v)),
    "sha256": (0, lambda v, t: X.sha256(v)),
    "~=": (1, lambda v, t, a: X.matches(v, a)),
    "==": (1, lambda v, t, a: v == _argument(t, a)),
    "!=": (1, lambda v, t, a: v != _argument(t, a)),
    "<": (1, lambda v, t, a: v < _argument(t, a)),
    "<=": (1, lambda v, t, a: v <= _argument(t, a)),
    ">": (1, lambda v, t, a: v > _argument(t, a)),
    ">=": (1, lambda v, t, a: v >= _argument(t, a)),
    "add_prefix": (1, lambda v, t, a: _join(v, t, a, False)),
    "add_suffix": (1, lambda v, t, a: _join(v, t, a, True)),
    "take_prefix": (1, lambda v, t, a: _slice(v, t, _number(a), False)),
    "take_suffix": (1, lambda v, t, a: _slice(v, t, _number(a), True)),
    "abbrev": (1, lambda v, t, a: X.abbrev(v, _number(a))),
    "abbrev_each": (1, lambda v, t, a: X.abbrev_each(v, _number(a))),
    "replace": (2, lambda v, t, a, b: X.replace(v, a, b)),
    "parse_path": (0, lambda v, t: urls.path_parts(v)),
    "unparse_path": (0, lambda v, t: urls.unparse_path(v)),
    "parse_query": (0, lambda v, t: urls.query_parts(v)),
    "unparse_query": (0, lambda v, t: urls.unparse_query(v)),
    "pp_to_path": (0, lambda v, t: urls.parts_to_path(v)),
    "qsl_to_path": (0, lambda v, t: urls.query_to_path(v)),
    "scrub": (2, lambda v, t, side, options, df: _scrubbed(v, t, side, options, df)),
}
#: Functions that look at other columns of the row than their own value.
_WHOLE_ROW = {"scrub"}


def _scrubbed(value: Column, kind: T.DataType, side: str, options: str, df: DataFrame) -> Column:
    """The body of that side (request or response) of an exchange, scrubbed as what its type and content say.

    HTML and CSS are rewritten for the row's URL, with the row's ``remap`` if there is such a column; documents
    of kinds that the options ban are blanked, all others are left as they are. The result is binary.
    """
    if side not in ("request", "response"):
        raise PipeError(f"{side!r} is no side of an exchange")
    try:
        chosen = scrub.Options.parse(options)
    except ValueError as wrong:
        raise PipeError(str(wrong)) from None
    data = value if _kind(kind) == "binary" else X.to_utf8(value)
    headers, url = _field(df, f"{side}.headers"), _field(df, "request.url")
    found = mime.discern(http.content_type(http.header_value(headers, "content-type"))["mime"], data)
    remap = F.col("remap") if "remap" in df.columns else F.lit(None).cast("map<string,string>")
    banned = scrub.banned_kinds(chosen)

    def verdict(f: Column) -> Column:
        """What a document is rewritten as, or what stands in for it."""
        has = lambda name: F.coalesce(F.array_contains(f["kinds"], name), F.lit(False))
        hit = F.coalesce(F.arrays_overlap(f["kinds"], F.array(*[F.lit(k) for k in banned])), F.lit(False)) if banned else F.lit(False)
        blank = F.when(hit & ~has("html"), mime.censor(F.lit(""), f["kinds"], banned or [""], chosen.verbose))
        return F.struct(F.when(has("html"), "html").when(has("css") & ~hit, "css").alias("kind"), blank.alias("blank"))

    # the array around the type binds it, so it is found out once
    said = F.get(F.transform(F.array(found), verdict), F.lit(0))
    text = F.make_valid_utf8(data.cast("string"))
    html, css = (scrub.scrubbed(k, chosen)(text, url, remap).cast("binary") for k in ("html", "css"))
    return F.when(said["kind"] == "html", html).when(said["kind"] == "css", css).otherwise(F.coalesce(said["blank"].cast("binary"), data))


def register_atom(name: str, arguments: int, function: Callable[..., Column]) -> None:
    """Add a function to the language; it gets the column so far, its type and the arguments."""
    ATOMS[name] = (arguments, function)


def commands(text: str) -> list[list[str]]:
    """The commands of a pipe, cut into words."""
    words = shlex.shlex(text, posix=True, punctuation_chars="|")
    words.whitespace_split, words.commenters = True, ""
    out: list[list[str]] = [[]]
    for word in words:
        if word == "|":
            out.append([])
        else:
            out[-1].append(word)
    return out


def _field(df: DataFrame, name: str) -> Column:
    """A column or nested field; the whole row for ``.``."""
    if name in ("", "."):
        return F.struct(*[F.col(f"`{c}`") for c in df.columns])
    value = F.col(name.removeprefix("."))
    try:
        df.select(value)
    except AnalysisException:
        raise PipeError(f"unknown name {name!r}") from None
    return value


def compile_pipe(df: DataFrame, text: str) -> Column:
    """The column that a pipe stands for over the rows of ``df``.

    The name of a preset stands for its pipe, unless ``df`` has a column of that name.
    """
    now: Column | None = None
    for name, *arguments in (c or [""] for c in commands(text)):
        if name in ATOMS:
            count, function = ATOMS[name]
            if len(arguments) != count:
                raise PipeError(f"{name!r} takes {count} arguments, not {len(arguments)}")
            value = F.lit(None).cast("string") if now is None else now
            now = function(value, df.select(value).schema[0].dataType, *arguments, *([df] if name in _WHOLE_ROW else []))
            continue
        if arguments:
            raise PipeError(f"{name!r} takes no arguments")
        if name in PRESETS and name not in df.columns and name != "dot":
            now = compile_pipe(df, PRESETS[name]) if now is None else F.coalesce(now, compile_pipe(df, PRESETS[name]))
            continue
        found = F.lit(CONSTANTS[name]) if name in CONSTANTS else _field(df, "." if name == "dot" and name not in df.columns else name)
        now = found if now is None else F.coalesce(now, found)
    return now


def condition(df: DataFrame, every: list[str] = (), some: list[str] = ()) -> Column | None:
    """``--and`` and ``--or``: all of ``every`` hold and, if there are any, one of ``some``.

    Only boolean pipes are taken; a missing result is false.
    """

    def boolean(text: str) -> Column:
        value = compile_pipe(df, text)
        if not isinstance(df.select(value).schema[0].dataType, T.BooleanType):
            raise PipeError(f"{text!r} is no condition")
        return F.coalesce(value, F.lit(False))

    clauses = [boolean(t) for t in every]
    if some:
        clauses.append(reduce(lambda a, b: a | b, [boolean(t) for t in some]))
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def get(df: DataFrame, *pipes: str) -> tuple | None:
    """The values of pipes over one row."""
    row = df.select(*[compile_pipe(df, p).alias(f"v{k}") for k, p in enumerate(pipes)]).first()
    return None if row is None else tuple(row)


_SLOT = re.compile(r"%(?:\(((?:[^()\\]|\\.)*)\)([-0-9]*)([sd])|(%))")


def compile_template(df: DataFrame, text: str) -> Column:
    """The column of a path template with ``%(pipe)s`` and ``%(pipe)02d`` slots.

    ``%(num)d`` becomes ``{num}``, which ``layout.numbered`` replaces.
    """
    pieces, at = [], 0
    for slot in _SLOT.finditer(text):
        pieces.append(F.lit(text[at : slot.start()]))
        at = slot.end()
        if slot[4]:
            pieces.append(F.lit("%"))
        elif slot[1] == "num":
            pieces.append(F.lit("{num}"))
        else:
            value = compile_pipe(df, slot[1])
            shown = value.cast("bigint") if slot[3] == "d" else value.cast("string")
            pieces.append(F.format_string(f"%{slot[2]}{slot[3]}", shown) if slot[2] else shown.cast("string"))
    rest = text[at:]
    if "%" in rest or any("%" in text[a.end() : b.start()] for a, b in zip(list(_SLOT.finditer(text)), list(_SLOT.finditer(text))[1:])):
        raise PipeError(f"bad template {text!r}")
    return F.concat(*pieces, F.lit(rest))
