"""The pipe expression atoms as functions of columns: ``abbrev(col, 120)`` stands for ``x|abbrev 120``.

A pipe is written as nested calls or with ``Column.transform``; Spark's own parser reads SQL text, so
there is no second expression language. Functions keep the two-valued meaning of missing values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urls import quote, unquote


def default(value: Column, constant) -> Column:
    """Constants replace missing values only: es, eb, false, true, 0, 1."""
    return F.coalesce(value, F.lit(constant))


def missing(value: Column) -> Column:
    return value.isNull()


def falsy(value: Column, kind: str) -> Column:
    """``not``: missing, empty or zero. ``kind`` is string, binary, array, number or boolean."""
    empty = {"string": lambda: F.length(value) == 0, "binary": lambda: F.length(value) == 0, "array": lambda: F.size(value) == 0, "number": lambda: value == 0, "boolean": lambda: ~value}[kind]()
    return F.coalesce(empty, F.lit(True))


def to_utf8(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def to_ascii(value: Column) -> Column:
    """Bytes of an ASCII string; anything else is an error."""
    return F.when(value.rlike(r"^\p{ASCII}*$") | value.isNull(), F.encode(value, "UTF-8")).otherwise(F.raise_error(F.lit("not an ASCII string")).cast("binary"))


def to_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def from_hex(value: Column) -> Column:
    return F.unhex(value)


def sha256(value: Column) -> Column:
    """The 32 raw bytes."""
    return F.unhex(F.sha2(value, 256))


def matches(value: Column, pattern: str) -> Column:
    """``~=``: the pattern matches at the start."""
    return value.rlike(rf"\A(?:{pattern})")


def add_prefix(value: Column, text: str) -> Column:
    return F.concat(F.lit(text), value)


def add_suffix(value: Column, text: str) -> Column:
    return F.concat(value, F.lit(text))


def take_prefix(value: Column, n: int) -> Column:
    """The first n characters or bytes."""
    return F.substring(value, 1, n)


def take_suffix(value: Column, n: int) -> Column:
    return F.right(value, F.lit(n))


def abbrev(value: Column, n: int) -> Column:
    """Strings longer than n keep their first and last n/2 characters."""
    half = n // 2
    return F.when(F.length(value) <= n, value).otherwise(F.concat(F.left(value, F.lit(half)), F.right(value, F.lit(half))))


def abbrev_each(values: Column, n: int) -> Column:
    return F.transform(values, lambda x: abbrev(x, n))


def abridge(value: Column, n: int = 256) -> Column:
    """For display: first half, dots, last half."""
    return F.when(F.length(value) <= n, value).otherwise(F.concat(F.left(value, F.lit(n // 2)), F.lit(" ... "), F.right(value, F.lit(n // 2))))


def replace(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def strict_bool(value: Column) -> Column:
    """Strings are true if not empty, whatever they say."""
    return F.length(value) > 0


ATOMS = {
    "missing": missing, "len": F.length, "quote": quote, "unquote": unquote, "to_ascii": to_ascii, "to_utf8": to_utf8, "to_hex": to_hex, "from_hex": from_hex, "sha256": sha256,
    "~=": matches, "add_prefix": add_prefix, "add_suffix": add_suffix, "take_prefix": take_prefix, "take_suffix": take_suffix, "abbrev": abbrev, "abbrev_each": abbrev_each, "replace": replace, "bool": strict_bool,
}
