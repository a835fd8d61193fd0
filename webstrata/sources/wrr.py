"""Reading and writing archives of captured exchanges: one CBOR value a file (``.wrr``) or many
(``.wrrb``), gzip'd or not.

Files are found and read by Spark (``binaryFile``, any file system); decoding is a small helper over
Arrow batches. Rows that do not parse carry ``error`` and the policy decides: fail, skip or ignore.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import SCHEMES
from webstrata.schema import EXCHANGE

MAGIC = "WEBREQRES/1"
_END = object()


def decode(data: bytes, at: int = 0) -> tuple[object, int]:
    """One CBOR value and the place after it."""
    major, minor = data[at] >> 5, data[at] & 31
    at += 1
    if minor < 24:
        n = minor
    elif minor < 28:
        size = 1 << (minor - 24)
        n = int.from_bytes(data[at : at + size], "big")
        if len(data) < at + size:
            raise ValueError("truncated value")
        at += size
    elif minor == 31 and major in (2, 3, 4, 5, 7):
        n = -1
    else:
        raise ValueError("malformed value")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n < 0:
            parts = []
            while (item := decode(data, at))[0] is not _END:
                parts.append(item[0])
                at = item[1]
            return (b"" if major == 2 else "").join(parts), item[1]
        if len(data) < at + n:
            raise ValueError("truncated string")
        raw = bytes(data[at : at + n])
        return (raw if major == 2 else raw.decode()), at + n
    if major in (4, 5):
        items: list = []
        while n < 0 or len(items) < n * (1 if major == 4 else 2):
            item, at = decode(data, at)
            if item is _END:
                break
            items.append(item)
        return (items if major == 4 else dict(zip(items[::2], items[1::2]))), at
    if major == 6:
        return decode(data, at)
    if n == -1:
        return _END, at
    if minor in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[minor], data[at - (1 << (minor - 24)) : at])[0], at
    return {20: False, 21: True}.get(n), at


def encode(value: object) -> bytes:
    """CBOR of the values that archives hold."""

    def head(major: int, n: int) -> bytes:
        for size, code in ((0, None), (1, 24), (2, 25), (4, 26), (8, 27)):
            if size == 0 and n < 24:
                return bytes([major << 5 | n])
            if size and n < 1 << (8 * size):
                return bytes([major << 5 | code]) + n.to_bytes(size, "big")
        raise ValueError("number too large")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray)):
        return head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    return head(4, len(value)) + b"".join(encode(x) for x in value)


def _typed(name: str, value: object, *kinds: type) -> object:
    if not isinstance(value, kinds) or (bool not in kinds and isinstance(value, bool)):
        raise ValueError(f"field {name}: {type(value).__name__}")
    return value


def _headers(name: str, value: list) -> list[dict]:
    return [{"name": _typed(name, k, str), "value": v.encode() if isinstance(v, str) else _typed(name, v, bytes)} for k, v in value]


def _body(name: str, value: object) -> tuple[bytes, bool]:
    _typed(name, value, bytes, str)
    return (value.encode(), True) if isinstance(value, str) else (value, False)


def to_row(value: object) -> dict:
    """The columns of an exchange, strictly typed."""
    if not isinstance(value, list) or len(value) != 7 or value[0] != MAGIC:
        raise ValueError("not an exchange of a known format")
    _, agent, protocol, rq, rs, finished, extra = value
    url = _typed("request.url", rq[2], str)
    if url.partition(":")[0].lower() not in SCHEMES:
        raise ValueError("request.url: unsupported scheme")
    body, text = _body("request.body", rq[5])
    request = {"started_at_ms": _typed("request.started_at", rq[0], int), "method": _typed("request.method", rq[1], str), "url": url, "headers": _headers("request.headers", rq[3]), "complete": _typed("request.complete", rq[4], bool), "body": body, "body_is_text": text}
    response = None
    if rs is not None:
        body, text = _body("response.body", rs[5])
        response = {"started_at_ms": _typed("response.started_at", rs[0], int), "code": _typed("response.code", rs[1], int), "reason": _typed("response.reason", rs[2], str), "headers": _headers("response.headers", rs[3]), "complete": _typed("response.complete", rs[4], bool), "body": body, "body_is_text": text}
    extra = dict(extra)
    frames = extra.pop("websocket", None)
    sockets = None if frames is None else [{"sent_at_ms": _typed("ws.sent_at", t, int), "from_client": _typed("ws.from_client", c, bool), "opcode": _typed("ws.opcode", o, int), "content": x.encode() if isinstance(x, str) else _typed("ws.content", x, bytes)} for t, c, o, x in frames]
    return {"version": 1, "agent": agent, "protocol": protocol, "request": request, "response": response, "finished_at_ms": _typed("finished_at", finished, int), "extra": {k: v if isinstance(v, str) else json.dumps(v) for k, v in extra.items()}, "websocket": sockets, "error": None}


def to_value(row: dict) -> list:
    """The CBOR value of a row."""
    body = lambda part: part["body"].decode() if part["body_is_text"] else bytes(part["body"] or b"")
    heads = lambda part: [[h["name"], bytes(h["value"])] for h in part["headers"]]
    rq, rs = row["request"], row["response"]
    extra: dict = {}
    for k, v in dict(row["extra"] or {}).items():
        try:
            extra[k] = json.loads(v)
        except ValueError:
            extra[k] = v
    if row["websocket"] is not None:
        extra["websocket"] = [[f["sent_at_ms"], f["from_client"], f["opcode"], bytes(f["content"])] for f in row["websocket"]]
    response = None if rs is None else [rs["started_at_ms"], rs["code"], rs["reason"], heads(rs), rs["complete"], body(rs)]
    return [MAGIC, row["agent"], row["protocol"], [rq["started_at_ms"], rq["method"], rq["url"], heads(rq), rq["complete"], body(rq)], response, row["finished_at_ms"], extra]


def _rows(path: str, content: bytes, loader: str) -> Iterator[dict]:
    single = loader == "wrr" or (loader == "auto" and not path.endswith(".wrrb"))
    bad = {"source_path": path, "element_num": None}
    try:
        data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
        at, values = 0, []
        while at < len(data) and not (single and values):
            value, at = decode(data, at)
            values.append(value)
        if single and (not values or at < len(data)):
            raise ValueError("expected exactly one value")
        if loader == "some" and not values:
            raise ValueError("expected a value")
    except (ValueError, IndexError, EOFError, OSError) as exc:
        yield bad | {"error": str(exc) or type(exc).__name__}
        return
    many = not single and not (loader == "some" and len(values) == 1)
    for k, value in enumerate(values):
        place = {"source_path": path, "element_num": k if many else None}
        try:
            yield place | to_row(value)
        except (ValueError, TypeError, AttributeError) as exc:
            yield place | {"error": str(exc)}


def read(spark: SparkSession, paths: str | list[str], loader: str = "auto", errors: str = "fail", glob: str | None = None, boring: bool = False) -> DataFrame:
    """Exchanges of all files below ``paths``, those still being written (``.part``) left out.

    ``loader``: auto (by extension), wrr, wrrb or some (one or many). ``errors``: fail raises at the
    first bad row, skip keeps bad rows with their ``error``, ignore drops them (files of no bytes at all
    are left out by Spark's scan). ``boring`` marks
    low-priority inputs, which are indexed but are no roots.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths).where(~F.col("path").endswith(".part")).select("path", "content")
    names = [f.name for f in EXCHANGE.fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = _rows(path, content, loader)
                while part := list(islice(rows, 500)):  # a bundle's rows go on in parts
                    yield pd.DataFrame([{n: r.get(n) for n in names} for r in part], columns=names, dtype=object)

    rows = files.mapInPandas(parse, EXCHANGE).withColumn("is_boring", F.lit(boring))
    if errors == "ignore":
        return rows.where(F.col("error").isNull())
    if errors == "fail":
        return rows.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("cannot load "), F.col("source_path"), F.lit(": "), F.col("error"))).cast("boolean")))
    return rows


def union(*inputs: DataFrame) -> DataFrame:
    """Several inputs as one, each file once: the first input that has it counts. Only paths are shuffled."""
    out = None
    for k, one in enumerate(inputs):
        numbered = one.withColumn("_input", F.lit(k))
        out = numbered if out is None else out.unionByName(numbered)
    first = out.groupBy(F.col("source_path").alias("_path")).agg(F.min("_input").alias("_first"))
    return out.join(first, (F.col("source_path") == F.col("_path")) & (F.col("_input") == F.col("_first")), "left_semi").drop("_input")


def listed(data: bytes) -> list[str]:
    """The paths of a list in which every one ends with NUL."""
    if data and not data.endswith(b"\0"):
        raise ValueError("the last path does not end with NUL")
    return [p.decode("utf-8", "surrogateescape") for p in data.split(b"\0")[:-1]]


def in_order(rows: DataFrame, paths: list[str], path_order: str = "given", walk_order: str = "sorted") -> DataFrame:
    """Add ``input_seq``, a sort key of rows: the place of the top-level path that a file is below, then the file's own.

    ``path_order`` is given, sorted or reversed; ``walk_order`` sorted or reversed. What comes first or
    last wins in the operators that keep one row of each key by it.
    """
    tops = {"given": paths, "sorted": sorted(paths), "reversed": sorted(paths, reverse=True)}[path_order]
    place = F.lit(len(tops))
    for k, top in reversed(list(enumerate(tops))):
        bare = F.regexp_replace("source_path", r"^file:(//)?", "")
        place = F.when((bare == top) | bare.startswith(top.rstrip("/") + "/"), F.lit(k)).otherwise(place)
    # in hex with its digits reversed and an end mark above them all, what sorted last sorts first
    backwards = F.concat(F.translate(F.hex(F.encode("source_path", "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    walked = {"sorted": F.col("source_path"), "reversed": backwards}[walk_order]
    return rows.withColumn("input_seq", F.struct(place.alias("path"), walked.alias("walk"), F.coalesce("element_num", F.lit(0)).alias("element")))


def unchanged(spark: SparkSession, rows: DataFrame, paths: str | list[str], loaded_at: str = "modified") -> DataFrame:
    """``rows`` (with their file's time as ``loaded_at``), failing if a file has changed since it was read."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("source_path"), F.col("modificationTime").alias("_now"))
    same = F.when(F.col("_now") == F.col(loaded_at), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("source_path"), F.lit(" has changed"))).cast("boolean"))
    return rows.join(now, "source_path", "left").where(same).drop("_now")


def dumps(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``dump``: each exchange's CBOR, gzip'd if that is smaller."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep), "dump binary"])
    cols = [c for c in ("agent", "protocol", "request", "response", "finished_at_ms", "extra", "websocket")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch[cols].to_dict("records"):
                raw = encode(to_value(row))
                small = gzip.compress(raw, 9, mtime=0)
                out.append(small if len(small) < len(raw) else raw)
            yield batch[list(keep)].assign(dump=out)

    return df.select(*keep, *[c for c in cols if c not in keep]).mapInPandas(pack, schema)
