"""Writers: value streams as JSON or raw bytes, path lists, documents by path, bundles.

They go through Spark's writers, so any file system works and a failed task leaves no half output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.expressions import abridge


def json_rows(*values: Column, abridged: bool = False) -> Column:
    """One JSON list a row; bytes are read as UTF-8 with replacements."""
    items = []
    for v in values:
        text = F.make_valid_utf8(v.cast("string"))
        items.append(F.to_json(F.array(abridge(text) if abridged else text)))
    return F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_replace(F.regexp_replace(i, r"^\[", ""), r"\]$", "") for i in items]), F.lit("]"))


def write_json(df: DataFrame, path: str, *values: Column) -> None:
    df.select(json_rows(*values).alias("value")).write.text(path)


def write_raw(df: DataFrame, path: str, *values: Column, terminator: str = "\n") -> None:
    """Raw values, each followed by the terminator; missing ones are empty."""
    cells = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    df.select(F.concat_ws(terminator, *cells).alias("value")).write.option("lineSep", terminator).text(path)


def write_paths(df: DataFrame, path: str, terminator: str = "\n") -> None:
    """The ``find`` listing."""
    write_raw(df, path, F.col("source_path"), terminator=terminator)


def describe(df: DataFrame, body_chars: int = 1024) -> DataFrame:
    """A readable block of text for each exchange."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("-")))
    heads = lambda h: F.array_join(F.transform(h, lambda x: F.concat(F.lit("  "), x["name"], F.lit(": "), F.make_valid_utf8(x["value"].cast("string")))), "\n")
    body = lambda b: abridge(F.make_valid_utf8(b.cast("string")), body_chars)
    return df.select(
        F.concat_ws("\n", line("source", F.col("source_path")), line("protocol", F.col("protocol")), line("request", F.concat_ws(" ", "request.method", "request.url")), heads(F.col("request.headers")), body(F.col("request.body")),
                    line("response", F.concat_ws(" ", F.col("response.code").cast("string"), "response.reason")), heads(F.col("response.headers")), body(F.col("response.body")), line("finished", F.timestamp_millis("finished_at_ms"))).alias("value")
    )


def write_bundles(dumps: DataFrame, path: str) -> None:
    """Dumps as Parquet by bucket and bundle: each bundle's dumps lie together, in order."""
    dumps.repartition("bucket", "bundle").sortWithinPartitions("bucket", "bundle", "seq").write.partitionBy("bucket").parquet(path)


def cbor_rows(df: DataFrame, *values: Column) -> DataFrame:
    """One CBOR list a row (``value``, binary) of the values of each row; bytes stay bytes."""
    import pandas as pd

    from webstrata.sources.wrr import encode

    def plain(x: object) -> object:
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
            return [plain(v) for v in (x.tolist() if hasattr(x, "tolist") else x)] if not hasattr(x, "dtype") or x.ndim else x.item()
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else bytes(x) if isinstance(x, bytearray) else x

    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"value": [encode([plain(v) if not (isinstance(v, float) and v != v) else None for v in row]) for row in batch.itertuples(index=False)]})

    return df.select(*[v.alias(f"v{k}") for k, v in enumerate(values)]).mapInPandas(pack, "value binary")


def cbor_stream(parts: list[bytes]) -> bytes:
    """Encoded values as one CBOR list of unstated length."""
    return b"\x9f" + b"".join(parts) + b"\xff"


def _bytes_literal(digits: Column) -> Column:
    """A Python literal of bytes, given in hex."""
    code = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    plain = lambda c: (c >= 32) & (c < 127) & ~c.isin(39, 92)
    shown = lambda k: F.when(plain(code(k)), F.char(code(k))).otherwise(F.concat(F.lit("\\x"), F.lower(F.substring(digits, 2 * k + 1, F.lit(2)))))
    each = F.when(F.length(digits) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(digits) / 2) - 1, F.lit(0)).cast("int")), shown))
    return F.concat(F.lit("b'"), F.array_join(each, ""), F.lit("'"))


def python_rows(*values: Column) -> Column:
    """One Python list a row: strings and bytes as literals, numbers and truth values bare, lists and structs as lists of those."""
    quoted = lambda text: F.concat(F.lit("'"), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    # names and numbers outside of the strings of a JSON text
    word = lambda text, old, new: F.regexp_replace(text, rf'\b{old}\b(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)', new)

    def one(v: Column) -> Column:
        kind, bare = F.typeof(v), v.cast("string")
        nested = F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
        for old, new in (("true", "True"), ("false", "False"), ("null", "None")):
            nested = word(nested, old, new)
        shown = F.when(kind == "string", quoted(bare)).when(kind == "binary", _bytes_literal(F.hex(bare))).when(kind == "boolean", F.initcap(bare)).when(kind.startswith("array") | kind.startswith("struct") | kind.startswith("map"), nested).when(kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal"), bare)
        return F.coalesce(shown.otherwise(quoted(bare)), F.lit("None"))

    return F.concat(F.lit("["), F.concat_ws(", ", *[one(v) for v in values]), F.lit("]"))


def write_bundle_files(dumps: DataFrame, folder: str) -> DataFrame:
    """Write each bundle (bucket, lane, bundle, seq, dump) as one gzip'd file of dumps below ``folder``.

    A group is one bundle, whose size ``layout.bundles`` has bounded. Files are moved into place in one
    step, so a task that is run again does no harm. Returns path, rows and bytes; ``folder`` is shared.
    """
    import pandas as pd

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import gzip
        import os

        first = pdf.sort_values("seq")
        bucket, lane, bundle = first[["bucket", "lane", "bundle"]].iloc[0]
        name = "".join(c if c.isalnum() or c in "._-" else f"%{ord(c):02X}" for c in str(bucket))
        path = os.path.join(folder, name, f"{lane}_{bundle}.wrrb")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}.part", "wb") as file, gzip.GzipFile("", "wb", 9, file, 0) as packed:
            for dump in first["dump"]:
                packed.write(gzip.decompress(dump) if dump[:2] == b"\x1f\x8b" else dump)
        os.replace(f"{path}.{os.getpid()}.part", path)
        return pd.DataFrame({"path": [path], "rows": [len(first)], "bytes": [os.path.getsize(path)]})

    return dumps.groupBy("bucket", "lane", "bundle").applyInPandas(write, "path string, rows long, bytes long")
