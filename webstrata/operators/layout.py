"""Laying out an archive as files: path templates, numbers that keep paths apart, update policies,
content-addressed storage and export bundles. Each returns a plan; ``sinks`` carries plans out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import expressions as X
from webstrata.functions import pipes, urls


def day(prefix: str = "s") -> Column:
    return F.concat(F.col(f"{prefix}year").cast("string"), F.lit("/"), _two(f"{prefix}month"), F.lit("/"), _two(f"{prefix}day"))


def _two(name: str) -> Column:
    return F.lpad(F.col(name).cast("string"), 2, "0")


def clock() -> Column:
    return F.concat(_two("shour"), _two("sminute"), _two("ssecond"), F.lpad(F.col("stime_msq").cast("string"), 3, "0"))


def moment() -> Column:
    return F.concat(F.col("syear").cast("string"), F.lit("-"), _two("smonth"), F.lit("-"), _two("sday"), F.lit("_"), clock())


def url_tag() -> Column:
    """The first two bytes of the URL's digest."""
    return X.to_hex(X.take_prefix(X.sha256(X.to_utf8(F.col("net_url"))), 2))


def _file(normal: bool, room: int) -> Column:
    query = F.col("mq_nquery" if normal else "mq_query")
    return F.concat(urls.parts_to_path(X.abbrev_each(F.col("filepath_parts"), 120)), F.col("oqm"), X.abbrev(query, room))


def _flat() -> Column:
    one = X.abbrev(X.replace(urls.parts_to_path(X.abbrev_each(F.col("filepath_parts"), 120)), "/", "__"), 120)
    return F.concat(one, F.col("oqm"), X.abbrev(F.col("mq_nquery"), 100))


_TAILS = {"m": lambda: F.col("method"), "h": url_tag, "s": lambda: F.col("status"), "t": moment}


def template(alias: str, df: DataFrame | None = None) -> Column:
    """The path of a named layout, without its number: ``{num}`` stands where the number goes.

    ``format:`` and a text gives a layout of one's own, compiled over the columns of ``df``.

    Names are built from letters: s scheme, (r)h (reversed) host, u path, p q path and query, n
    normalised; after the underscore m method, h URL digest, s status, t time, n number.
    """
    if alias.startswith("format:"):
        return pipes.compile_template(df, alias.removeprefix("format:"))
    number = F.lit("{num}")
    if alias == "default":
        return F.concat(day(), F.lit("/"), clock(), F.lit("_"), F.col("qtime_ms").cast("string"), F.lit("_"), F.col("method"), F.lit("_"), url_tag(), F.lit("_"), F.col("status"), F.lit("_"), F.col("hostname"), F.lit("_"), number)
    if alias == "short":
        return F.concat(day(), F.lit("/"), F.col("stime_ms").cast("string"), F.lit("_"), F.col("qtime_ms").cast("string"), F.lit("_"), number)
    base, _, tail = alias.partition("_")
    marks = [_TAILS[c]() if c != "n" else number for c in tail]
    joined = F.concat_ws("_", *marks) if marks else None
    if base in ("url", "surl"):
        head = F.concat(F.col("netloc"), F.lit("/"), F.col("mq_npath"), F.col("oqm"), F.col("mq_query"))
        out = F.concat(F.col("scheme"), F.lit("/"), head) if base == "surl" else head
        return F.concat(out, F.lit("__"), joined) if marks else out
    if base == "flat":
        out = F.concat(F.col("hostname"), F.lit("/"), _flat())
    else:
        rest = base
        lead = []
        if rest.startswith("s"):
            lead, rest = [F.col("scheme"), F.lit("/")], rest[1:]
        host = F.col("rhostname" if rest.startswith("r") else "hostname")
        rest = rest.removeprefix("r")
        if rest not in ("hupq", "hupnq"):
            raise ValueError(f"unknown layout {alias!r}")
        short = tail.startswith("m") and tail != "mhs"
        out = F.concat(*lead, host, F.lit("/"), _file(rest == "hupnq", 100 if short else 120))
    return F.concat(out, F.lit("."), joined, F.col("filepath_ext")) if marks else F.concat(out, F.col("filepath_ext"))


def numbered(df: DataFrame, path: str = "path", content: str = "sha256", seq: str = "seq") -> DataFrame:
    """Give equal paths different numbers, in order of arrival.

    Rows with the same path and content are one file (the first arrival stays), others count up.
    """
    once = df.groupBy(path, content).agg(F.min_by(F.struct(*[c for c in df.columns if c not in (path, content)]), F.col(seq)).alias("_row")).select(path, content, "_row.*")
    num = F.row_number().over(Window.partitionBy(path).orderBy(seq)) - 1
    return once.withColumn("num", num).withColumn(path, F.replace(F.col(path), F.lit("{num}"), F.col("num").cast("string")))


def plan(rows: DataFrame, existing: DataFrame | None = None, mode: str = "error", path: str = "path", content: str = "sha256", time: str = "stime_ms", seq: str = "seq") -> DataFrame:
    """What to do for every destination: ``(path, content, action, ...)``.

    Modes: ``latest`` replaces unless the stored row is newer, ``overwrite`` lets the last arrival
    win, ``keep`` leaves what is there, ``error`` reports differing rows as ``conflict``. Equal content
    is always ``noop``. ``existing`` has the columns path, content and time of stored files.
    """
    order = {"latest": F.max_by, "overwrite": F.max_by, "keep": F.min_by, "error": F.min_by}[mode]
    by = F.struct(time, seq) if mode == "latest" else F.struct(seq)
    others = F.struct(*[c for c in rows.columns if c != path])
    chosen = rows.groupBy(path).agg(order(others, by).alias("_row"), F.count_distinct(content).alias("_kinds")).select(path, "_row.*", "_kinds")
    if existing is None:
        here = chosen.withColumn("_old", F.lit(None).cast("string")).withColumn("_old_time", F.lit(None).cast("long"))
    else:
        here = chosen.join(existing.select(path, F.col(content).alias("_old"), F.col(time).alias("_old_time")), path, "left")
    action = F.when(F.col("_old") == F.col(content), "noop")
    if mode == "error":
        action = action.when(F.col("_old").isNotNull() | (F.col("_kinds") > 1), "conflict")
    elif mode == "keep":
        action = action.when(F.col("_old").isNotNull(), "keep")
    elif mode == "latest":
        action = action.when(F.col("_old_time") > F.col(time), "keep")
    return here.withColumn("action", action.when(F.col("_old").isNotNull(), "replace").otherwise("write")).drop("_old", "_old_time", "_kinds")


def check_mode(mode: str, action: str) -> None:
    """Updating to the latest loses data unless files are linked: those are refused."""
    if mode == "latest" and action in ("move", "copy", "hardlink"):
        raise ValueError(f"latest needs symlinks, not {action}")


def content_path(digest: Column, extension: Column) -> Column:
    """Where a document of that SHA-256 (hex) lies in a content-addressed store."""
    return F.concat(F.lit("_content/sha256/"), F.left(digest, F.lit(2)), F.lit("/"), digest, extension)


def content_store(df: DataFrame, content: str = "content", extension: str = "extension") -> DataFrame:
    """One row for each distinct document, with its path and the number of rows that share it.

    Only digests are aggregated; the documents themselves are fetched from one row of each.
    """
    rows = df.withColumn("sha256", F.sha2(F.col(content), 256))
    slim = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("uses"), F.min(extension).alias("extension"))
    return slim.withColumn("path", content_path(F.col("sha256"), F.col("extension")))


def with_content(stored: DataFrame, df: DataFrame, content: str = "content") -> DataFrame:
    """Add each stored document's bytes, from one of the rows that have it."""
    rows = df.select(F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content"))
    return stored.join(rows.dropDuplicates(["sha256"]), "sha256")


def request_id(method: Column, net_url: Column, body: Column) -> Column:
    return F.concat_ws(" ", method, net_url, F.sha2(F.coalesce(body, F.lit("").cast("binary")), 256))


#: Numbers of arrival that are packed into bundles by one task.
LANE = 100_000


def bundles(rows: DataFrame, max_size: int, bucket: str = "bucket", seq: str = "seq", size: str = "size", lane: Column | None = None) -> DataFrame:
    """Number the export bundle of every row: a bundle is closed before it would pass ``max_size``.

    The packing is in order of arrival, within lanes of a bucket: by default ``LANE`` numbers of ``seq``,
    so that no bucket has to fit one task. Only sizes are packed. A lane's last bundle may be small.
    """
    slim = rows.select(F.col(bucket).alias("bucket"), (lane if lane is not None else F.floor(F.col(seq) / LANE)).cast("long").alias("lane"), F.col(seq).alias("seq"), F.col(size).cast("long").alias("size"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        number, held, out = 0, 0, []
        for n in pdf["size"]:
            if held and held + n > max_size:
                number, held = number + 1, 0
            out.append(number)
            held += n
            if held > max_size:
                number, held = number + 1, 0
        return pdf.assign(bundle=out)

    return slim.groupBy("bucket", "lane").applyInPandas(pack, "bucket string, lane long, seq long, size long, bundle long")


def carry_out(plan_: DataFrame, content: str, target: str) -> DataFrame:
    """Write the documents of a plan (path, action, content) below the folder ``target``.

    Rows to ``write`` or ``replace`` are written by the tasks that hold them, to a name of their own
    first and then moved in one step, so a task that is run again does no harm; others are left. Returns
    path, action and ``done``. Paths must stay below the folder. ``target`` is a folder that all
    executors share.
    """
    import os
    from collections.abc import Iterator

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, action, data in zip(batch["path"], batch["action"], batch["content"]):
                place = os.path.normpath(os.path.join(target, path))
                if not place.startswith(os.path.normpath(target) + os.sep):
                    raise ValueError(f"{path} is not below {target}")
                if action in ("write", "replace"):
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    part = f"{place}.{os.getpid()}.part"
                    with open(part, "wb") as file:
                        file.write(data)
                    os.replace(part, place)
                done.append(action in ("write", "replace"))
            yield batch[["path", "action"]].assign(done=done)

    return plan_.select("path", "action", F.col(content).cast("binary").alias("content")).mapInPandas(write, "path string, action string, done boolean")


def landing_path(bucket: Column, epoch: Column, server: Column, number: Column) -> Column:
    """Where a submitted dump lands: bucket, day, and a name of second, server and number within it."""
    at = F.timestamp_seconds(epoch)
    return F.concat(bucket, F.lit("/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), epoch.cast("string"), F.lit("_"), server.cast("string"), F.lit("_"), number.cast("string"), F.lit(".wrr"))
