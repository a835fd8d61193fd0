"""WARC archives with revisit records, written and read by Spark.

Writing: payload digests are computed with the scan and only headers (digest, page_id) are shuffled
to find, for payloads of at least ``LEAST`` bytes, the smallest page_id. Other records with that
payload become ``revisit`` records without the payload, with fresh headers that refer to the
response. Records are written by Spark's text writer as gzip'd part files, one for each partition,
through whatever file system the path names.

Reading: part files are streamed record by record, cut at the version line and joined again by
Content-Length, so payloads may contain anything, version lines too. Every payload's digest is
computed anew and compared with its header. Revisits are joined to their responses by record id.

Defined cases: a null html is an empty payload; a null url has no target header; line breaks in urls
are percent-encoded; all rows tied at the smallest page_id are responses; rows without a page_id
revisit the others if there are any; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import join_salted, join_sized, shared_dir, stored

VERSION = "WARC/1.1\r\n"
#: Payloads of fewer bytes are always stored whole.
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, refers_to_id string, page_id bigint, url string, payload_digest string, payload_bytes bigint, payload binary"


def _line(name: str, value: F.Column) -> F.Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def _record_id(page_id: F.Column, digest: F.Column) -> F.Column:
    h = F.sha2(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), digest).cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))


def deduplicated(pages: DataFrame) -> DataFrame:
    """Rows of pages with payload, payload_digest, payload_bytes, record_type and refers_to."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("payload_bytes") >= LEAST).select("page_id", "payload_digest").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    marked = join_sized(rows, stored(shared, "payloads"), ["payload_digest"], "left", row_bytes=96)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return marked.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write a record for every row of ``pages`` as gzip'd WARC part files under ``path``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n"),
    )
    deduplicated(pages).select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Whole records from rows that were cut at every version line."""
    held = b""
    for batch in batches:
        found = []
        for piece in batch.column(0).to_pylist():
            held = held + VERSION.encode() + piece if held else piece
            head, gap, rest = held.partition(b"\r\n\r\n")
            if not gap:
                if held.strip():
                    continue
                held = b""
                continue
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogateescape").split("\r\n"))}
            size = int(fields["content-length"])
            if len(rest) < size:
                continue
            block, held = rest[:size], b""
            payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
            kind, stated = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:")
            digest = stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()
            if stated and stated != digest:
                raise ValueError(f"record {fields.get('warc-record-id')} does not match its digest")
            page = fields.get("warc-page-id")
            found.append((kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), int(page) if page else None, fields.get("warc-target-uri"), digest, None if kind == "revisit" else len(payload), payload if payloads and kind != "revisit" else None))
        columns = list(zip(*found)) or [()] * 8
        types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in RECORDS.split(", ")])
    if held:
        raise ValueError("the archive ends within a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the gzip'd archives under ``path``; revisits have no payload and no size yet."""
    lines = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(lambda b: _records(b, payloads), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits joined to their responses: size (and payload, if read) and refers_to."""
    response = F.col("record_type") != "revisit"
    whole = records.where(response).withColumn("refers_to", F.lit(None).cast("bigint"))
    originals = records.where(response).groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload").alias("payload"), F.first("payload_digest").alias("original"))
    back = join_salted(records.where(~response).drop("payload_bytes", "payload"), originals, ["refers_to_id"], "left")
    back = back.withColumn("payload_digest", F.when(F.col("original") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no original response for "), F.col("record_id")))))
    return whole.unionByName(back.drop("original"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/webstrata/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = stored(read_archives(spark, path, payloads=False), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP10_SQL = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
