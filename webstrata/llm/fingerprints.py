"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Every 5-word shingle of the whole text is hashed once. The hash's high bits choose one of ``BINS``
bins, which keeps its smallest hash. An empty bin borrows from the first full bin of its own fixed
probe sequence (optimal densification), so equal likeness is expected of every bin. The low
``BITS`` bits of each bin are packed and written as hex. Likeness is the share of agreeing bins,
corrected for the 2^-BITS that agree by chance: (share - c) / (1 - c), cut to 0..1.

Words are lower-cased runs of digits, letters and non-ASCII characters, as in decontamination.

Defined cases: a null text is empty; a text without words has the empty fingerprint, whose likeness
is 1 to another empty one and 0 to others; one to four words make one shingle. Rows with equal
doc_id are ordered by a hash of the text, null ids come last; such rows are dealt to several tasks if
they are many. Rows that are equal in both have copies of one guest after them. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from webstrata.llm import kernels as K
from webstrata.llm.common import cut, partitions

BINS, BITS = 512, 4
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Row b: the order in which empty bin b looks at the other bins; the same for every document.
_PROBES = np.stack([np.random.default_rng(b).permutation(np.delete(np.arange(BINS), b)) for b in range(BINS)]).astype(np.int64)

ROWS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _densify(table: np.ndarray) -> None:
    """Fill the empty bins of all rows that have a full one."""
    full = table != _NONE
    row, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    for attempt in range(BINS - 1):
        if not len(row):
            return
        source = _PROBES[empty, attempt]
        hit = full[row, source]
        table[row[hit], empty[hit]] = table[row[hit], source[hit]]
        row, empty = row[~hit], empty[~hit]


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin (rows x BINS) and which texts have any word."""
    bits, some = np.zeros((len(texts), BINS), np.uint8), np.zeros(len(texts), np.bool_)
    for w in K.words(texts):
        values, offsets = K.shingles(w)
        count = np.diff(offsets)
        table = np.full((len(w.docs), BINS), _NONE)
        of = np.repeat(np.arange(len(w.docs)), count)
        np.minimum.at(table.reshape(-1), of * BINS + (values >> _SHIFT).astype(np.int64), values)
        _densify(table)
        bits[w.docs.start : w.docs.stop] = (table & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        some[w.docs.start : w.docs.stop] = count > 0
    return bits, some


def packed(bits: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins a byte, as hex; the empty string for texts without words."""
    rows = K.hex_rows((bits[:, 0::2] << BITS) | bits[:, 1::2])
    return [x if s else "" for x, s in zip(rows, some)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bias-corrected likeness of two lists of sketches, row by row."""
    chance = 1 / (1 << BITS)
    share = (a[0] == b[0]).mean(axis=1) if len(a[0]) else np.zeros(0)
    return np.where(a[1] & b[1], np.clip((share - chance) / (1 - chance), 0, 1), (a[1] == b[1]).astype(float))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(*sketch(batch.column(1))), pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; nothing is shuffled."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprint_batches, "doc_id bigint, fingerprint string")


@F.pandas_udf(T.DoubleType())
def fingerprint_likeness(a, b):
    """Likeness of two fingerprint columns; null if either is null."""
    known = (a.notna() & b.notna()).to_numpy()
    sides = []
    for side in (a, b):
        some = np.array([bool(x) for x in side.fillna("")])
        raw = np.frombuffer(bytes.fromhex("".join(x if x else "00" * (BINS // 2) for x in side.fillna(""))), np.uint8).reshape(len(side), BINS // 2)
        sides.append((np.stack([raw >> BITS, raw & ((1 << BITS) - 1)], 2).reshape(len(side), BINS), some))
    return pd.Series(np.where(known, likeness(*sides), np.nan)).where(known, None)


def _cuts(rows: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Places where the order (doc_id, hash) is cut into about as many buckets as asked for.

    First ids by quantile; then an id that has more than a bucket's share of the rows is cut by the hash.
    The driver sees at most one id a bucket.
    """
    ids = rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.25 / buckets)
    share = max(1, rows.count() // buckets)
    often = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * share)).collect()
    cuts = {(int(c), -(1 << 63)) for c in ids}
    for row in often:
        parts = -(-row["n"] // share)
        cuts |= {(row["doc_id"] if row["doc_id"] is not None else 1 << 63, -(1 << 63) + k * (1 << 64) // parts) for k in range(parts)}
    ordered = sorted(cuts)
    return [c[0] for c in ordered], [c[1] for c in ordered]


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, guest, doc_id, text), dealt by ranges of doc_id and sorted.

    Each bucket ends with a guest: a copy of the row that follows its last one (for the last bucket
    the very first row). So every row has its successor beside it, and texts are shuffled once.
    Buckets are found by an Arrow function over ids and hashes, and are dealt to partitions by number.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).withColumn("h", F.xxhash64("text"))
    held = docs.sparkSession.sparkContext.broadcast(_cuts(rows.select("doc_id", "h"), buckets))

    @F.pandas_udf(T.IntegerType())
    def place(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        ids, hashes = (np.array(x, dtype=object) for x in held.value)
        known = doc_id.notna().to_numpy()
        own = np.where(known, doc_id.fillna(0).astype("int64"), 0).astype(np.int64)
        plain = ids < (1 << 63)
        n = int(plain.sum())
        at = np.searchsorted(ids[:n].astype(np.int64), own, "left") if n else np.zeros(len(own), np.int64)
        first = at.copy()
        last = np.searchsorted(ids[:n].astype(np.int64), own, "right") if n else first
        cut_hashes = hashes.astype(np.int64)
        for k in np.flatnonzero(last > first):  # cuts within the row's own id
            at[k] = first[k] + np.searchsorted(cut_hashes[first[k] : last[k]], h.iat[k], "right")
        at[~known] = n + np.searchsorted(cut_hashes[n:], h.to_numpy()[~known], "right")
        return pd.Series(at.astype(np.int32))

    numbered = rows.withColumn("bucket", place("doc_id", "h"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    first = numbered.groupBy("bucket").agg(F.min(order).alias("head")).orderBy("bucket").collect()
    places = [r["bucket"] for r in first]
    total = len(places)
    if not total:
        return numbered.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    # buckets in use are numbered from 0, so that each is a partition of its own
    seats = docs.sparkSession.createDataFrame([(p, k, (k - 1) % total, r["head"]["doc_id"], r["head"]["h"]) for k, (p, r) in enumerate(zip(places, first))], "bucket int, seat int, before int, head_id long, head_h long")
    seated = numbered.join(F.broadcast(seats), "bucket")  # one row a bucket
    opens = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    own = F.struct(F.col("seat").alias("bucket"), F.lit(False).alias("guest"))
    copies = F.when(opens, F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = seated.withColumn("at", F.explode(copies)).select("at.bucket", "at.guest", "doc_id", "h", "text")
    return dealt.repartitionById(total, "bucket").sortWithinPartitions("guest", F.col("doc_id").asc_nulls_last(), "h", "text").select("bucket", "guest", "doc_id", "text")


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            batch = whole.slice(at, 512)
            at += batch.num_rows
            if held is not None:
                batch = pa.concat_batches([held, batch])
            held = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(batch.num_rows - 1).columns], schema=batch.schema)
            n = batch.num_rows - 1
            bucket, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((bucket[:-1] == bucket[1:]) & ~guest[:-1])
            if not len(keep):
                continue
            texts = [t or "" for t in batch.column(3).to_pylist()]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in range(n)]
            own, other = sketch(pa.array(texts, pa.string())), sketch(pa.array(edited, pa.string()))
            names, others = packed(own[0][keep], own[1][keep]), packed(other[0][keep], other[1][keep])
            mine = (own[0][keep], own[1][keep])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).take(pa.array(keep)),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                    pa.array(names, pa.string()),
                    pa.array(others, pa.string()),
                    pa.array(likeness(mine, (other[0][keep], other[1][keep])), pa.float64()),
                    pa.array(likeness(mine, (own[0][keep + 1], own[1][keep + 1])), pa.float64()),
                ],
                names=[x.split()[0] for x in ROWS.split(", ")],
            )


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likenesses.

    The edited text ends with the first code points of the next document by doc_id instead of the
    document's own last quarter.
    """
    return in_order(docs, partitions(docs.sparkSession)).mapInArrow(_compare_batches, ROWS)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
