"""Importance resampling of documents towards a target distribution.

A feature is a run of ``ngrams`` words, its bucket the crc32 of its bytes modulo ``BUCKETS``. A bucket that
the target uses more than the documents do has a gain, the scaled log ratio of the two smoothed
shares. A document's weight is the floored mean of its features' gains; with Gumbel noise made of its
id added, the documents of highest score are a sample without replacement by weight.

1. Streams: tasks turn texts into packed uint16 buckets, one stream for a block of documents, with
   their offsets (``streams``). The streams are stored; texts are read once.
2. Counts: tasks sort their streams in chunks and run-length encode them; a grouped aggregation adds
   the runs up (``counts``). It is a table of ``BUCKETS`` rows.
3. Gains: one value for each bucket, broadcast (``BUCKETS`` of them, 65,536 at most).
4. Weights: the gains of a stream are gathered and added by ``np.add.reduceat`` over the offsets.
5. Ranks: rows are sorted by ranges of (score, id, place), so equal scores or ids never meet in one task only;
   a row's rank is its place in its task after the rows of the tasks before.

Defined cases: an empty table gives no rows; an empty target leaves the smoothed shares of the documents alone;
null and empty texts have no features and weight 0; a null id sorts last and counts as an empty
one in the noise; repeated rows are ranked one after the other; a very long text is a stream of its own;
``resample`` keeps all columns of the table and takes repeated rows of one id and text together, if one is drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F, types as T

from webstrata.llm import kernels as K
from webstrata.llm.common import join_salted, put_back, row_key, set_aside, small_batches, stored

BUCKETS, NGRAMS, SEED = 10_000, (1, 1), 2024
LEAST_WORDS, PERCENT = 20, 10
#: Features that a task sorts at once.
CHUNK = 1 << 22


def _buckets(w: K.Words, ngrams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of some documents, document by document, and their offsets."""
    parts, owners = [], []
    of = w.of
    for n in range(ngrams[0], ngrams[1] + 1):
        first = np.flatnonzero(of[: max(len(of) - n + 1, 0)] == of[n - 1 :]) if len(of) >= n else np.zeros(0, np.int64)
        key = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = K.mix(key * np.uint64(K._BASE) + w.hashes[first + k])
        _, some, which = np.unique(key, return_index=True, return_inverse=True)
        spans = [(w.starts[i : i + n], w.ends[i : i + n]) for i in first[some]]
        data = w.buf.tobytes()
        crc = np.fromiter((zlib.crc32(b" ".join(data[a:b] for a, b in zip(*s))) % buckets for s in spans), np.uint16, len(spans))
        parts.append(crc[which])
        owners.append(of[first])
    values, owner = np.concatenate(parts), np.concatenate(owners) - w.docs.start
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, np.searchsorted(owner, np.arange(len(w.docs) + 1))


def _stream_batches(batches: Iterator[pa.RecordBatch], ngrams: tuple[int, int], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in K.words(batch.column(1)):
            values, offsets = _buckets(w, ngrams, buckets)
            n, docs = len(w.docs), pa.array([0, len(w.docs)], pa.int32())
            ids = pa.ListArray.from_arrays(docs, batch.column(0).slice(w.docs.start, n))
            words = pa.ListArray.from_arrays(docs, pa.array(np.diff(w.first), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, words, pa.array([offsets.astype(np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["ids", "n_words", "offsets", "stream"])


def streams(docs: DataFrame, id_column: str = "doc_id", ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The stored streams: a row for each block of documents, with ``ids``, ``n_words``, packed offsets and buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")
    source = docs.select(F.col(id_column).alias("id"), "text")
    schema = T.StructType([T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("offsets", T.BinaryType()), T.StructField("stream", T.BinaryType())])
    with small_batches(docs.sparkSession):
        return stored(source.mapInArrow(lambda b: _stream_batches(b, ngrams, buckets), schema), "bucket_streams")


def _count_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)

    def add(held: list[np.ndarray]) -> None:
        run = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        total[run[first]] += np.diff(np.append(first, len(run)))

    held, size = [], 0
    for batch in batches:
        for stream in batch.column(0):
            part = np.frombuffer(stream.as_buffer(), np.uint16)
            if len(part):
                held.append(part)
                size += len(part)
            if size >= CHUNK:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def counts(of: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n of all features in stored streams."""
    runs = of.select("stream").mapInArrow(lambda b: _count_batches(b, buckets), "bucket int, n bigint")
    return runs.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: 1000 times the log ratio of its smoothed shares, floored."""
    spark = documents.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(documents.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    table = both.fillna(0, ["s", "t"]).orderBy("bucket").toPandas()  # ``buckets`` rows
    s, t = table["s"].to_numpy(float), table["t"].to_numpy(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weight_batches(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, words, packed, stream in zip(*batch.columns):
            offsets = np.frombuffer(packed.as_buffer(), np.int64)
            n = np.diff(offsets)
            some = n > 0
            sums = np.zeros(len(n), np.int64)
            if some.any():
                sums[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), np.uint16)], offsets[:-1][some])
            yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n), pa.array(sums // np.maximum(n, 1))], names=["id", "n_words", "n_features", "weight"])


def weights(of: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight of every document in stored streams."""
    held = of.sparkSession.sparkContext.broadcast(gain)
    kind = of.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    return of.select("ids", "n_words", "offsets", "stream").mapInArrow(lambda b: _weight_batches(b, held.value), schema)


def gumbel(doc_id: str | F.Column = "doc_id", seed: int = SEED) -> F.Column:
    """1000 times Gumbel noise made of seed and id, floored."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(scored: DataFrame, doc_id: F.Column, least_words: int, percent: int) -> DataFrame:
    """Add ``rank``: the places of the documents drawn, null for all others."""
    rows = stored(scored.withColumn("_out", F.col("n_words") < least_words).withColumn("_id", doc_id).withColumn("_row", F.monotonically_increasing_id()), "scores")
    order = ["_out", F.desc("score"), F.asc_nulls_last("_id"), "_row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "ranked")
    tasks = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_out")).alias("fit"))
    every = Window.orderBy("_task")  # one row a task
    before = tasks.select("_task", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.floor(F.sum("fit").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * percent / 100).alias("_most"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(F.broadcast(before), "_task").withColumn("rank", F.when(~F.col("_out") & (place <= F.col("_most")), place))
    return out.drop("_out", "_id", "_row", "_at", "_task", "_before", "_most")


def _scored(docs: DataFrame, target: DataFrame, id_column: str, doc_id: F.Column, ngrams: tuple[int, int], buckets: int, least_words: int, percent: int, seed: int) -> DataFrame:
    own = streams(docs, id_column, ngrams, buckets)
    aim = streams(target.withColumn("id", F.lit(0)), "id", ngrams, buckets)
    gain = gains(counts(own, buckets), counts(aim, buckets), buckets)
    return _ranked(weights(own, gain).withColumn("score", F.col("weight") + gumbel(doc_id, seed)), doc_id, least_words, percent)


def importance(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null unless drawn) of every document."""
    return _scored(docs, target, "doc_id", F.col("id"), ngrams, buckets, least_words, percent, seed).withColumnRenamed("id", "doc_id")


def resample(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    used = ["doc_id", "text"]
    rows = set_aside(docs, used).withColumn("_key", row_key())
    found = _scored(rows.withColumn("_both", F.struct("doc_id", "_key")), target, "_both", F.col("id.doc_id"), ngrams, buckets, least_words, percent, seed)
    drawn = stored(found.where("rank is not null").select(F.col("id._key").alias("_key")).distinct(), "drawn")
    return join_salted(rows, drawn, ["_key"], "inner").select(*put_back(docs.columns, used))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return importance(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: crc32 is worked out bit by bit, once for each distinct word.
OP12_SQL = r"""
WITH bits AS (SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM range(256) t(b))),
docs AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
used AS (SELECT place, unnest(words) AS w FROM docs),
aimed AS (SELECT unnest(words) AS w FROM items),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM used UNION SELECT w FROM aimed)),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c // 256, crc[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM coded, bits),
s AS (SELECT bucket, count(*) AS s FROM used JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aimed JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aimed) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT place, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM used JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY place),
scored AS (SELECT place, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN weighed USING (place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= floor(10 * n / 100) THEN r END AS rank, n_features AS n_words FROM ranked
"""
