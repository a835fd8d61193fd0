"""Periodic runs of words by Main-Lorentz divide and conquer.

A run is a stretch of words with smallest period q, of ``times * q`` words and ``least`` words or more,
that no neighbouring word extends keeping the period. Words are interned: equal words have one id.

The words of a block of texts are one sequence, with separators that equal nothing between texts. It
is halved again and again. All halves of one size are looked at together, in numpy:

1. A run belongs to the largest part whose midpoint lies inside it, and is whole in that part. As it has
   four periods or more, a whole square of its period ends or begins at the midpoint: the Z-function of
   the half that is read away from the midpoint is q or more at q. First words are compared, then three more,
   then hashes of both periods; what is left are squares (``_squares``).
2. From the smallest period of each half on, both directions are extended word by word to the borders of the part
   (``_reach``): this is the Z-function at q, and that of the other half read backwards. Multiples of a period inside what it covers
   repeat the same run and are skipped; by the lemma of three squares few periods of a half are left.
3. Stretches that a neighbour extends are parts of a run found elsewhere; of equal intervals the smallest
   period stays.

Hashes only sort out candidates; every run is confirmed by comparing words. Time is n log n for n words,
memory in proportion to n, however periodic the text is.

Defined cases: an empty table gives no rows; a null or empty text has no words, no runs and an empty collapsed text;
a very long text is a block of its own; repeated rows get equal results; columns ``n_words``, ``runs`` and
``collapsed`` that the table may have give way, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from webstrata.llm import kernels as K
from webstrata.llm.common import small_batches, stored

LEAST, TIMES = 6, 4
#: Bytes of text whose words are one sequence.
PIECE = 1 << 20
RESULTS = ["n_words", "runs", "collapsed"]
_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _squares(halves: np.ndarray, middles: np.ndarray, sums: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``halves``, which are read away from ``middles``, and the periods q of squares at their beginning."""
    most = halves.shape[1] // 2
    rows, q = np.nonzero(halves[:, 1 : most + 1] == halves[:, :1])
    q += 1
    for ahead in (lambda q: np.ones_like(q), lambda q: q - 1, lambda q: q // 2):
        same = halves[rows, q + ahead(q)] == halves[rows, ahead(q)]
        rows, q = rows[same], q[same]
    a = middles[rows] - 2 * q if backwards else middles[rows]
    with np.errstate(over="ignore"):
        same = (sums[a + q] - sums[a]) * K._power(K._BASE, most + 1)[q] == sums[a + 2 * q] - sums[a + q]
    return rows[same], q[same]


def _reach(words: np.ndarray, at: np.ndarray, period: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``at`` on, before ``stop``, hold the same word as the place a period after them."""
    out = np.zeros(len(at), np.int64)
    todo, size = np.flatnonzero((stop - at) * step > 0), 8
    while len(todo):
        place = (at[todo] + step * out[todo])[:, None] + step * np.arange(size)
        inside = (stop[todo][:, None] - place) * step > 0
        place = np.where(inside, place, at[todo][:, None])
        same = inside & (words[place] == words[place + period[todo][:, None]])
        n = np.where(same.all(1), size, same.argmin(1))
        out[todo] += n
        todo, size = todo[n == size], min(2 * size, 1 << 16)
    return out


def sequence_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in ids of words (0 or above), by start and period.

    Negative ids are separators; each may occur once only.
    """
    if times < 4:
        raise ValueError("only a run of four periods is sure to have a square at a midpoint")
    n = len(words)
    size = 8
    while size < n + 2:
        size *= 2
    w = np.arange(-size - n - 2, -n - 2)  # separators before, behind and where the last part is not full
    w[1 : n + 1] = words
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, K.U64)
        np.cumsum(K.mix(w.view(K.U64) + K.U64(1)) * K._power(K._BASE, size), out=sums[1:])
    found = [np.zeros((0, 3), np.int64)]
    half = 4
    while 2 * half <= size:
        parts = w.reshape(-1, 2 * half)
        middles = np.arange(len(parts)) * 2 * half + half
        for backwards, halves in ((False, parts[:, half:]), (True, parts[:, half - 1 :: -1])):
            rows, q = _squares(halves, middles, sums, backwards)
            while len(rows):
                some, first = np.unique(rows, return_index=True)
                p, middle = q[first], middles[some]
                anchor = middle - p if backwards else middle
                right = _reach(w, anchor, p, middle + half - p, 1)
                left = _reach(w, anchor - 1, p, middle - half - 1, -1)
                start, end = anchor - left, anchor + right + p
                true = (left if backwards else right) >= p
                whole = true & (end - start >= np.maximum(least, times * p)) & (w[start - 1] != w[start - 1 + p]) & (w[np.minimum(end, size - 1)] != w[np.minimum(end, size - 1) - p])
                found.append(np.stack([start, end - start, p], 1)[whole])
                covered = np.where(true, (p + (left if backwards else right)) // 2, p)
                at = np.searchsorted(some, rows)
                stay = q > np.maximum(covered, p)[at]
                rows, q = rows[stay], q[stay]
        half *= 2
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    keep = np.append(True, (out[1:, :2] != out[:-1, :2]).any(1))[: len(out)]  # the smallest period of an interval
    out = out[keep]
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return out[:, 0] - 1, out[:, 1], out[:, 2]


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of about ``PIECE`` bytes of text."""
    offsets, row = K.buffers(column)[1], 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield column.slice(row, stop - row)
        row = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the id of every word of the texts, and the texts' offsets; null texts have no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
    words, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
    if pc.any(pc.equal(words, "")).as_py():  # what is left of a text without words
        first = np.cumsum(counts) - counts
        full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        counts = np.where((counts == 1) & ~full[first], 0, counts)
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def _run_batches(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, row = batch.column(batch.num_columns - 1), 0
        for piece in _pieces(texts):
            names, ids, first = split_words(piece)
            docs, n = len(piece), np.diff(first)
            sequence = np.full(len(ids) + docs, -1, np.int64)
            own = np.repeat(np.arange(docs), n)
            sequence[np.arange(len(ids)) + own] = ids
            gaps = first[1:] + np.arange(docs)
            sequence[gaps] = -1 - np.arange(docs)
            start, length, period = sequence_runs(sequence, least, times)
            of = np.searchsorted(gaps, start)
            start -= of  # places among the words of all texts
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(own[kept], minlength=docs))]).astype(np.int32)), names.take(pa.array(ids[kept])))
            runs = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(docs + 1)).astype(np.int32)), runs)
            same = [batch.column(k).slice(row, docs) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(n), runs, pc.binary_join(left, " ")], names=[*batch.schema.names[:-1], *RESULTS])
            row += docs


def find_runs(docs: DataFrame, text: str | Column = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``runs`` (start, length and period of each, by start and
    period) and ``collapsed``: the words, joined by one space, without those in a run after its first period."""
    kept = [c for c in docs.columns if c not in RESULTS and c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], (F.col(text) if isinstance(text, str) else text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])
    return source.mapInArrow(lambda b: _run_batches(b, least, times), schema)


def echoed(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, or for one id in ten its words up to a place and from there on a stretch of them over and over."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def edit(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the array around the words binds them, so they are cut once
    edited = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, edit(w)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, edited).otherwise(F.col(text))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", echoed().alias("text"))
    found = find_runs(docs)
    more = lambda r, best: best["period"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast(_RUNS.elementType)
    best = F.aggregate("runs", none, lambda best, r: F.when(more(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
    with small_batches(spark):
        return stored(found, "periodic_runs")
