"""Line dedup by pairwise alignment.

Lines of ``LINE_WORDS`` or more words are hashed, and so are runs of consecutive lines that just reach
``BLOCK_WORDS`` words: the shortest from every line on and the shortest up to every line. The documents
that share a line or a run are linked to the earliest that has it, so one in n documents makes n - 1
pairs, not n^2; the join to it is salted where a line is very common. Each pair is aligned by patience diff over all its lines: lines that are unique on
both sides and in order are anchors, the gaps between them are aligned in the same way, and where
none are left, equal lines are matched by occurrence. Runs of aligned lines that are consecutive in
both documents are common blocks; blocks of ``BLOCK_WORDS`` or more words are deleted from the later
document, as are the runs that alignment left because they stand in another order. Every line of a
block shared with any earlier document is in one of the runs, and the run's earliest document has it.

Empty lines do not interrupt a block. Two characters of a script that is written without spaces
count as a word.

Documents are ordered by doc_id (null last), then by the text's digest. Defined cases: an empty table
stays empty; repeated rows
(same doc_id and text) are one document and all keep the same lines; a null text stays null; a
document of which every line goes keeps its row with an empty text; line matching ignores the case
of A-Z; extra columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import kernels as K
from webstrata.llm.common import BROADCAST_BYTES, join_salted, put_back, row_key, set_aside, small_batches, stored

#: Words of a line that can bring two documents together, and of a block that is deleted.
LINE_WORDS, BLOCK_WORDS = 5, 10
_LINE = np.ones(256, np.bool_)
_LINE[0x0A] = False

LINES = "key binary, hashes array<bigint>, words array<int>, places array<int>, runs array<bigint>"


def _unspaced(buf: np.ndarray) -> np.ndarray:
    """First bytes of characters of scripts without spaces: kana and Han, Thai, Lao, Tibetan, Myanmar and Khmer."""
    after = np.append(buf[1:], np.uint8(0)) if len(buf) else buf
    han = ((buf >= 0xE3) & (buf <= 0xE9)) | ((buf == 0xF0) & (after >= 0xA0))
    return han | ((buf == 0xE0) & (after >= 0xB8)) | ((buf == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F)))


def _spans(words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 line of the shortest runs of ``least`` words, from each line on and up to each line."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    to = np.searchsorted(sums, sums[:-1] + least)
    start = np.searchsorted(sums, sums[1:] - least, "right") - 1
    a = np.concatenate([np.arange(n)[to <= n], start[start >= 0]])
    b = np.concatenate([to[to <= n], np.arange(1, n + 1)[start >= 0]])
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def _run_hashes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of more than one line."""
    a, b = _spans(words)
    a, b = a[b - a > 1], b[b - a > 1]
    if not len(a):
        return np.zeros(0, np.int64)
    out = np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int((b - a).max())):
            on = np.flatnonzero(a + k < b)
            out[on] = K.mix(out[on] * np.uint64(K._BASE) + hashes[a[on] + k])
    return np.unique(out).view(np.int64)


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, word count and line number of every line that is not empty."""
    for batch in batches:
        for w in K.words(batch.column(1), _LINE):
            solid = K.SOLID[w.buf]
            begins = solid.copy()
            begins[1:] &= ~solid[:-1]
            begins[w.starts] = solid[w.starts]  # a document's first word follows the last byte of the one before
            words = np.concatenate([[0], np.cumsum(begins)])
            signs = np.concatenate([[0], np.cumsum(_unspaced(w.buf))])
            breaks = np.concatenate([[0], np.cumsum(w.buf == 0x0A)])
            counts = np.diff(w.first)
            # a document's first byte: newlines before it do not count
            sizes = np.concatenate([[0], np.cumsum(_bytes(batch.column(1), w.docs))])
            places = breaks[w.starts] - np.repeat(breaks[sizes[:-1]], counts)
            first = pa.array(w.first.astype(np.int32))
            sizes = (words[w.ends] - words[w.starts] + (signs[w.ends] - signs[w.starts]) // 2).astype(np.int32)
            lists = [pa.ListArray.from_arrays(first, pa.array(v)) for v in (w.hashes.view(np.int64), sizes, places.astype(np.int32))]
            runs = [_run_hashes(w.hashes[a:b], sizes[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
            lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)), pa.array(np.concatenate(runs))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.docs.start, len(w.docs)), *lists], names=["key", "hashes", "words", "places", "runs"])


def _bytes(column: pa.Array, docs: range) -> np.ndarray:
    return np.diff(K.buffers(column)[1][docs.start : docs.stop + 1])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first place, whose second places rise."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in ``a``, in ``b``) of equal items, rising on both sides."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _rising([(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at_b])
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
        else:  # nothing unique is shared: the first of a is matched to the first of b, and so on
            seen: Counter = Counter()
            place = {}
            for j, x in enumerate(b[b0:b1], b0):
                place[x, seen[x]] = j
                seen[x] += 1
            seen.clear()
            pairs = []
            for i, x in enumerate(a[a0:a1], a0):
                if (x, seen[x]) in place:
                    pairs.append((i, place[x, seen[x]]))
                seen[x] += 1
            found += _rising(pairs)
    return sorted(found)


def common_blocks(earlier: list[int], later: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Places in ``later`` that lie in common blocks of at least ``least`` words."""
    out, block, last = [], [], None
    for i, j in [*patience(earlier, later), (-2, -2)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return sorted({*out, *_moved(earlier, later, words, least)})


def _moved(earlier: list[int], later: list[int], words: list[int], least: int) -> set[int]:
    """Places in ``later`` in runs of at least ``least`` words that ``earlier`` has anywhere."""
    size = dict(zip(later, words))
    # a line that only the earlier has ends a run: it is counted as one and matches nothing
    runs = lambda lines: zip(*(x.tolist() for x in _spans(np.array([size.get(x, 1) for x in lines], np.int64), least)))
    have = {tuple(earlier[a:b]) for a, b in runs(earlier)}
    return {j for a, b in runs(later) if tuple(later[a:b]) in have for j in range(a, b)}


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, gone = [], []
        for key, earlier, later, words, places in zip(*(c.to_pylist() for c in batch.columns)):
            found = common_blocks(earlier, later, words)
            if found:
                keys.append(key)
                gone.append([places[j] for j in found])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, gone): the line numbers to delete from each document that has any; keys as ``row_key``."""
    with small_batches(docs.sparkSession):
        lines = stored(docs.select(row_key().alias("key"), "text").mapInArrow(_line_batches, LINES).dropDuplicates(["key"]), "lines")
    each = lines.select("key", F.explode(F.arrays_zip("hashes", "words")).alias("line")).where(F.col("line.words") >= LINE_WORDS).select("key", F.col("line.hashes").alias("h"))
    each = each.unionByName(lines.select("key", F.explode("runs").alias("h")))
    shared = stored(each.groupBy("h").agg(F.min("key").alias("head"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("head") != F.col("last")).drop("last"), "shared_lines")
    pairs = stored(join_salted(each, shared.drop("n"), ["h"], "inner", counts=shared).where(F.col("key") != F.col("head")).select("key", "head").distinct(), "pairs")
    later = lines.select("key", F.col("hashes").alias("later"), "words", "places")
    earlier = lines.select(F.col("key").alias("head"), F.col("hashes").alias("earlier"))
    both = join_salted(join_salted(pairs, earlier, ["head"], "inner"), later, ["key"], "inner", counts=pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    found = both.select("key", "earlier", "later", "words", "places").mapInArrow(_align_batches, "key binary, gone array<int>")
    return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def with_gone(docs: DataFrame) -> DataFrame:
    """``docs`` with the line numbers to delete (null if none)."""
    found = repeated_lines(docs)
    with small_batches(docs.sparkSession):
        gone = stored(found, "gone")
    rows, places = gone.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    keyed = docs.withColumn("key", row_key())
    if rows * 48 + 4 * (places or 0) <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(gone), "key", "left").drop("key")
    return join_salted(keyed, gone, ["key"], "left").drop("key")


def remaining(text: str = "text", gone: str = "gone") -> F.Column:
    """The text without the lines ``gone``; the array around the lines binds them, so they are cut once."""
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    kept = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(left(lines), "\n")), F.lit(0))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with common blocks deleted from the later documents; rows and columns stay.

    If there is a column ``n_chars``, it is brought up to date where lines went.
    """
    used = ["doc_id", "text", "n_chars"]
    out = with_gone(set_aside(docs, used)).withColumn("text", remaining())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*put_back(docs.columns, used))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return with_gone(docs).select("doc_id", lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), remaining().alias("text"))
