"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every training token: one row for each block of documents,
holding the block's distinct terms and, term by term, the sorted positions where they occur. The
index is partitioned by document, so building it shuffles nothing, no term can be hot, and all
postings a phrase needs lie in one row.

``find`` runs a set of benchmark items against a stored index. Items are cut into windows. Within
a block a window is looked up through its rarest term (by occurrences in the whole corpus): each
posting, moved back by the term's offset, is a candidate start, and is kept only if it is also in
the offset-adjusted lists of all other terms, rarest first. What is left are exact phrase matches.
A proximity match has every word of the window, in any order, within ``slop`` words beyond the
window's own length of an occurrence of the rarest one.

Terms are 64-bit hashes of words. Two words that share a hash could only matter inside 13 matching
words in a row.

A proximity match needs no order and includes the exact ones.

Defined cases: an empty table of documents gives no rows, an empty benchmark no matches; a null text
has no words; an item without words has no windows; an item of fewer words than the window is one
window of all its words; equal items are all reported, and rows of one item_id are one item; an item
without an id hits words but is not named; repeated document rows each give a row; extra columns of
either table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import kernels as K
from webstrata.llm.common import join_sized, put_back, row_key, set_aside, small_batches, stored

WINDOW = 13
#: Bytes of text in a block of the index.
BLOCK = 1 << 19
#: Benchmark words handled in one pass; a larger benchmark takes more passes over the index.
WORDS_PER_PASS = 200_000
#: Candidate starts of a block that are looked at together; it bounds memory, not the search.
CANDIDATES = 1 << 17
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_LOWER = {c: c + 32 for c in range(65, 91)}
INDEX = "doc_ids array<{}>, doc_starts array<int>, terms binary, counts binary, positions binary, block bigint"
MATCHES = "block bigint, place int, doc_id {}, n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>, near array<string>"


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 33  # blocks are numbered within their task
    for batch in batches:
        ids = batch.column(0)
        for w in K.words(batch.column(1), piece=BLOCK):
            order = np.argsort(w.hashes, kind="stable")
            terms, counts = np.unique(w.hashes[order], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.slice(w.docs.start, len(w.docs)).to_pylist()], pa.list_(ids.type)),
                    pa.array([w.first.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([order.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([block], pa.int64()),
                ],
                names=["doc_ids", "doc_starts", "terms", "counts", "positions", "block"],
            )
            block += 1


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the positional index of all words of ``docs`` in the shared folder; ids keep their type."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        return stored(rows.mapInArrow(_index_blocks, INDEX.format(rows.schema["doc_id"].dataType.simpleString())), "postings")


@dataclass
class Windows:
    """Distinct windows: term numbers in vocabulary order, lengths, and the items that have them."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray
    item_of: np.ndarray
    item_ids: list[str | None]


def cut_windows(items: pa.Table, size: int = WINDOW) -> Windows:
    """Windows of ``size`` consecutive words of the items (columns item_id, text)."""
    ids = items.column(0).to_pylist()
    seen: dict[tuple, set[int]] = {}
    for w in K.words(items.column(1)):
        for k, doc in enumerate(w.docs):
            h = w.hashes[w.first[k] : w.first[k + 1]].tolist()
            for at in range(max(1, len(h) - size + 1) if h else 0):
                seen.setdefault(tuple(h[at : at + size]), set()).add(doc)
    vocabulary = np.unique(np.array([t for win in seen for t in win], np.uint64))
    lengths = np.array([len(x) for x in seen], np.int64)
    terms = np.full((len(seen), size), -1, np.int64)
    for row, win in enumerate(seen):
        terms[row, : len(win)] = np.searchsorted(vocabulary, np.array(win, np.uint64))
    owners = [sorted(x) for x in seen.values()]
    return Windows(vocabulary, terms, lengths, np.cumsum([0] + [len(x) for x in owners]), np.array([i for x in owners for i in x], np.int64), ids)


def _held(batch: pa.RecordBatch, column: int, row: int, kind: type) -> np.ndarray:
    """The numbers packed in a binary cell, not copied."""
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of the vocabulary's terms in the whole corpus; reads no postings."""
    held = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, counts = _held(batch, 0, row, np.uint64), _held(batch, 1, row, np.int32)
                at = np.searchsorted(terms, known)
                hit = np.flatnonzero(at < len(terms))
                hit = hit[terms[at[hit]] == known[hit]]
                total[hit] += counts[at[hit]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    with small_batches(index.sparkSession):
        found = index.select("terms", "counts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


@dataclass
class Plan:
    """Windows with their terms sorted from the rarest, and the offsets of those terms."""

    windows: Windows
    terms: np.ndarray
    offsets: np.ndarray
    slop: int


def _plan(windows: Windows, frequency: np.ndarray, slop: int) -> Plan:
    weight = np.where(windows.terms >= 0, frequency[windows.terms] if len(frequency) else 0, np.iinfo(np.int64).max)
    order = np.argsort(weight, axis=1, kind="stable")
    return Plan(windows, np.take_along_axis(windows.terms, order, 1), order, slop)


def _search(plan: Plan, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> tuple[list, list]:
    """Exact (window, start) and near (window, anchor) matches within one block."""
    total, known = len(positions), plan.windows.vocabulary
    if not total or not len(known):
        return [], []
    rank = np.searchsorted(terms, known)
    have = rank < len(terms)
    have[have] = terms[rank[have]] == known[have]
    first = np.concatenate([[0], np.cumsum(counts)])
    alive = np.flatnonzero(np.where(plan.terms >= 0, have[plan.terms], True).all(axis=1))
    if not len(alive):
        return [], []
    keys = np.repeat(np.arange(len(terms), dtype=np.int64), counts) * total + positions
    rare = rank[plan.terms[alive, 0]]
    load = np.cumsum(counts[rare])
    exact, near = [], []
    for lo, hi in _shares(load, CANDIDATES):
        wins = np.repeat(alive[lo:hi], counts[rare[lo:hi]])
        post = np.arange(len(wins)) - np.repeat(load[lo:hi] - counts[rare[lo:hi]] - (load[lo - 1] if lo else 0), counts[rare[lo:hi]])
        anchor = positions[np.repeat(first[rare[lo:hi]], counts[rare[lo:hi]]) + post].astype(np.int64)
        size = plan.windows.lengths[wins]
        doc = np.searchsorted(starts, anchor, "right") - 1
        begin = anchor - plan.offsets[wins, 0]
        fits = (begin >= starts[doc]) & (begin + size <= starts[doc + 1])
        w, at = wins[fits], begin[fits]
        for k in range(1, plan.terms.shape[1]):
            term = plan.terms[w, k]
            want = rank[np.maximum(term, 0)] * total + at + plan.offsets[w, k]
            found = np.searchsorted(keys, want)
            ok = (term < 0) | ((found < total) & (keys[np.minimum(found, total - 1)] == want))
            w, at = w[ok], at[ok]
        exact.append((w, at))
        if plan.slop >= 0:
            w, a, d = wins, anchor, doc
            for k in range(1, plan.terms.shape[1]):
                term, reach = plan.terms[w, k], plan.windows.lengths[w] - 1 + plan.slop
                base = rank[np.maximum(term, 0)] * total
                low, high = base + np.maximum(a - reach, starts[d]), base + np.minimum(a + reach, starts[d + 1] - 1)
                found = np.searchsorted(keys, low)
                ok = (term < 0) | ((found < total) & (keys[np.minimum(found, total - 1)] <= high))
                w, a, d = w[ok], a[ok], d[ok]
            near.append((w, a))
    return exact, near


def _shares(load: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into ranges whose summed load stays near ``most``."""
    at = 0
    while at < len(load):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _items(windows: Windows, found: list, starts: np.ndarray) -> dict[int, list[str]]:
    if not found:
        return {}
    w, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, w], 1), axis=0)
    out: dict[int, set[int]] = {}
    for doc, win in pairs.tolist():
        out.setdefault(doc, set()).update(windows.item_of[windows.item_first[win] : windows.item_first[win + 1]].tolist())
    return {doc: sorted({windows.item_ids[i] for i in items} - {None}) for doc, items in out.items()}


def _match_blocks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, starts = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy().astype(np.int64)
            terms, counts, positions = (_held(batch, i, row, t) for i, t in ((2, np.uint64), (3, np.int32), (4, np.int32)))
            exact, near = _search(plan, starts, terms, counts.astype(np.int64), positions)
            edge = np.zeros(len(positions) + 1, np.int32)
            for w, at in exact:
                np.add.at(edge, at, 1)
                np.add.at(edge, at + plan.windows.lengths[w], -1)
            covered = np.cumsum(edge[:-1]) > 0
            begin = covered.copy()
            begin[1:] &= ~covered[:-1]
            begin[starts[:-1][starts[:-1] < len(covered)]] = covered[starts[:-1][starts[:-1] < len(covered)]]
            begin = np.flatnonzero(begin)
            stop = np.searchsorted(np.flatnonzero(~np.append(covered, False)), begin)
            stop = np.flatnonzero(~np.append(covered, False))[stop]
            doc = np.searchsorted(starts, begin, "right") - 1
            stop = np.minimum(stop, starts[doc + 1])
            spans: dict[int, list] = {}
            for d, a, b in zip(doc.tolist(), (begin - starts[doc]).tolist(), (stop - starts[doc]).tolist()):
                spans.setdefault(d, []).append({"start": a, "stop": b})
            items, close = _items(plan.windows, exact, starts), _items(plan.windows, near, starts)
            n = len(starts) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(5)[row].as_py()] * n, pa.int64()),
                    pa.array(np.arange(n, dtype=np.int32)),
                    ids,
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([spans.get(i, []) for i in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([items.get(i, []) for i in range(n)], pa.list_(pa.string())),
                    pa.array([close.get(i, []) for i in range(n)], pa.list_(pa.string())),
                ],
                names=["block", "place", "doc_id", "n_words", "spans", "items", "near"],
            )


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items in pieces of at most ``most`` words, which overlap so that every window lies in one of them."""
    for batch in batches:
        out = []
        for item, text in zip(*(c.to_pylist() for c in batch.columns)):
            w = _WORD.findall((text or "").translate(_LOWER))
            if len(w) <= most:
                out.append((item, " ".join(w), len(w)))
            else:
                out += [(item, " ".join(w[at : at + most + window - 1]), min(most + window - 1, len(w) - at)) for at in range(0, len(w) - window + 1, most)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [(), (), ()], (pa.string(), pa.string(), pa.int64()))], names=["item_id", "text", "n"])


def find(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Phrase and proximity matches of benchmark ``items`` in a stored index, one row a document.

    Returns doc_id, n_words, ``spans`` (merged word ranges inside exact matches), ``items`` and
    ``near`` (sorted ids of the items with exact and with proximity matches). A negative ``slop``
    leaves out the proximity search. Items are cut into pieces, and those are read in passes of about
    ``WORDS_PER_PASS`` words, so a task and the driver hold no more of a benchmark than that.
    """
    most = max(window, WORDS_PER_PASS // 8)
    tests = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    tests = stored(tests.mapInArrow(lambda b: _pieces(b, window, most), "item_id string, text string, n bigint").where("n > 0"), "items")
    passes = max(1, -(-int(tests.agg(F.sum("n")).first()[0] or 0) // WORDS_PER_PASS))
    schema = MATCHES.format(index.schema["doc_ids"].dataType.elementType.simpleString())
    out = None
    for k in range(passes):
        share = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        windows = cut_windows(share.select("item_id", "text").toArrow(), window)
        held = index.sparkSession.sparkContext.broadcast(_plan(windows, _frequencies(index, windows.vocabulary), slop))
        one = index.select("doc_ids", "doc_starts", "terms", "counts", "positions", "block").mapInArrow(lambda batches, held=held: _match_blocks(batches, held.value), schema)
        out = one if out is None else out.unionByName(one)
    if passes > 1:  # a document's matches of all passes together; its place tells it from others of its id
        out = out.groupBy("block", "place", "doc_id", "n_words").agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")
        )
    return out.drop("block", "place")


def covered_words(spans: str = "spans") -> F.Column:
    """Words inside at least one span; spans may overlap but are sorted."""
    step = lambda acc, x: F.struct(F.greatest(acc["upto"], x["stop"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["upto"], x["start"]))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step)["n"].cast("long")


def scan(docs: DataFrame, benchmark: DataFrame, slop: int = 3) -> DataFrame:
    """Index ``docs``, match ``benchmark`` and judge: a twentieth of the words hit is contaminated."""
    return find(build_index(docs), benchmark, slop=slop).withColumn("n_hit", covered_words()).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names("items").alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"), names("near").alias("near_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
wins AS (
  SELECT DISTINCT id AS item_id, size, list_slice(w, pos, pos + size - 1) AS win
  FROM (SELECT id, w, least(13, len(w)) AS size, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS pos FROM words WHERE kind = 'b' AND len(w) > 0)),
lens AS (SELECT DISTINCT size FROM wins),
docs AS (SELECT id AS doc_id, w FROM words WHERE kind = 'd'),
places AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS pos FROM docs, lens WHERE len(w) >= size),
hits AS (SELECT p.doc_id, p.pos, p.size, x.item_id FROM (SELECT doc_id, pos, size, list_slice(w, pos, pos + size - 1) AS win FROM places) p JOIN wins x ON p.size = x.size AND p.win = x.win),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS i FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id),
occurs AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM docs),
often AS (SELECT word, count(*) AS n FROM occurs GROUP BY word),
terms AS (SELECT item_id, size, win, unnest(win) AS word, generate_subscripts(win, 1) AS place FROM wins),
rare AS (SELECT item_id, size, win, arg_min(word, struct_pack(n := coalesce(n, 0), place := place)) AS word FROM terms LEFT JOIN often USING (word) GROUP BY item_id, size, win),
close_by AS (SELECT DISTINCT o.doc_id, CAST(r.item_id AS VARCHAR) AS i FROM rare r JOIN occurs o USING (word) JOIN docs d ON d.doc_id = o.doc_id
  WHERE list_has_all(list_slice(d.w, greatest(1, o.pos - r.size - 2), o.pos + r.size + 2), r.win)),
near_by AS (SELECT doc_id, count(i) AS n_near, string_agg(i, ',' ORDER BY i) AS ids FROM close_by GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(k.n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(k.ids, '')) AS near_sha256
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN near_by k USING (doc_id)
"""


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged.

    Rows are told apart by doc_id and a 128-bit digest of the text, so rows that share an id are judged
    separately, and equal rows alike.
    """
    used = ["doc_id", "text"]
    keyed = set_aside(docs, used).withColumn("_row", row_key())
    found = find(build_index(keyed, doc_id="_row"), benchmark, slop=-1).where(F.size("spans") > 0).withColumn("n_hit", covered_words())
    with small_batches(docs.sparkSession):
        bad = stored(found.where(20 * F.col("n_hit") >= F.col("n_words")).select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return join_sized(keyed, bad, ["_row"], "left_anti", row_bytes=64).select(*put_back(docs.columns, used))
