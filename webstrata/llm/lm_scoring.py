"""Language-model scoring with a hashed, class-factored maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history). Classes: the ``TOP`` most frequent
tokens alone, the end of the text, all other tokens by a hash of their last two bytes, and one class for
"the previous token again" (whose word is certain).

P(class | history) is a maximum-entropy softmax over hashed features of the two previous tokens'
classes: bias, bigram, skip-bigram, hashed trigram, and whether those two tokens are the same.

P(word | class, history) is one as well, over features that are hashed from a context token, the class
and the word. The context is the previous token or, past a frequent one (``TOP``), the token before it:
a bigram or a skip feature. The features are those seen ``LEAST`` times or more in training, so there are
the more of them the larger the corpus is. With c the context's tokens in the class and n(w) a feature's
uses, a word with a feature has (n(w) - ``OFF``) / c, and all other words of the class share the rest as
their counts have it, (n + 1) / (N + V + 1): an unseen token has the class's share of one. As one word
feature is active at a time, these are the weights at which the likelihood's gradient, less a discount of
``OFF`` a feature, is zero. Shares do not go to other words for those that have a feature, so all
probabilities together stay just under one.

1. Token counts of all training texts: hashed in numpy, added by a grouped aggregation (``vocabulary``).
2. Feature statistics of all training tokens: every task adds up its (history, class) table, tasks'
   tables are added in a tree. The table has a fixed size, so gradients are exact and cheap.
3. Training of the classes: in each of ``ROUNDS`` updates, tasks compute expected features over their
   share of the histories for the broadcast weights; the driver applies the scaled gradient.
4. Scoring: per batch one lookup a token; counts of the ``KNOWN`` most frequent tokens are broadcast,
   those of all others are joined by hash.
5. Word features: the same pass deals the tokens that have a context to shards by the hash of context
   and class, in packed arrays. A shard holds all of a context: it counts the features, sets their
   weights and returns to every block of texts what they add to their scores. ``TOP`` tokens are no contexts, so no
   context has more than a small part of all tokens.

Tokens are 64-bit hashes (lower-cased A-Z). Word features are for the ``KNOWN`` tokens; others score by
their own counts. The score is the model's log10 probability of the text with its end.

Defined cases: an empty table gives no rows; a null text has only its end; a null doc_id counts as
training; equal rows get equal scores; without any training text every class is equally likely; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import kernels as K
from webstrata.llm.common import cut, partitions, stored

TOP, SHAPES, CLASSES = 55, 71, 128
END, AGAIN, START = 126, 127, 127
KNOWN = 1 << 18
TRIGRAMS = 2048
ROUNDS, PULL = 30, 0.5
FAN = 64
CHUNK = 1 << 20
#: Training uses that make a word feature, and how much of each is left to words without one.
LEAST, OFF = 2, 0.75
#: Tokens that a shard of contexts has on average.
SHARD_TOKENS = 1 << 21


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(7)) == 2


def _shapes(w: K.Words) -> np.ndarray:
    last = w.buf[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.buf[np.maximum(w.ends - 2, 0)], 0).astype(np.int64)
    return (last * 8191 + before * 127 + 5) % 1009 % SHAPES


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(parts: list) -> pa.RecordBatch:
        hashes, shapes = (np.concatenate(x) for x in zip(*parts))
        values, first, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n), pa.array(shapes[first].astype(np.int32))], names=["h", "n", "shape"])

    held, size = [], 0
    for batch in batches:
        for w in K.words(batch.column(0), K.SOLID):
            held.append((w.hashes, _shapes(w)))
            size += len(w.hashes)
            if size > CHUNK:
                yield emit(held)
                held, size = [], 0
    if size:
        yield emit(held)


def vocabulary(texts: DataFrame) -> DataFrame:
    """h, n and shape of every distinct token of the column ``text``."""
    counted = texts.select("text").mapInArrow(_count_tokens, "h bigint, n bigint, shape int")
    return stored(counted.groupBy("h").agg(F.sum("n").alias("n"), F.first("shape").alias("shape")), "vocabulary")


@dataclass
class Lexicon:
    """Hashes of known tokens (sorted) with counts, those with a class of their own, and totals."""

    known: np.ndarray
    counts: np.ndarray
    known_class: np.ndarray
    top: np.ndarray
    top_class: np.ndarray
    class_words: np.ndarray
    class_tokens: np.ndarray
    docs: int
    tokens: int
    distinct: int


def lexicon(vocab: DataFrame, docs: int) -> Lexicon:
    """The bounded part of the vocabulary that scoring broadcasts; totals cover all of it."""
    level = F.floor(F.log2(F.col("n")) * 8)
    by_level = vocab.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    least, room = None, KNOWN
    for row in by_level:
        if row["words"] > room:
            break
        least, room = row["level"], room - row["words"]
    rows = vocab.where(level >= F.lit(least if least is not None else 1 << 20)).toPandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    totals = vocab.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    words, tokens = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(words, TOP + totals["shape"].to_numpy(int), totals["v"].to_numpy(float))
    np.add.at(tokens, TOP + totals["shape"].to_numpy(int), totals["n"].to_numpy(float))
    top = rows.head(TOP)
    np.add.at(words, TOP + top["shape"].to_numpy(int), -1.0)
    np.add.at(tokens, TOP + top["shape"].to_numpy(int), -top["n"].to_numpy(float))
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order, first = np.argsort(hashes), np.argsort(hashes[: len(top)])
    return Lexicon(hashes[order], rows["n"].to_numpy(float)[order], TOP + rows["shape"].to_numpy(int)[order], hashes[: len(top)][first], first, words, tokens, docs, int(totals["n"].sum()) + docs, int(totals["v"].sum()) + (docs > 0))


def _events(w: K.Words, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens and ends: history, class, offsets by document, the token's place (-1 for ends)."""
    counts = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    total = int(first[-1])
    ends = first[1:] - 1
    is_end = np.zeros(total, np.bool_)
    is_end[ends] = True
    place = np.full(total, -1, np.int64)
    place[~is_end] = np.arange(len(w.hashes))
    kind = TOP + _shapes(w)
    if len(lex.top):
        at = np.minimum(np.searchsorted(lex.top, w.hashes), len(lex.top) - 1)
        hit = lex.top[at] == w.hashes
        kind[hit] = lex.top_class[at[hit]]
    h, c = np.zeros(total, np.uint64), np.full(total, END, np.int64)
    h[~is_end], c[~is_end] = w.hashes, kind
    one, two = np.full(total, START), np.full(total, START)
    one[1:], two[2:] = c[:-1], c[:-2]
    begin = first[:-1]
    one[begin] = START
    two[begin] = START
    second = begin + 1
    second = second[second < first[1:]]
    two[second] = START
    same = np.zeros(total, np.bool_)
    same[1:] = h[1:] == h[:-1]
    same[begin], same[ends] = False, False
    run = np.zeros(total, np.int64)
    run[1:] = same[:-1]
    run[begin] = 0
    target = np.where(same, AGAIN, c)
    return (one * CLASSES + two) * 2 + run, target, first, place, same


def _tables(batches: Iterator[pa.RecordBatch], lex: Lexicon) -> Iterator[pa.RecordBatch]:
    table = np.zeros(CLASSES * CLASSES * 2 * CLASSES, np.int64)
    for batch in batches:
        for w in K.words(batch.column(0), K.SOLID):
            history, target, *_ = _events(w, lex)
            np.add.at(table, history * CLASSES + target, 1)
    task = TaskContext.get().partitionId()
    for one, block in enumerate(table.reshape(CLASSES, -1)):
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names=["one", "task", "counts"])


def _add_tables(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
    return pd.DataFrame({"one": pdf["one"].iloc[:1], "task": pdf["task"].iloc[:1] // FAN, "counts": [zlib.compress(total.tobytes(), 1)]})


def statistics(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(history, class) counts of all tokens of ``text``, a row for each class of the last token."""
    held = texts.sparkSession.sparkContext.broadcast(lex)
    schema = "one int, task int, counts binary"
    source = texts.select("text")
    tasks = source.rdd.getNumPartitions()
    out = source.mapInArrow(lambda b: _tables(b, held.value), schema)
    while True:  # at most FAN tables meet in one task
        out = out.groupBy("one", F.floor(F.col("task") / FAN)).applyInPandas(_add_tables, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return cut(out.repartition(8, "one"))


@dataclass
class Weights:
    """Feature weights: each row of ``table`` is one feature's weight for every class."""

    table: np.ndarray

    @staticmethod
    def rows(one: np.ndarray, two: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
        """Row numbers of the active features: bias, bigram, skip, trigram, repetition.

        A trigram's hash stays within its last class's share of the rows, so tasks that have other
        last classes have other trigram rows.
        """
        trigram = one * (TRIGRAMS // CLASSES) + (two * 40503 + 7) % 65521 % (TRIGRAMS // CLASSES)
        return [np.zeros(len(one), np.int64), 1 + one, 1 + CLASSES + two, 1 + 2 * CLASSES + trigram, 1 + 2 * CLASSES + TRIGRAMS + run]

    @classmethod
    def empty(cls) -> "Weights":
        return cls(np.zeros((1 + 2 * CLASSES + TRIGRAMS + 2, CLASSES), np.float32))

    def log_classes(self, one: np.ndarray, two: np.ndarray, run: np.ndarray) -> np.ndarray:
        logits = sum(self.table[r] for r in self.rows(one, two, run)).astype(float)
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def all_log10(self) -> np.ndarray:
        """log10 P(class | history) for every history, as one flat table."""
        history = np.arange(CLASSES * CLASSES * 2)
        out = np.empty((len(history), CLASSES), np.float32)
        for lo in range(0, len(history), 4096):
            part = history[lo : lo + 4096]
            out[lo : lo + 4096] = self.log_classes(part // (2 * CLASSES), part // 2 % CLASSES, part % 2) / np.log(10)
        return out.reshape(-1)


MOMENTS = "rows binary, expected binary, seen binary, likelihood double"


def _moments(batches: Iterator[pa.RecordBatch], weights: Weights, with_seen: bool) -> Iterator[pa.RecordBatch]:
    """Expected (and observed) counts of the features that a share of the histories has."""
    seen, expected, likelihood = np.zeros(weights.table.shape), np.zeros(weights.table.shape), 0.0
    for batch in batches:
        for one, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(raw), np.int64).reshape(CLASSES * 2, CLASSES)
            some = np.flatnonzero(counts.any(axis=1))
            counts = counts[some].astype(float)
            args = np.full(len(some), one), some // 2, some % 2
            logs = weights.log_classes(*args)
            likelihood += float((counts * logs).sum())
            model = np.exp(logs) * counts.sum(axis=1, keepdims=True)
            for rows in weights.rows(*args):
                np.add.at(expected, rows, model)
                if with_seen:
                    np.add.at(seen, rows, counts)
    used = np.flatnonzero(expected.any(axis=1))
    values = [used.astype(np.int32), expected[used].astype(np.float32), seen[used].astype(np.float32) if with_seen else None]
    yield pa.RecordBatch.from_arrays([*(pa.array([None if v is None else v.tobytes()], pa.binary()) for v in values), pa.array([likelihood])], names=["rows", "expected", "seen", "likelihood"])


def train(stats: DataFrame, rounds: int = ROUNDS) -> Weights:
    """Distributed gradient updates, each feature's step scaled by its expected count."""
    weights, rate, best, seen = Weights.empty(), 1.0, None, None
    active = len(Weights.rows(*[np.zeros(1, np.int64)] * 3))
    for _ in range(rounds):
        held = stats.sparkSession.sparkContext.broadcast(weights)
        first = seen is None
        parts = stats.select("one", "counts").mapInArrow(lambda b, held=held, first=first: _moments(b, held.value, first), MOMENTS).toArrow()
        held.destroy()
        if not parts.num_rows:
            break
        expected, total = np.zeros(weights.table.shape), np.zeros(weights.table.shape)
        for row in parts.to_pylist():
            at = np.frombuffer(row["rows"], np.int32)
            expected[at] += np.frombuffer(row["expected"], np.float32).reshape(-1, CLASSES)
            if first:
                total[at] += np.frombuffer(row["seen"], np.float32).reshape(-1, CLASSES)
        seen = total if first else seen
        likelihood = sum(parts.column(3).to_pylist())
        if best is not None and likelihood < best:
            rate /= 2
        best = max(likelihood, best) if best is not None else likelihood
        step = (seen - expected - PULL * weights.table) / (active * (np.maximum(expected, 0.2 * seen) + 1))
        weights = Weights((weights.table + rate * np.clip(step, -1, 1)).astype(np.float32))
    return weights


SCORES = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>, rare_n array<int>, rare_m array<int>, shard int, contexts binary, words binary, places binary"
_DOC, _EVENT = 10, 3  # columns of SCORES that rows of texts have, and rows of events after their row number


def _norms(lex: Lexicon) -> np.ndarray:
    """log10 of what counts plus one are divided by, for every class; 0 for classes of one word."""
    norm = np.zeros(CLASSES)
    norm[TOP : TOP + SHAPES] = np.log10(lex.class_tokens + lex.class_words + 1)[TOP : TOP + SHAPES]
    return norm


def _context_events(w: K.Words, lex: Lexicon, first: np.ndarray, place: np.ndarray, target: np.ndarray, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context hash, number of the known word, and document of the tokens that may have a word feature."""
    doc = np.repeat(np.arange(len(w.docs)), np.diff(first))
    inner = np.flatnonzero(place >= 0)
    token, kind = place[inner], target[inner]
    is_top = np.zeros(len(w.hashes), np.bool_)
    if len(lex.top):
        near = np.minimum(np.searchsorted(lex.top, w.hashes), len(lex.top) - 1)
        is_top = lex.top[near] == w.hashes
    one, two = token - 1, token - 2
    begin = w.first[:-1][doc[inner]]
    plain = (one >= begin) & ~is_top[one]
    skip = (one >= begin) & is_top[one] & (two >= begin) & ~is_top[two]
    fit = np.flatnonzero((plain | skip) & (kind >= TOP) & (kind < TOP + SHAPES) & known[token])
    source = np.where(plain[fit], w.hashes[one[fit]], w.hashes[two[fit]])
    context = K.mix(source * np.uint64(2) + plain[fit].astype(np.uint64) + kind[fit].astype(np.uint64) * np.uint64(K._BASE))
    return context, at[token[fit]], doc[inner][fit]


def _score(batches: Iterator[pa.RecordBatch], lex: Lexicon, weights: Weights, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each text: sums over tokens that need only the broadcast counts, and the other tokens with
    their uses; and rows of events for the shards, numbered from a text on (``row``)."""
    table, logs = weights.all_log10(), np.log10(lex.counts + 1)
    norm, end = _norms(lex), np.log10(lex.docs + 1.0)
    names, types = [x.split()[0] for x in SCORES.split(", ")], [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    row = TaskContext.get().partitionId() << 33  # texts are numbered within their task, and stored with their number
    held, size, base_row = [], 0, row

    def events() -> pa.RecordBatch:
        context, word, place = (np.concatenate(x) for x in zip(*held))
        shard = (context >> np.uint64(40)).astype(np.int64) % shards
        order = np.lexsort((context & np.uint64(0xFFFFFFFF), shard))
        context, word, place, shard = context[order], word[order], place[order], shard[order]
        some, begin = np.unique(shard, return_index=True)
        ends = np.append(begin[1:], len(shard))
        context = context.astype(np.uint32)  # sorted by shard and by its high bits, so gaps are packed
        packed = [[_pack(x[a:b]) for a, b in zip(begin, ends)] for x in (context, word.astype(np.uint32), place.astype(np.uint32))]
        columns = [pa.array([base_row] * len(some), types[0]), *(pa.nulls(len(some), t) for t in types[1:_DOC]), pa.array(some, types[_DOC]), *(pa.array(p, pa.binary()) for p in packed)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(np.bool_)
        for w in K.words(batch.column(2), K.SOLID):
            history, target, first, place, same = _events(w, lex)
            docs = len(w.docs)
            model = np.add.reduceat(table[history * CLASSES + target].astype(float) - norm[target], first[:-1])
            at = np.minimum(np.searchsorted(lex.known, w.hashes), max(len(lex.known) - 1, 0))
            known = lex.known[at] == w.hashes if len(lex.known) else np.zeros(len(w.hashes), np.bool_)
            value = np.where(known, logs[at], 0.0) if len(lex.known) else np.zeros(len(w.hashes))
            inner = target[place >= 0]
            within = (inner >= TOP) & (inner < TOP + SHAPES)
            of = np.repeat(np.arange(docs), np.diff(w.first))
            base = np.bincount(of, value, docs) + end
            model += np.bincount(of, value * within, docs)
            n_known = np.bincount(of, known, docs).astype(np.int64) + (lex.docs > 0)
            rare = np.flatnonzero(~known)
            key, back = np.unique(np.stack([of[rare].astype(np.uint64), w.hashes[rare]], 1), axis=0, return_inverse=True) if len(rare) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            cuts = np.searchsorted(key[:, 0], np.arange(docs + 1).astype(np.uint64)).astype(np.int32)
            uses, inside = np.bincount(back, minlength=len(key)).astype(np.int32), np.bincount(back, within[rare], len(key)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (key[:, 1].copy().view(np.int64), uses, inside)]
            rows = slice(w.docs.start, w.docs.stop)
            columns = [pa.array(np.arange(row, row + docs)), batch.column(0)[rows], batch.column(1)[rows], pa.array(np.diff(w.first) + 1), pa.array(n_known), pa.array(base), pa.array(model), *lists]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(docs, t) for t in types[_DOC:])], names=names)
            context, word, doc = _context_events(w, lex, first, place, target, at, known)
            # the lowest bit of a place says whether the text is for training
            held.append((context, word, (row - base_row + doc) * 2 + train[w.docs.start : w.docs.stop][doc]))
            size, row = size + len(context), row + docs
            if size > CHUNK or row - base_row > 1 << 30:
                if size:
                    yield events()
                held, size, base_row = [], 0, row
    if size:
        yield events()


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers as gaps, byte by byte and compressed."""
    gaps = np.diff(values, prepend=np.uint32(0)).astype(np.uint32)
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint32)


PARTS = "row bigint, texts binary, gains binary"
FEATURES = "row bigint, features double"


def _shard_scores(table: pa.Table, lex: Lexicon) -> pa.Table:
    """What the word features of one shard's contexts add to the log10 probability of each text: for each
    row of events, its texts by their place and what they gain."""
    parts = {n: [_unpack(x) for x in table.column(n).to_pylist()] for n in ("contexts", "words", "places")}
    context, word, place = (np.concatenate(parts[n]) for n in ("contexts", "words", "places"))
    train = (place & 1).astype(np.int64)
    features, of = np.unique((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
    n = np.bincount(of, train, len(features))
    contexts, in_context = np.unique(features >> np.uint64(32), return_inverse=True)
    total = np.bincount(in_context, n, len(contexts))
    kept = n >= LEAST
    share = np.bincount(in_context, np.where(kept, n - OFF, 0.0), len(contexts)) / np.maximum(total, 1)
    number = (features & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = np.log10(lex.counts[number] + 1) - _norms(lex)[lex.known_class[number]]
    gain = np.where(kept, np.log10(np.maximum(n - OFF, OFF) / np.maximum(total, 1)[in_context]) - own, np.log10(1 - share)[in_context])[of]
    texts, gains, at = [], [], 0
    for own_places in parts["places"]:
        some, back = np.unique(own_places >> 1, return_inverse=True)
        texts.append(some.astype(np.uint32).tobytes())
        gains.append(np.bincount(back, gain[at : at + len(own_places)], len(some)).astype(np.float64).tobytes())
        at += len(own_places)
    return pa.table({"row": table.column("row"), "texts": pa.array(texts, pa.binary()), "gains": pa.array(gains, pa.binary())})


def _block_scores(table: pa.Table) -> pa.Table:
    """The gains of one block's texts over all shards; they are rounded, so their order does not count."""
    texts, gains = (np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()]) for n, t in (("texts", np.uint32), ("gains", np.float64)))
    some, back = np.unique(texts, return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, back, np.round(gains * 1e9).astype(np.int64))
    return pa.table({"row": pa.array(table.column("row")[0].as_py() + some.astype(np.int64)), "features": pa.array(total / 1e9)})


def fitted(docs: DataFrame) -> tuple[DataFrame, Lexicon, Weights]:
    """(vocabulary, lexicon, class weights) of the rows of ``docs`` (held_out, text) that are not held out."""
    training = docs.where(~F.col("held_out"))
    vocab = vocabulary(training)
    lex = lexicon(vocab, training.count())
    return vocab, lex, train(statistics(training, lex))


def scores(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all of them."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), is_held_out().alias("held_out"), "text")
    vocab, lex, weights = fitted(rows)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((lex, weights))
    shards = max(partitions(spark), lex.tokens // SHARD_TOKENS)
    both = stored(rows.mapInArrow(lambda b: _score(b, *held.value, shards), SCORES), "scores")
    part = both.where(F.col("shard").isNull()).drop("shard", "contexts", "words", "places")
    events = both.where(F.col("shard").isNotNull()).select("shard", "row", "contexts", "words", "places")
    words = events.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: _shard_scores(t, held.value[0]), PARTS)
    words = words.groupBy("row").applyInArrow(_block_scores, FEATURES)
    rare = part.select("row", F.explode(F.arrays_zip("rare", "rare_n", "rare_m")).alias("t")).select("row", F.col("t.rare").alias("h"), F.col("t.rare_n").alias("u"), F.col("t.rare_m").alias("m"))
    log = F.log10(F.col("n") + 1)
    late = rare.join(vocab.select("h", "n"), "h").groupBy("row").agg(F.sum("u").alias("late_known"), F.sum(F.col("u") * log).alias("late_base"), F.sum(F.col("m") * log).alias("late_model"))
    out = part.drop("rare", "rare_n", "rare_m").join(late, "row", "left").join(words, "row", "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    total = float(np.log10(lex.tokens + lex.distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("late_base") - F.col("n_tokens") * total).alias("base_score"), (F.col("model") + none("late_model") + none("features")).alias("score"),
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
