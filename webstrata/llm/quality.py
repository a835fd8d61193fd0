"""Quality rules: plain counts, then the perplexity of a modified Kneser-Ney model in bands by language.

The model is over n-grams of ``ORDER`` bytes (runs of white space are one space, digits are one digit), so it
knows spelling, case and punctuation of a language, and it stays small: n-grams of bytes soon
repeat. Texts are parted in two folds by their hash; a text is scored by the counts of the other
fold, so neither it nor its exact copies vouch for it.

1. Counts: tasks count the n-grams of their texts by language and fold in numpy; a grouped aggregation
   adds them up. Counts of lower orders are numbers of different bytes before an n-gram (``orders``).
2. Probabilities: from order 1 on, p(w | h) = (c - D(c) + (D1 n1 + D2 n2 + D3 n3) p(w | h')) / c(h), with
   the discounts of counts 1, 2 and more that the counts of counts give (``probabilities``). A context has
   256 followers at most, so its sums are windows of a bounded size. Contexts that a fold lacks back off.
3. Storage: every n-gram of the corpus has its two log probabilities in arrays sorted by hash (``packed``).
4. Scores: tasks look every byte's n-gram up and add by document. The arrays of the n-grams that occur most are
   broadcast, ``MODEL_BYTES`` of them at most; only the n-grams that these lack, of which each occurs seldom, leave
   the task and are joined with the stored table (``_rest``).
5. Bands: median and median deviation of the log perplexity a word, by language, over different texts that pass the
   plain rules. A text is rejected outside ``WIDTH`` deviations; under ``SURE_WORDS`` words the band
   widens as the square root of what is missing.

Defined cases: an empty table gives no rows; null and empty texts have no words and fail, without perplexity and bounds; languages (null
counts as one) of fewer than ``LEAST_DOCS`` rows share a model and a band; where fewer different texts make a
band, none is rejected by it; repeated rows get equal results; a very long text is counted whole;
``accepted`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

from webstrata.llm import kernels as K
from webstrata.llm.common import cut, join_salted, join_sized, put_back, row_key, set_aside, small_batches, stored

ORDER, BYTES = 5, 256
WIDTH, SURE_WORDS, LEAST_DOCS = 6.0, 100, 50
#: Plain rules: fewest words, and most per cent of words in repeated windows of ``WINDOW`` words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Up to this size, the model's most frequent n-grams are broadcast, at ``ENTRY`` bytes each.
MODEL_BYTES, ENTRY = 64 << 20, 16
#: Different n-grams that a task holds before it passes them on, and n-grams that are looked at together.
HELD, STEP = 1 << 21, 1 << 18
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_LINE = np.ones(256, np.bool_)
_LINE[0x0A] = False
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes of the model: 0 stands before and after a text.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0] = 1
_FOLD[0x09:0x0E] = 0x20
_FOLD[0x30:0x3A] = 0x30


def _by_document(flags: np.ndarray, inner: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[inner[1:]] - sums[inner[:-1]]


def _plain_counts(w: K.Words, lines: K.Words, inner: np.ndarray) -> list[np.ndarray]:
    """``COUNTS`` of some documents; ``inner`` has their byte offsets."""
    docs, solid = len(w.docs), K.SOLID[w.buf]
    with np.errstate(over="ignore"):
        full = np.concatenate([[0], np.cumsum(solid)])
        some = full[lines.ends] > full[lines.starts]
        line, of = lines.hashes[some], (lines.of - w.docs.start)[some]
        own = np.unique(np.stack([of.astype(np.uint64), line], 1), axis=0)[:, 0] if len(line) else of
        same = np.bincount(of, minlength=docs) - np.bincount(own.astype(np.int64), minlength=docs)
        owner, repeated = w.of - w.docs.start, np.zeros(len(w.hashes), np.bool_)
        if len(owner) >= WINDOW:
            first = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
            key = K.mix(owner[first].astype(np.uint64) + np.uint64(1))
            for k in range(WINDOW):
                key = K.mix(key * np.uint64(K._BASE) + w.hashes[first + k])
            ordered = np.sort(key)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                hit = first[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
                for k in range(WINDOW):
                    repeated[hit + k] = True
    return [np.diff(w.first), _by_document(solid & ((w.buf & 0xC0) != 0x80), inner), _by_document(_SYMBOL[w.buf], inner), same, _by_document(repeated, w.first)]


def _sequence(buf: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's bytes of some documents, each between its ends, where each begins, and how many n-grams it has."""
    body = _FOLD[buf]
    keep = np.ones(len(body), np.bool_)
    keep[1:] = (body[1:] != 0x20) | (body[:-1] != 0x20)
    keep[inner[:-1][inner[:-1] < len(body)]] = True
    sizes = _by_document(keep, inner)
    begins = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    out = np.zeros(begins[-1], np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)) * ORDER + ORDER - 1, sizes)] = body[keep]
    return out, begins, sizes + 1


def _grams(sequence: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and n-grams, ``STEP`` at a time."""
    for at in range(0, len(sequence) - ORDER + 1, STEP):
        to = min(at + STEP, len(sequence) - ORDER + 1)
        gram = np.zeros(to - at, np.int64)
        for k in range(ORDER):
            gram = (gram << 8) | sequence[at + k : to + k]
        place = np.arange(at, to)
        of = np.searchsorted(begins, place, "right") - 1
        own = place - begins[of] < sizes[of]
        yield of[own], gram[own]


def _texts(column: pa.Array) -> Iterator[tuple[K.Words, np.ndarray]]:
    """Words of whole documents in runs, as they are written, with byte offsets of the documents."""
    offsets = K.buffers(column)[1]
    for w in K.words(column, K.SOLID, fold=K.AS_IS):
        yield w, offsets[w.docs.start : w.docs.stop + 1] - offsets[w.docs.start]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, limit = 0, HELD

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[first], np.add.reduceat(n, first)

    def emit(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lang = pa.DictionaryArray.from_arrays(pa.array((codes >> 41).astype(np.int32)), pa.array(list(names), pa.string())).dictionary_decode()
        return pa.RecordBatch.from_arrays([lang, pa.array((codes >> 40 & 1).astype(np.int32)), pa.array(codes & ((1 << 40) - 1)), pa.array(n)], names=["lang", "fold", "key", "n"])

    for batch in batches:
        group = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
        group = group << 41 | batch.column(1).to_numpy().astype(np.int64) << 40
        for w, inner in _texts(batch.column(2)):
            for of, gram in _grams(*_sequence(w.buf, inner)):
                held.append(np.unique(group[w.docs.start + of] | gram, return_counts=True))
                size += len(held[-1][0])
            if size > limit:
                held = [merged()]
                size = len(held[0][0])
                limit = 2 * size + HELD
                if size > HELD:
                    yield emit(*held[0])
                    held, size, limit = [], 0, HELD
    if held:
        yield emit(*merged())


def ngram_counts(texts: DataFrame) -> DataFrame:
    """lang, key and the counts c0 and c1 of both folds, of every n-gram of ``texts`` (lang, fold, text)."""
    with small_batches(texts.sparkSession):
        raw = texts.select("lang", "fold", "text").mapInArrow(_count_batches, "lang string, fold int, key bigint, n bigint")
        return stored(raw.groupBy("lang", "key").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"c{f}") for f in (0, 1)]), "ngrams")


def orders(counts: DataFrame) -> list[DataFrame]:
    """Counts of orders 1 to ``ORDER``; those under the highest count the different bytes before an n-gram."""
    out = [counts]
    for n in range(ORDER - 1, 0, -1):
        shorter = out[0].groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("key"))
        out.insert(0, stored(shorter.agg(*[F.count_if(F.col(f"c{f}") > 0).alias(f"c{f}") for f in (0, 1)]), "ngrams"))
    return out


def _discounts(counts: DataFrame) -> DataFrame:
    """d1, d2 and d3 for each language and fold (as d10, d11, ...), from the counts of counts 1 to 4."""
    seen = counts.groupBy("lang").agg(*[F.count_if(F.col(f"c{f}") == k).cast("double").alias(f"n{k}{f}") for f in (0, 1) for k in (1, 2, 3, 4)])
    out = [F.col("lang")]
    for f in (0, 1):
        n = [None, *[F.col(f"n{k}{f}") for k in (1, 2, 3, 4)]]
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            d = F.when((n[k] > 0) & (n[1] > 0), k - (k + 1) * y * F.try_divide(n[k + 1], n[k])).otherwise(k / 2)
            out.append(F.greatest(F.lit(0.05), F.least(d, F.lit(k - 0.05))).alias(f"d{k}{f}"))
    return cut(seen.select(*out))


def probabilities(counts: list[DataFrame]) -> DataFrame:
    """lang, key, number n and the probabilities p0 and p1 that the folds give the last byte of each n-gram of the highest order."""
    lower = None
    for n, table in enumerate(counts, 1):
        rows = join_sized(table.withColumn("context", F.shiftright("key", 8)), _discounts(table), ["lang"], "inner", row_bytes=128)
        every = Window.partitionBy("lang", "context")  # of 256 rows at most
        for f in (0, 1):
            c = F.col(f"c{f}")
            rows = rows.withColumn(f"all{f}", F.sum(c).over(every))
            rows = rows.withColumn(f"left{f}", sum(F.col(f"d{k}{f}") * F.count_if(c == k if k < 3 else c >= k).over(every) for k in (1, 2, 3)))
        if lower is None:
            rows = rows.withColumn("q0", F.lit(1 / BYTES)).withColumn("q1", F.lit(1 / BYTES))
        else:
            rows = rows.withColumn("shorter", F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            rows = rows.join(lower.select("lang", F.col("key").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), ["lang", "shorter"])
        found = [F.col("lang"), F.col("key"), (F.col("c0") + F.col("c1")).alias("n")]
        for f in (0, 1):
            c = F.col(f"c{f}")
            d = F.when(c >= 3, F.col(f"d3{f}")).when(c == 2, F.col(f"d2{f}")).when(c == 1, F.col(f"d1{f}")).otherwise(0.0)
            found.append(F.when(F.col(f"all{f}") > 0, (c - d + F.col(f"left{f}") * F.col(f"q{f}")) / F.col(f"all{f}")).otherwise(F.col(f"q{f}")).alias(f"p{f}"))
        lower = stored(rows.select(*found), "probabilities")
    return lower


@dataclass
class Model:
    """Hashes of n-grams in order, where those of each leading part begin, and log probabilities for both folds.

    A last place, of log probability 0, stands for the n-grams that the model lacks.
    """

    hashes: np.ndarray
    begins: np.ndarray
    logs: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, logs: np.ndarray) -> Model:
        hashes = K.mix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        bits = max(1, int(len(keys)).bit_length())
        begins = np.searchsorted(hashes[order], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return Model(np.append(hashes[order], np.uint64((1 << 64) - 1)), begins.astype(np.int32), np.append(logs[:, order], np.zeros((2, 1), logs.dtype), 1))

    @property
    def last(self) -> int:
        return len(self.hashes) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of n-grams, ``last`` for those that the model lacks."""
        h = K.mix(keys.astype(np.uint64))
        bits = len(self.begins).bit_length() - 1
        at = self.begins[h >> np.uint64(64 - bits)]
        todo = np.flatnonzero(self.hashes[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.hashes[at[todo]] < h[todo]]
        at[self.hashes[at] != h] = self.last
        return at


def _pack(table: pa.Table) -> pa.Table:
    """One language's part of the table as arrays in the order of their hashes."""
    keys = table["key"].to_numpy()
    order = np.argsort(K.mix(keys.astype(np.uint64)))
    logs = np.log(np.stack([table["p0"].to_numpy(), table["p1"].to_numpy()])[:, order]).astype(np.float32)
    return pa.table({"lang": table["lang"].slice(0, 1), "keys": pa.array([keys[order].tobytes()], pa.binary()), "logs": pa.array([logs.tobytes()], pa.binary())})


def packed(table: DataFrame) -> DataFrame:
    """The stored model: a row of sorted arrays for each language and part of 2^16 n-grams or so."""
    parts = max(1, table.count() >> 16)
    return stored(table.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("lang", "part").applyInArrow(_pack, "lang string, keys binary, logs binary"), "kn_model")


def _loaded(model: DataFrame) -> dict[str, Model]:
    """The whole model, whose size has been checked."""
    found: dict[str, list] = {}
    for row in model.toLocalIterator():
        keys = np.frombuffer(row["keys"], np.int64)
        found.setdefault(row["lang"], []).append((keys, np.frombuffer(row["logs"], np.float32).reshape(2, -1)))
    return {lang: Model.of(np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts], 1)) for lang, parts in found.items()}


def _held_from(table: DataFrame) -> tuple[int, bool]:
    """From how many occurrences on n-grams are broadcast, and whether those are all."""
    steps = table.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("size"))  # of 512 rows at most
    room, least = MODEL_BYTES // ENTRY, (1 << 63) - 1
    for row in steps.orderBy(F.desc("least")).collect():
        room -= row["size"]
        if room < 0:
            return least, False
        least = row["least"]
    return least, True


def _rows(given: pa.Schema, rows: int, columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """A batch of the columns that are stored with the scores, null where they are not in ``columns``."""
    types = {f.name: f.type for f in list(given)[:4]} | dict.fromkeys([*COUNTS, "place", "key", "n"], pa.int64()) | {"logp": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(rows, kind) for c, kind in types.items()], names=list(types))


def _score_batches(batches: Iterator[pa.RecordBatch], models: dict[str, Model]) -> Iterator[pa.RecordBatch]:
    """Counts and log probability of every document, numbered by ``place``; rows with a key are n-grams that the models lack."""
    place, none = TaskContext.get().partitionId() << 40, Model.of(np.zeros(0, np.int64), np.zeros((2, 0), np.float32))
    held: list[tuple[str, np.ndarray]] = []

    def lacking() -> pa.RecordBatch:
        """Rows of the n-grams in ``held``, which have the document's number before the n-gram."""
        found = [(name, *np.unique(codes, return_counts=True)) for name, codes in held]
        codes, n = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(x[1]) for x in found])), pa.array([x[0] for x in found], pa.string())).dictionary_decode()
        of = codes >> 8 * ORDER
        return _rows(batch.schema, len(codes), {"lang": lang, "fold": (1 - fold[of]).astype(np.int32), "place": place + of, "key": codes & ((1 << 8 * ORDER) - 1), "n": n})

    for batch in batches:
        langs, folds = batch.column(1).to_pylist(), 1 - batch.column(2).to_numpy()
        lines = K.words(batch.column(4), _LINE, fold=K.AS_IS)
        for (w, inner), by_line in zip(_texts(batch.column(4)), lines):
            counts = _plain_counts(w, by_line, inner)
            total = np.zeros(len(w.docs))
            own, fold = langs[w.docs.start : w.docs.stop], folds[w.docs.start : w.docs.stop]
            names = list(dict.fromkeys(own))
            group = np.array([names.index(x) for x in own])
            for of, gram in _grams(*_sequence(w.buf, inner)):
                for k, name in enumerate(names):
                    on = np.flatnonzero(group[of] == k)
                    if len(on):
                        model = models.get(name, none)
                        at = model.find(gram[on])
                        total += np.bincount(of[on], model.logs[fold[of[on]], at], len(w.docs))
                        lacks = on[at == model.last]
                        if len(lacks):
                            held.append((name, of[lacks] << 8 * ORDER | gram[lacks]))
                if sum(len(x) for _, x in held) > STEP:
                    yield lacking()
                    held = []
            if held:
                yield lacking()
                held = []
            same = {batch.schema.names[k]: batch.column(k).slice(w.docs.start, len(w.docs)) for k in (0, 1, 2, 3)}
            yield _rows(batch.schema, len(w.docs), same | dict(zip(COUNTS, counts)) | {"place": place + np.arange(len(w.docs)), "logp": total})
            place += len(w.docs)


def _rest(grams: DataFrame, table: DataFrame) -> DataFrame:
    """place and the log probability of its ``grams``, by a join with the table, whose n is at least the number of a key's rows."""
    both = join_salted(grams.withColumnRenamed("n", "times"), table.drop("n"), ["lang", "key"], "inner", counts=table.select("lang", "key", "n"))
    return both.groupBy("place").agg(F.sum(F.col("times") * F.log(F.when(F.col("fold") == 0, F.col("p1")).otherwise(F.col("p0")))).alias("more"))


def _bands(rows: DataFrame) -> DataFrame:
    """lang, middle and spread of the log perplexity, in thousandths, from counts of its values."""
    bins = rows.where(~F.col("base_failed")).select("lang", "text_hash", F.floor(F.col("nats") * 1000).cast("long").alias("bin")).distinct().groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))

    def median(table: DataFrame, value: str) -> DataFrame:
        """By language; there are as many rows as there are thousandths, not texts."""
        sums = table.withColumn("_sum", F.sum("n").over(Window.partitionBy("lang").orderBy(value))).withColumn("_all", F.sum("n").over(Window.partitionBy("lang")))
        return sums.where(2 * F.col("_sum") >= F.col("_all")).groupBy("lang").agg(F.min(value).alias("middle"), F.first("_all").alias("n_texts"))

    bins = cut(bins)
    middle = cut(median(bins, "bin"))
    away = join_sized(bins, middle.select("lang", "middle"), ["lang"], "inner", row_bytes=64).groupBy("lang", F.abs(F.col("bin") - F.col("middle")).alias("away")).agg(F.sum("n").alias("n"))
    spread = median(away, "away").select("lang", F.greatest(1.4826 * F.col("middle"), F.lit(20.0)).alias("spread"))
    return cut(middle.join(spread, "lang").where(F.col("n_texts") >= LEAST_DOCS).select("lang", "middle", "spread"))


def judged(docs: DataFrame, id_column: str = "doc_id", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """The id, ``COUNTS``, base_failed, perplexity, lower and upper bound, kept, and group of every document."""
    group = F.coalesce(F.col(lang), F.lit(""))
    known = cut(docs.groupBy(group.alias("lang")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_DOCS) & (F.col("lang") != "")).select("lang", F.col("lang").alias("known")))
    rows = join_sized(docs.select(F.col(id_column).alias("id"), group.alias("lang"), "text"), known, ["lang"], "left", row_bytes=64)
    texts = rows.select("id", F.coalesce("known", F.lit("")).alias("lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    texts = texts.select("id", "lang", F.pmod("text_hash", F.lit(2)).cast("int").alias("fold"), "text_hash", "text")
    table = probabilities(orders(ngram_counts(texts)))
    least, whole = _held_from(table)
    held = docs.sparkSession.sparkContext.broadcast(_loaded(packed(table.where(F.col("n") >= least))))
    longs = [T.StructField(c, T.LongType()) for c in (*COUNTS, "place", "key", "n")]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in texts.schema.fields[:4]], *longs, T.StructField("logp", T.DoubleType())])
    with small_batches(docs.sparkSession):
        both = stored(texts.mapInArrow(lambda b: _score_batches(b, held.value), schema), "scored")
    scored = both.where("key is null").drop("key", "n")
    if not whole:
        more = _rest(both.where("key is not null").select("place", "lang", "fold", "key", "n"), table.where(F.col("n") < least))
        scored = stored(scored.join(more, "place", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0))).drop("more"), "scored")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("nats", F.when(F.col("n_words") > 0, -F.col("logp") / F.col("n_words")))
    out = join_sized(scored, _bands(scored), ["lang"], "left", row_bytes=64)
    less = F.when(F.col("n_words") > 0, F.lit(float(SURE_WORDS)) / F.col("n_words"))
    wide = F.when(F.col("n_words") > 0, width * F.col("spread") / 1000 * F.sqrt(F.greatest(F.lit(1.0), less)))
    low, high = F.col("middle") / 1000 - wide, F.col("middle") / 1000 + wide
    kept = ~F.col("base_failed") & F.coalesce(F.col("nats").between(low, high), F.lit(True))
    return out.select("id", *COUNTS, "base_failed", kept.alias("kept"), F.exp("nats").alias("perplexity"), F.exp(low).alias("lower"), F.exp(high).alias("upper"), F.col("lang").alias("model"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    used = ["doc_id", "text", "lang"]
    rows = set_aside(docs, used).withColumn("_key", row_key())
    good = stored(judged(rows, "_key").where("kept").select(F.col("id").alias("_key")).distinct(), "kept")
    return join_salted(rows, good, ["_key"], "inner").select(*put_back(docs.columns, used))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judged(docs).withColumnRenamed("id", "doc_id")
