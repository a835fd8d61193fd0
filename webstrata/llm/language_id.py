"""Language identification by Bayesian evidence fusion.

Evidence of a text: the likelihood of its hashed byte trigrams under each language, the language its
markup declares, its address suffix, and its host. Fusion adds log-likelihoods:

    log P(l | host) + log P(declared | l) + TEMPER * log P(trigrams | l)

P(l | host) is smoothed hierarchically: host counts lean on the counts of the address suffix, those
on the global ones, each with ``PRIOR_ROWS`` pseudo-rows. P(declared | l) is a smoothed confusion
table, so a declaration weighs as much as declarations have proved right. All these counts come from
grouped aggregations, over all rows, of the language that the trigrams alone prefer; a row's own vote
is taken out of its host's and suffix's counts.

The trigram model is fitted on at most ``TRAIN_ROWS`` rows for each declared language, chosen by hash;
every language that any row declares is a candidate. The floor under the counts of a language grows with
its rows, so that one of few rows is not taken for an even mixture. Texts are scored against the
languages in tiles of ``TILE``, one after the other, so a task holds the table of one tile only. Trigrams
are equally likely under one more candidate, ``und``. A row is rejected if it has no letters, if ``und``
wins, or if the winner's posterior is under ``SURE``.

Defined cases: an empty table gives no rows; a null or empty text and one without letters are rejected
with language ``und``; null declarations, hosts and suffixes are values of their own, declarations that
are no language code (two or three letters) count as none; repeated rows get equal results; whole texts
are scored; extra columns are kept where rows are filtered.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from webstrata.llm import kernels as K
from webstrata.llm.common import join_sized, put_back, row_key, set_aside, small_batches, stored

TRAIN_ROWS, TILE = 20_000, 64
GRAMS = 1 << 16
PRIOR_ROWS, TEMPER, SURE, UNKNOWN = 20.0, 0.25, 0.7, 1e-3

#: Letters stay, everything else becomes a blank: digits and marks say nothing about the language.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _grams(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Hashed trigrams of folded bytes with a letter in the middle: documents, hashes, offsets."""
    data, offsets = K.buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + K.PIECE, "right")) - 1)
        lo, hi = offsets[row], offsets[stop]
        buf = _FOLD[K.LOWER[data[lo:hi]]]
        inner = offsets[row : stop + 1] - lo
        if len(buf):
            before, after = np.empty_like(buf), np.empty_like(buf)
            before[0] = after[-1] = 0x20
            before[1:], after[:-1] = buf[:-1], buf[1:]
            edge = inner[:-1][inner[:-1] < inner[1:]]
            before[edge], after[inner[1:][inner[:-1] < inner[1:]] - 1] = 0x20, 0x20
            keep = np.flatnonzero(buf != 0x20)
            code = (before[keep].astype(np.uint32) * 0x9E3779B1 + buf[keep].astype(np.uint32) * 0x85EBCA6B + after[keep].astype(np.uint32) * 0xC2B2AE35) & 0xFFFFFFFF
            code = ((code ^ (code >> 15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        else:
            keep = code = np.zeros(0, np.uint32)
        yield range(row, stop), code, np.searchsorted(keep, inner)
        row = stop


@dataclass
class Model:
    """Log-probabilities (grams x languages) of the trigram model, in tiles of languages."""

    languages: list[str]
    tiles: list[np.ndarray]


def fit(rows: DataFrame) -> Model:
    """Fit the trigram model on a bounded, hashed sample of the rows of each declared language."""
    labelled = rows.where("declared is not null")
    counts = [(r["declared"], r["n"]) for r in labelled.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).orderBy("declared").collect()]  # language codes: 18,000 at most
    shares = rows.sparkSession.createDataFrame([(name, min(1.0, TRAIN_ROWS / n)) for name, n in counts], "declared string, share double")
    sample = labelled.join(F.broadcast(shares), "declared").where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for name, total in held.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["declared", "gram", "n"])
            held.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for docs, code, first in _grams(batch.column(1)):
                for k, doc in enumerate(docs):
                    if names[doc] not in held and len(held) >= TILE:
                        yield from emit()
                    total = held.setdefault(names[doc], np.zeros(GRAMS, np.int64))
                    total += np.bincount(code[first[k] : first[k + 1]], minlength=GRAMS)
        yield from emit()

    with small_batches(rows.sparkSession):
        table = stored(sample.mapInArrow(count, "declared string, gram int, n bigint").groupBy("declared", "gram").agg(F.sum("n").alias("n")), "grams")
    languages, tiles = [name for name, _ in counts], []
    for lo in range(0, len(languages), TILE):
        names = languages[lo : lo + TILE]
        found = table.where(F.col("declared").between(names[0], names[-1])).toPandas()
        tile = np.zeros((GRAMS, len(names)))
        at = {name: k for k, name in enumerate(names)}
        np.add.at(tile, (found["gram"].to_numpy(int), found["declared"].map(at).to_numpy(int)), found["n"].to_numpy())
        tile += 0.5 * np.clip(tile.sum(axis=0) / GRAMS, 1e-3, 1)
        tiles.append(np.log(tile / tile.sum(axis=0)).astype(np.float32))
    return Model(languages, tiles)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Slim rows (row, declared, host, suffix, grams, likelihoods, vote); the text is left behind."""
    held = [rows.sparkSession.sparkContext.broadcast(tile) for tile in model.tiles]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, parts = np.zeros(batch.num_rows, np.int64), []
            for tile in held or [None]:
                table = tile.value if tile is not None else np.zeros((GRAMS, 0), np.float32)
                out = np.zeros((batch.num_rows, table.shape[1]))
                for docs, code, first in _grams(batch.column(batch.num_columns - 1)):
                    n = np.diff(first)
                    grams[docs.start : docs.stop] = n
                    some = np.flatnonzero(n)
                    if len(some) and table.shape[1]:
                        out[docs.start + some] = np.add.reduceat(table[code], first[some], axis=0, dtype=np.float64)
                parts.append(out)
            out = np.concatenate(parts, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(grams), lists], names=[*batch.schema.names[:-1], "grams", "likelihoods"])

    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", grams bigint, likelihoods array<double>"
    best = F.array_position("likelihoods", F.array_max("likelihoods")).cast("int") - 1
    return rows.select(*names, "text").mapInArrow(score, schema).withColumn("vote", F.when((F.col("grams") > 0) & (F.size("likelihoods") > 0), best).otherwise(F.lit(-1)))


def _votes(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """For each key the votes for every language, as an array; summed by vote before they meet."""
    each = rows.groupBy(*keys, "vote").agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("by_vote"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("by_vote", k), F.lit(0.0))).alias("votes"))


def _plus(a: F.Column, b: F.Column, weight: float) -> F.Column:
    """(a + weight * b / sum(b)), element by element."""
    total = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(a, b, lambda x, y: x + weight * y / total)


def identify(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """language, posterior, declared and rejected for ``rows`` (row, declared, host, suffix, text, ...)."""
    model = model or fit(rows)
    n = len(model.languages)
    key = lambda c: F.coalesce(c, F.lit("\u0000")).alias(f"_{c}")
    with small_batches(rows.sparkSession):
        slim = stored(scored(rows, model).select("*", key("declared"), key("host"), key("suffix")), "scored")
    if not n:
        return slim.select(*[c for c in rows.columns if c != "text"], F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))
    less = lambda a: F.transform(a, lambda x, k: F.when(k == F.col("vote"), F.greatest(x - 1.0, F.lit(0.0))).otherwise(x))
    everywhere = [1.0] * n
    for r in slim.where("vote >= 0").groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a language
        everywhere[r["vote"]] += r["n"]
    # how often a declaration goes with a vote: P(declared | language)
    said = stored(_votes(slim, ["_declared"], n).withColumn("said", F.zip_with("votes", F.array(*[F.lit(float(x)) for x in everywhere]), lambda x, y: F.log((x + 0.5) / (y + 1.0)))).drop("votes"), "said")
    suffix = stored(_votes(slim, ["_suffix"], n).withColumnRenamed("votes", "by_suffix"), "suffixes")
    host = stored(_votes(slim, ["_suffix", "_host"], n).withColumnRenamed("votes", "by_host"), "hosts")
    wide = 40 + 8 * n
    out = join_sized(slim, said, ["_declared"], "left", row_bytes=wide)
    out = join_sized(out, suffix, ["_suffix"], "left", row_bytes=wide)
    out = join_sized(out, host, ["_suffix", "_host"], "left", row_bytes=2 * wide)
    base = F.array(*[F.lit(float(x)) for x in everywhere])
    at_suffix = _plus(less(F.col("by_suffix")), base, PRIOR_ROWS)
    out = out.withColumn("at_suffix", at_suffix).withColumn("prior", _plus(less(F.col("by_host")), F.col("at_suffix"), PRIOR_ROWS))
    flat = -float(np.log(GRAMS))
    # per language, and last the unknown one, relative to its likelihood
    evidence = F.transform("likelihoods", lambda x: (x - flat * F.col("grams")) * TEMPER)
    total = F.aggregate("prior", F.lit(0.0), lambda acc, x: acc + x)
    logs = F.zip_with(F.zip_with(evidence, F.col("said"), lambda x, y: x + y), F.transform("prior", lambda x: F.log(x / total)), lambda x, y: x + y)
    unknown = float(np.log(UNKNOWN))
    out = out.withColumn("logs", F.concat(logs, F.array(F.lit(unknown)))).withColumn("top", F.array_max("logs"))
    names = F.array(*[F.lit(x) for x in [*model.languages, "und"]])
    language = F.when(F.col("grams") > 0, F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))).otherwise(F.lit("und"))
    posterior = F.when(F.col("grams") > 0, 1.0 / F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))).otherwise(0.0)
    judged = out.withColumn("language", language).withColumn("posterior", posterior)
    rejected = (F.col("language") == "und") | (F.col("posterior") < SURE)
    return judged.select(*[c for c in rows.columns if c != "text"], "language", "posterior", rejected.alias("rejected"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of documents: ``lang`` declares the language, ``source`` is the host."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), row_key().alias("row"), _primary(F.col("lang")).alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of pages: the html element's lang, the url's host and the host's last label."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    bare = _decoded(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "))
    some = lambda c: F.when(c != "", c)
    declared = _primary(some(F.regexp_extract("html", r"""(?i)<html\b[^>]*\slang\s*=\s*["']?([A-Za-z]+)""", 1)))
    return pages.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), row_key("page_id", "html").alias("row"), declared.alias("declared"), some(host).alias("host"), some(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), bare.alias("text"))


def _primary(code: F.Column) -> F.Column:
    """The primary subtag of a language tag; null unless it has two or three letters."""
    first = F.lower(F.substring_index(F.substring_index(F.trim(code), "-", 1), "_", 1))
    return F.when(first.rlike("^[a-z]{2,3}$"), first)


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    """Character references as the characters they stand for."""
    return text.map(lambda x: html.unescape(x) if x and "&" in x else x)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified; columns unchanged."""
    bad = stored(identify(document_rows(docs)).where("rejected").select("row").distinct(), "rejected")
    used = ["doc_id", "text"]
    keyed = set_aside(docs, used).withColumn("row", row_key())
    return join_sized(keyed, bad, ["row"], "left_anti", row_bytes=48).select(*put_back(docs.columns, used))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents and pages together, one model: doc_id or page_id tells which."""
    rows = document_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).unionByName(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return identify(rows).select("doc_id", "page_id", "declared", "language", F.round("posterior", 6).alias("posterior"), "rejected")
