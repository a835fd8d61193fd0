"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 3, 1, 2, 3, 1, 2, ...; together they get 1.5
times all words; a target stops at twice its source's words and the excess goes to the others.

Rates: of all document rates r in 0..2 whose words meet the source's target, take those that lose
the least entropy against r = 1. They are exponentially tilted, r = min(2, exp(lambda * size)), with
one dual variable for each source's token constraint. The convex dual is solved by safeguarded
Newton iterations; each is one grouped aggregation for gradient and curvature, over the exact
(source, size) histogram instead of the documents. Sums are exact decimals, so reruns agree.

Copies: sizes of a source are rounded from the longest to the shortest, each passing on the words it
gave too few or too many, so a source misses its target by about its shortest document. Within a
size, documents with the smallest hash of doc_id get the odd copies; groups of many documents are
cut into buckets first. A decision then needs the small group table only, never the texts.

Sources are rows of a table as well: their order, their targets and their dual variables are computed
by joins and aggregates, so there may be as many as there are hosts. The driver sees sums over all
sources only. A source's sizes are rounded in one task: as many rows as it has different sizes.

Defined cases: an empty table gives no rows; null text has size 0 and is taken 0 words; a source without
words has target 0; rows that share a doc_id, source and size are taken alike; ``mixed`` keeps all
columns, and its own ``size`` and ``copy`` take the place of such columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import cut, join_sized, put_back, set_aside, stored

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Documents of one source and size that are ranked in one task.
BUCKET_ROWS = 512
ROUNDS = 60
#: The dual of sources of which every document is taken as often as allowed.
FULL = 1e300


def n_words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sid, source, words, full (documents with words) and shortest of every source, in code-point order."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("full"), F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).cast("long").alias("shortest"))
    # sorted by ranges; a row's number is its place in its task after the rows of the tasks before
    placed = by_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = stored(placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)), "sources")
    tasks = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("n"))
    before = tasks.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a task
    return placed.join(F.broadcast(before.drop("n")), "_task").select((F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("sid"), "source", "words", "full", "shortest")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """Add ``target``: sources share by weight, none gets more than ``most`` times its words.

    All targets are min(most * words, level * weight). The level is raised until they use up the total:
    each round, sources that are over are fixed and leave the rest to the others. Sums are of integers.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("_weight", weight)
    wanted = total * (rows.agg(F.sum("words")).first()[0] or 0)
    level, fixed = 0.0, -1
    while True:
        over = F.col("_weight") * F.lit(level) > most * F.col("words")
        capped, held, open_ = rows.agg(F.coalesce(F.sum(F.when(over, most * F.col("words"))), F.lit(0)), F.count_if(over), F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0))).first()
        if held == fixed or not open_:
            break
        fixed, level = held, (wanted - capped) / open_
    return rows.withColumn("target", F.when(over, most * F.col("words")).otherwise(F.col("_weight") * F.lit(level)).cast("double")).drop("_weight")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> list[float]:
    """Words wanted of each source of a short list, given their words in source order."""
    out, left, open_ = [0.0] * len(sizes), total * sum(sizes), set(range(len(sizes)))
    while open_:
        share = {k: left * weights[k % len(weights)] / sum(weights[j % len(weights)] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > most * sizes[k]}
        for k in over or open_:
            out[k] = most * sizes[k] if over else share[k]
        left -= sum(out[k] for k in over)
        open_ -= over or open_
    return out


def _exact_sum(value: F.Column) -> F.Column:
    """A sum of doubles that does not depend on their order: nine decimals, added as integers."""
    return F.sum(F.round(value * 1e9).cast("decimal(38,0)")).cast("double") / 1e9


def tilts(histogram: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """sid, lam and mean: the dual variable of each source (over size / mean size), ``FULL`` where all
    rates are ``most`` and null where nothing is wanted.

    ``histogram`` has sid, size (above 0) and n; ``sources`` sid, words, full, shortest and target. Each
    round is a join of the histogram with the duals that are still open, an aggregate for gradient and
    curvature, and a safeguarded Newton step for every source.
    """
    top = float(np.log(most))
    mean = F.col("words") / F.greatest(F.col("full"), F.lit(1))
    full = F.col("target") >= most * F.col("words") * (1 - 1e-12)
    open_ = sources.where((F.col("target") > 0) & ~full).select("sid", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("low"), (top * mean / F.col("shortest")).alias("high"))
    done = [sources.where(~((F.col("target") > 0) & ~full)).select("sid", F.when(F.col("target") > 0, FULL).alias("lam"), mean.alias("mean"))]
    open_ = cut(open_)
    for _ in range(ROUNDS):
        rows = open_.count()
        if not rows:
            break
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.col("lam") * x))
        bent = F.when(F.col("lam") * x < top, rate * x * x).otherwise(0.0)
        now = join_sized(histogram, open_.select("sid", "lam", "mean"), ["sid"], "inner", row_bytes=48, rows=rows)
        sums = now.groupBy("sid").agg(_exact_sum(F.col("n") * rate * x).alias("g"), _exact_sum(F.col("n") * bent).alias("h"))
        gap = F.col("g") - F.col("target") / F.col("mean")
        stepped = open_.join(sums, "sid").withColumn("gap", gap)
        stepped = stepped.withColumn("high", F.when(F.col("gap") > 0, F.least("high", "lam")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("gap") > 0, F.col("low")).otherwise(F.greatest("low", "lam")))
        step = F.col("lam") - F.col("gap") / F.when(F.col("h") > 0, F.col("h"))
        middle = F.when(F.col("low") > float("-inf"), (F.col("low") + F.col("high")) / 2).otherwise(F.least(2 * F.col("lam"), F.col("lam") - 1))
        met = F.abs(F.col("gap")) * F.col("mean") <= F.greatest(1e-7 * F.col("target"), F.lit(1e-3))
        stepped = cut(stepped.withColumn("met", met).withColumn("lam", F.when(met, F.col("lam")).otherwise(F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle))))
        done.append(stepped.where("met").select("sid", "lam", "mean"))
        open_ = stepped.where("not met").select("sid", "target", "mean", "lam", "low", "high")
    out = open_.select("sid", "lam", "mean")
    for part in done:
        out = out.unionByName(part)
    return cut(out)


def _round_source(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of each size of one source, from the longest, carrying what rounding left over."""
    pdf = pdf.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
        want = n * rate * size + carry
        k = int(min(max(np.floor(want / size + 0.5), 0), most * n))
        copies.append(k)
        carry = want - k * size
    return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "each": [k // n for k, n in zip(copies, pdf["n"])], "odd": [k % n for k, n in zip(copies, pdf["n"])], "buckets": -(-pdf["n"] // BUCKET_ROWS)})


def with_copies(rows: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """Add source_size, target and copies to ``rows``, which have doc_id, source and size.

    ``slim`` may hold the same three columns already stored; all statistics are taken over it.
    """
    spark = rows.sparkSession
    slim = stored(rows.select("doc_id", "source", "size"), "sizes") if slim is None else slim
    sources = cut(with_targets(ranked_sources(slim)))
    n_sources = sources.count()
    names = sources.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "sid", F.col("words").alias("source_size"), "target")

    def coded(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
        return join_sized(keyed, names, ["_none", "_source"], "inner", row_bytes=128, rows=n_sources).drop("_none", "_source")

    histogram = cut(coded(slim).where("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")))
    dual = tilts(histogram, sources)
    tilt = F.round(F.when(F.col("lam") >= FULL, F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(1.0))))), 12)
    rates = join_sized(histogram, dual, ["sid"], "inner", row_bytes=48, rows=n_sources).select("sid", "size", "n", F.when(F.col("lam").isNull(), 0.0).otherwise(tilt).alias("rate"))
    plan = cut(rates.groupBy("sid").applyInPandas(lambda pdf: _round_source(pdf, MOST), "sid long, size long, each int, odd long, buckets int"))

    def placed(df: DataFrame, groups: int) -> DataFrame:
        out = join_sized(coded(df), plan, ["sid", "size"], "left", row_bytes=48, rows=groups)
        return out.withColumn("_h", F.xxhash64("doc_id", F.lit(23))).withColumn("_bucket", F.pmod(F.col("_h"), F.coalesce("buckets", F.lit(1))).cast("int"))

    groups = plan.count()
    group = ["sid", "size", "_bucket"]
    drawn = placed(slim, groups).where("odd > 0")
    quota = drawn.groupBy(*group, "odd").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    quota = cut(quota.select(*group, F.least(F.col("n"), F.greatest(F.lit(0), F.col("odd") - F.col("before"))).alias("quota")).where("quota > 0"))
    ranked = join_sized(drawn.select(*group, "_h"), quota, group, "inner", row_bytes=40).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("_h")))
    last = cut(ranked.where(F.col("rank") == F.col("quota")).select(*group, F.col("_h").alias("last")))
    out = join_sized(placed(rows, groups), last, group, "left", row_bytes=40)
    copies = F.coalesce(F.col("each") + F.when(F.col("_h") <= F.col("last"), 1).otherwise(0), F.lit(0)).cast("int")
    return out.withColumn("copies", copies).drop("sid", "each", "odd", "buckets", "_h", "_bucket", "last")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` mixed: each row as often as it has copies, with ``copy`` numbered from 1 and ``size``.

    Columns ``size`` and ``copy`` that ``docs`` may have itself give way to these.
    """
    used, kept = ["doc_id", "source", "text"], [c for c in docs.columns if c not in ("size", "copy")]  # all others are set aside
    rows = with_copies(set_aside(docs.select(*kept), used).withColumn("size", n_words()))
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*put_back(kept, used), "size", "copy")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = stored(docs.select("doc_id", "source", n_words().alias("size")), "sizes")
    out = with_copies(slim, slim)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
