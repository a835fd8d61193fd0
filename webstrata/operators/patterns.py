"""Many shell patterns against many URLs, without comparing each with each.

A pattern's literal stretches are cut into runs of ``GRAM`` characters; every URL that the pattern matches has
all of them. Each pattern is joined to the URLs by the one of its runs that the fewest URLs have, and
only those pairs are compared. Patterns without such a run are joined by an empty one, which all URLs have.
"""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from webstrata.plans.runtime import cut

GRAM = 3
#: URLs with one run of characters that one task compares with the patterns that have it.
SALT_ROWS = 100_000


@F.pandas_udf(T.StringType())
def as_regex(pattern: pd.Series) -> pd.Series:
    """A shell pattern as a regular expression over whole texts, as Java writes it."""
    return pattern.map(lambda p: None if p is None else r"\A" + fnmatch.translate(p).removesuffix(r"\Z").removesuffix(r"\z") + r"\z")


def _runs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda k: F.substring(text, k, F.lit(GRAM)))


def literal_runs(pattern: Column) -> Column:
    """The runs of a pattern's literal stretches; one empty run if there is none."""
    pieces = F.split(F.regexp_replace(pattern, r"\[[!^]?\]?[^\]]*\]|[*?]", "\n"), "\n")
    found = F.array_distinct(F.flatten(F.transform(F.filter(pieces, lambda p: F.length(p) >= GRAM), _runs)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def pattern_join(rows: DataFrame, patterns: DataFrame, url: str = "net_url", pattern: str = "pattern") -> DataFrame:
    """``rows`` with each ``pattern`` that its whole URL is like; other columns of ``patterns`` are left out.

    Equal URLs are compared once, equal patterns too. Null URLs and patterns match nothing. Wildcards are
    ``*``, ``?`` and ``[...]``; case counts.
    """
    addresses = cut(rows.select(F.col(url).alias("_url")).where("_url is not null").distinct())
    every = addresses.select("_url", F.explode(F.concat(F.array(F.lit("")), F.when(F.length("_url") >= GRAM, F.array_distinct(_runs(F.col("_url")))).otherwise(F.array().cast("array<string>")))).alias("_run"))
    asked = patterns.select(F.col(pattern).alias("_pattern")).where("_pattern is not null").distinct()
    asked = cut(asked.select("_pattern", as_regex("_pattern").alias("_regex"), F.explode(literal_runs(F.col("_pattern"))).alias("_run")))
    often = every.join(asked.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    # a run that no URL has is taken too: then nothing is like the pattern
    rarest = asked.join(often, "_run", "left").groupBy("_pattern", "_regex").agg(F.min_by(F.struct("_run", F.coalesce("_n", F.lit(0)).alias("_n")), F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_r"))
    rarest = cut(rarest.select("_pattern", "_regex", "_r.*").where("_n > 0"))
    salts = F.ceil(F.col("_n") / SALT_ROWS).cast("int")
    hot = rarest.where(F.col("_n") > SALT_ROWS).select("_run", salts.alias("_salts")).distinct()
    left = every.join(hot, "_run", "left").withColumn("_salt", F.pmod(F.xxhash64("_url"), F.coalesce("_salts", F.lit(1))).cast("int"))
    right = rarest.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    pairs = left.join(right, ["_run", "_salt"]).where(F.rlike(F.col("_url"), F.col("_regex"))).select("_url", "_pattern")
    return rows.join(pairs, F.col(url) == F.col("_url")).select(*rows.columns, F.col("_pattern").alias(pattern))
