"""License scan: TF-IDF cosine to license templates, then inheritance from the nearest directory.

Built from DataFrame and SQL functions only.

1. ``idf`` of every template word is counted over all files; words of no template weigh as a word
   that no file has, so a text is compared with all of its words.
2. A text is compared as a whole (a licence file) and sentence by sentence (a header or notice), but
   only with the templates it is near: a text that reaches the threshold has so many of the template's
   heavy words (``_signs``), and so has the file around it. None is missed, and the texts of all other
   files are looked at once.
3. Line ends are then disregarded, as notices are wrapped and stand in comments: ``TEMPLATES`` and
   ``NOTICES`` are compared with every paragraph, every sentence of it and every run of as many words
   as the template has, and full licence texts (``texts``) with the whole text. Equal units of all files
   are compared once. The best score of steps 2 and 3 counts.
4. A file whose whole text matches, or whose name says licence and which has a matching sentence,
   licenses its directory. A file's licence is its own best match, or else that of its nearest
   ancestor directory which has one, found by joining the paths of all directories to their ancestors.

Words are lower-cased runs of a-z and 0-9; sentences end at line ends (in step 3 at blank lines, which
may hold comment marks) or at . ! ? and white space. Step 3 takes rows that share a path one by one.
There are full texts for the ids that have a file in ``licenses``.
Defined cases: an empty table gives no rows; rows that share a path are one file with the words of all; a null path is a file at
the root named ""; a null text matches nothing but inherits; equal scores go to the licence id that
sorts last; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from math import sqrt
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import cut, join_sized, put_back, set_aside, stored

THRESHOLD = 0.75

# SPDX ids and the sentences that usually declare them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Compared in step 3 only: notices and titles that differ from a template in the name or the version.
_NOTICE = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
NOTICES = [
    ("GPL-2.0", _NOTICE.format("program", "GNU General Public License", 2)),
    ("LGPL-3.0", _NOTICE.format("program", "GNU Lesser General Public License", 3)),
    ("AGPL-3.0", _NOTICE.format("program", "GNU Affero General Public License", 3)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
]

LICENCE_NAME = r"^(?i)(un)?(licen[cs]e|copying|copyright)([.-].*)?$"


def words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def bags(text: F.Column) -> F.Column:
    """The words of each sentence that has any. One pass rewrites the text, so that the rest are splits at single characters."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(lower, r"[.!?][ \t\r\n]+", "\n"), r"[^a-z0-9\n]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.split(x, " "))


def parts_of(text: F.Column, near: F.Column) -> F.Column:
    """whole and words of the text and of those of its sentences that are near one of the signs ``near``."""
    one = lambda whole, words: F.struct(F.lit(whole).alias("whole"), words.alias("words"))
    # the array around the bags binds them, so that they are computed once
    return F.flatten(F.transform(F.array(bags(text)), lambda b: F.concat(F.array(one(True, F.flatten(b))), F.transform(F.filter(b, lambda w: F.exists(near, lambda s: _reached(w, s))), lambda w: one(False, w)))))


def _weight(own: F.Column, sign: F.Column) -> F.Column:
    """Squared weight of the sign's words that are among ``own``."""
    return F.aggregate(F.zip_with(sign["heavy"], sign["squares"], lambda w, q: F.when(F.array_contains(own, w), q).otherwise(0.0)), F.lit(0.0), lambda a, q: a + q)


def _reached(own: F.Column, sign: F.Column) -> F.Column:
    """Whether words may reach the threshold: they have enough of the sign's heavy ones, by number and by weight."""
    return (F.size(F.array_intersect(own, sign["heavy"])) >= sign["least"]) & (_weight(own, sign) >= sign["enough"])


def _table(templates: list[tuple[str, str]], signs: dict) -> F.Column:
    """The signs as an array of structs, with the number of words of each template."""
    one = lambda k, heavy, squares, least, enough: F.struct(
        F.lit(k).alias("template"), F.lit(len(re.findall("[a-z0-9]+", templates[k][1].lower()))).alias("n"), _list(heavy).alias("heavy"),
        F.from_json(F.lit(str(squares)), "array<double>").alias("squares"), F.lit(least).alias("least"), F.lit(enough).alias("enough"),
    )
    return F.array(*[one(k, *sign) for k, sign in sorted(signs.items())])


@cache
def texts() -> tuple[tuple[str, str], ...]:
    """SPDX ids and full texts of licences."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licenses").glob("*.txt")))


def _values(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = ", ".join("({}, '{}', '{}')".format(k, *(x.replace("\\", "\\\\").replace("'", "\\'") for x in t)) for k, t in enumerate(templates))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, text)")


def _signs(weights: list, threshold: float) -> dict[int, tuple[list[str], list[float], int, float]]:
    """Heavy words of each template with their squared weights, and how many of them and how much of
    that weight any text has that reaches the threshold with it.

    The cosine is at most the norm of the template's weights on the words it shares with the text.
    """
    by_template: dict[int, list] = {}
    for row in weights:
        by_template.setdefault(row["template"], []).append((row["weight"] ** 2, row["word"]))
    need = threshold * threshold * (1 - 1e-9)
    out = {}
    for template, own in by_template.items():
        own.sort(reverse=True)
        total = sum(w for w, _ in own)
        heavy, rest = [], total
        while rest > total * need / 2:
            heavy.append(own[len(heavy)])
            rest = sum(w for w, _ in own[len(heavy) :])
        least, reached = 0, rest
        while reached < total * need:
            reached += heavy[least][0]
            least += 1
        out[template] = [word for _, word in heavy], [w for w, _ in heavy], least, total * need - rest
    return out


def _list(words: list[str]) -> F.Column:
    return F.split(F.lit(" ".join(words)), " ")


def _runs(words: F.Column, sign: F.Column) -> F.Column:
    """All runs of as many words as the template has that may reach the threshold."""
    n = sign["n"]
    run = lambda at: F.slice(words, at, n)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
    return F.transform(F.filter(starts, lambda at: _reached(run(at), sign)), run)


def _near(files: DataFrame, templates: list[tuple[str, str]], signs: dict) -> DataFrame:
    """path, text and ``near``, the templates of which a file has as many and as heavy words as a match needs.

    This is the only look at the texts of files that are near no template.
    """
    heaviest = _list(sorted({w for heavy, *_ in signs.values() for w in heavy}))
    # the array around the file's words binds them, so that they are computed once
    near = F.flatten(F.transform(F.array(F.array_intersect(words(F.col("text")), heaviest)), lambda own: F.transform(F.filter(_table(templates, signs), lambda s: _reached(own, s)), lambda s: s["template"])))
    return stored(files.select("path", "text", near.alias("near")).where(F.size("near") > 0), "near_licenses")


def unwrapped(close: DataFrame, templates: list[tuple[str, str]], n_texts: int, signs: dict, weights: DataFrame, norms: DataFrame, idf: DataFrame, rarest: F.Column, threshold: float) -> DataFrame:
    """Matches as of ``matches`` of units without regard to line ends; the last ``n_texts`` templates are full texts."""
    first = len(templates) - n_texts
    table = _table(templates, {k: sign for k, sign in signs.items() if k < first})
    plain = F.regexp_replace(F.lower("text"), r"(?m)^[^a-z0-9\n]*(?:rem|dnl)\b", " ")
    cut_at = lambda ends: F.transform(F.split(plain, ends), words)
    blank = r"\n[^a-z0-9\n]*(?=\n)"
    rows = close.select("path", "near", words(plain).alias("words"), F.array_distinct(F.concat(cut_at(blank), cut_at(blank + r"|[.!?][ \t\r\n]+"))).alias("pieces"))
    pairs = rows.select("path", "words", "pieces", F.explode(F.filter(table, lambda s: F.array_contains("near", s["template"]))).alias("sign"))
    sign = F.col("sign")
    pieces = F.filter("pieces", lambda x: _reached(x, sign))
    units = F.array_distinct(F.concat(pieces, _runs(F.col("words"), sign)))
    found = pairs.select("path", "sign.template", F.lit(False).alias("whole"), F.explode(units).alias("words"))
    entire = close.select("path", F.explode(F.filter("near", lambda k: k >= first)).alias("template"), F.lit(True).alias("whole"), words(F.col("text")).alias("words"))
    found = stored(found.unionByName(entire).withColumn("unit", F.sha2(F.array_join("words", " ").cast("binary"), 256)), "license_units")
    used = found.select("template", "unit", "words").dropDuplicates(["template", "unit"]).select("template", "unit", F.explode("words").alias("word")).groupBy("template", "unit", "word").agg(F.count(F.lit(1)).cast("double").alias("uses"))
    heavy = used.join(F.broadcast(idf), "word", "left").withColumn("weight", F.col("uses") * F.coalesce("idf", rarest)).drop("idf")
    heavy = heavy.join(F.broadcast(weights.select("template", "word", F.col("weight").alias("theirs"))), ["template", "word"], "left")
    sums = heavy.groupBy("template", "unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"), F.sum(F.col("weight") * F.col("theirs")).alias("dot"))
    licenses = F.broadcast(weights.select("template", "license").distinct().join(norms, "template"))
    scored = sums.join(licenses, "template").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).where(F.col("score") >= threshold)
    scored = cut(scored.select("template", "unit", "license", "score"))
    hits = join_sized(found.select("path", "whole", "template", "unit"), scored, ["template", "unit"], "inner", row_bytes=160)
    best = F.max(F.struct("score", "license"))
    return hits.groupBy("path").agg(best.alias("best"), F.max("whole").alias("whole")).select("path", "best", F.when(F.col("whole"), F.col("best")).alias("entire"))


def matches(files: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """path, license, score and whether the whole text matched, for every file with a match.

    What is broadcast are the words of the templates, a fixed table of a few thousand rows.
    """
    spark = files.sparkSession
    full = [*templates, *NOTICES, *texts()]
    known = _values(spark, full).select("template", "license", F.explode(words(F.col("text"))).alias("word"))
    use = cut(known.groupBy("template", "license", "word").agg(F.count(F.lit(1)).alias("uses")))
    held = F.broadcast(use.select("word").distinct())
    counted = files.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(held, "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = files.count()
    every = cut(use.select("word").distinct().join(F.broadcast(counted), "word", "left").select("word", (F.log(F.lit(total + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf")))
    rarest = F.log(F.lit(total + 1.0)) + 1.0
    heaviest = cut(use.join(F.broadcast(every), "word").select("template", "license", "word", (F.col("uses") * F.col("idf")).alias("weight")))
    norms = heaviest.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    signs = _signs(heaviest.collect(), threshold)
    close = _near(files, full, signs)
    # steps 1 and 2 know the words of ``templates`` only
    weights = heaviest.where(F.col("template") < len(templates))
    idf = cut(every.join(F.broadcast(weights.select("word").distinct()), "word"))

    own = F.filter(_table(full, {k: sign for k, sign in signs.items() if k < len(templates)}), lambda s: F.array_contains("near", s["template"]))
    declared = close.where(F.exists("near", lambda k: k < len(templates)))
    parts = declared.select("path", F.explode(parts_of(F.col("text"), own)).alias("found")).select("path", "found.whole", "found.words")
    # a sentence is told apart by its words in order; repeats of one scale its vector, which leaves the cosine as it is
    part = F.when(F.col("whole"), F.lit("")).otherwise(F.sha2(F.array_join("words", " ").cast("binary"), 256))
    parts = parts.select("path", "whole", part.alias("part"), F.explode("words").alias("word"))
    used = parts.groupBy("path", "whole", "part", "word").agg(F.count(F.lit(1)).cast("double").alias("uses"))
    heavy = used.join(F.broadcast(idf), "word", "left").withColumn("weight", F.col("uses") * F.coalesce("idf", rarest)).drop("idf")
    heavy = cut(heavy)
    sizes = heavy.groupBy("path", "whole", "part").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    held = F.broadcast(weights.withColumnRenamed("weight", "theirs").join(norms, "template"))
    dots = heavy.join(held, "word").groupBy("path", "whole", "part", "template", "license", "norm").agg(F.sum(F.col("weight") * F.col("theirs")).alias("dot"))
    scored = dots.join(sizes, ["path", "whole", "part"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).where(F.col("score") >= threshold)
    lined = scored.groupBy("path").agg(F.max(F.struct("score", "license")).alias("best"), F.max(F.when(F.col("whole"), F.struct("score", "license"))).alias("entire"))
    joined = unwrapped(close, full, len(texts()), signs, heaviest, norms, every, rarest, threshold)
    return lined.unionByName(joined).groupBy("path").agg(F.max("best").alias("best"), F.max("entire").alias("entire"))


def directory(path: F.Column) -> F.Column:
    """The part before the last slash; "" for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


RESULTS = ["license", "score", "origin", "from_dir"]


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """license, score, origin (own, inherited, none) and the directory inherited from, for every row
    of ``files`` (path, text); other columns stay, the text goes. Columns of ``files`` that are named
    like the results give way to them."""
    kept = [c for c in files.columns if c != "text" and c not in RESULTS]
    rows = set_aside(files.select(*[F.col(f"`{c}`") for c in files.columns if c not in RESULTS]), ["path", "text"]).withColumn("path", F.coalesce("path", F.lit("")))
    found = stored(matches(rows.select("path", "text"), threshold), "licenses")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    grants = found.select(directory(F.col("path")).alias("ancestor"), F.coalesce("entire", F.when(name.rlike(LICENCE_NAME), F.col("best"))).alias("best")).where("best is not null")
    grants = cut(grants.groupBy("ancestor").agg(F.max("best").alias("best")))
    places = rows.select(directory(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    # all directories have the root as an ancestor: such keys are salted
    near = join_sized(places.select("dir", F.explode(F.array_distinct(up)).alias("ancestor")), grants, ["ancestor"], "inner", row_bytes=160)
    near = cut(near.groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "best")).alias("near")))
    slim = rows.drop("text").withColumn("dir", directory(F.col("path")))
    own = found.select("path", "best")
    out = join_sized(join_sized(slim, own, ["path"], "left", row_bytes=128), near, ["dir"], "left", row_bytes=192)
    picked = F.coalesce(F.col("best"), F.col("near.best"))
    origin = F.when(F.col("best").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(*put_back(kept, ["path", "text"]), picked["license"].alias("license"), picked["score"].alias("score"), origin.alias("origin"), F.when(F.col("best").isNull(), F.col("near.ancestor")).alias("from_dir"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "license", F.round("score", 4).alias("score"), "origin", "from_dir")


def _sql_values() -> str:
    return ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(TEMPLATES))


OP7_SQL = rf"""
WITH templates(template, license, text) AS (VALUES {_sql_values()}),
tw AS (SELECT template, license, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM templates),
uses AS (SELECT template, license, word, count(*) AS uses FROM tw GROUP BY ALL),
files AS (SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
tokens AS (SELECT DISTINCT path, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) AS word FROM files),
df AS (SELECT word, count(*) AS df FROM tokens GROUP BY word),
n AS (SELECT count(*) AS n FROM files),
weights AS (SELECT template, license, word, uses * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS weight FROM uses LEFT JOIN df USING (word), n),
norms AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY template),
idf AS (SELECT DISTINCT u.word, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM uses u LEFT JOIN df USING (word), n),
parts AS (
  SELECT path, true AS whole, text AS part FROM files
  UNION ALL
  SELECT path, false, unnest(list_distinct(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)))) FROM files),
pw AS (SELECT path, whole, list_filter(string_split_regex(lower(part), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM parts),
near_parts AS (SELECT path, whole, sha256(array_to_string(w, ' ')) AS part, unnest(w) AS word FROM pw WHERE list_has_any(w, (SELECT list(DISTINCT word) FROM uses))),
used AS (SELECT path, whole, part, word, count(*) AS uses FROM near_parts GROUP BY ALL),
heavy AS (SELECT path, whole, part, word, uses * coalesce(idf, ln(n + 1.0) + 1.0) AS weight FROM used LEFT JOIN idf USING (word), n),
sizes AS (SELECT path, whole, part, sqrt(sum(weight * weight)) AS size FROM heavy GROUP BY ALL),
scored AS (SELECT path, whole, license, round(sum(h.weight * t.weight) / (any_value(norm) * any_value(size)), 6) AS score
  FROM heavy h JOIN weights t USING (word) JOIN norms USING (template) JOIN sizes USING (path, whole, part) GROUP BY path, whole, part, template, license),
best AS (SELECT path, max(struct_pack(score := score, license := license)) AS best, max(struct_pack(score := score, license := license)) FILTER (whole) AS entire FROM scored WHERE score >= {THRESHOLD} GROUP BY path),
grants AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, max(entire) AS best FROM best WHERE entire IS NOT NULL GROUP BY 1),
chain AS (SELECT f.doc_id, f.path, b.best, g2.best AS near, g2.dir AS near_dir, g1.best AS far, g1.dir AS far_dir
  FROM files f LEFT JOIN best b USING (path) LEFT JOIN grants g2 ON g2.dir = regexp_replace(f.path, '/[^/]*$', '') LEFT JOIN grants g1 ON g1.dir = split_part(f.path, '/', 1))
SELECT doc_id, path, coalesce(best, near, far).license AS license, round(coalesce(best, near, far).score, 4) AS score,
       CASE WHEN best IS NOT NULL THEN 'own' WHEN near IS NOT NULL OR far IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN best IS NULL THEN coalesce(near_dir, far_dir) END AS from_dir
FROM chain
"""
