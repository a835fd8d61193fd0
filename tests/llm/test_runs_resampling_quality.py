"""Periodic runs, importance resampling and quality rules against brute force and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from webstrata.llm import importance_resampling as resampling
from webstrata.llm import periodic_runs, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASHING = "n_words runs collapsed id rank score weight key lang_ _key _rest kept perplexity fold text_hash".split()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    some = "the quick brown fox jumps over the lazy dog near the river bank today"
    data = [(1, some, "en", "a"), (1, some, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, some, "en", "b"), (None, None, None, None), (4, "one two", "en", "b"), (5, " \n\n\t ", "en", "a"), (6, (some + "\n") * 40_000, "en", "a"), (1, "another text of the same id with some more words", "en", "a")]
    return spark.createDataFrame([(*d, *["x"] * len(CLASHING)) for d in data], f"doc_id long, text string, lang string, source string, {', '.join(f'{c} string' for c in CLASHING)}")


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(0, 70))]
        if len(w) > 10 and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randrange(1, 6)
            for i in range(a, min(len(w), a + p * rng.randrange(3, 9))):
                w[i] = w[a + (i - a) % p]
        assert list(zip(*[x.tolist() for x in periodic_runs.sequence_runs(np.array(w, np.int64))])) == brute_runs(w)


def test_runs_of_very_periodic_words_take_little_time():
    for words, want in ((np.zeros(300_000, np.int64), (0, 300_000, 1)), (np.arange(300_000) % 7, (0, 300_000, 7)), (np.arange(300_000) % 60_001, (0, 300_000, 60_001))):
        found = list(zip(*[x.tolist() for x in periodic_runs.sequence_runs(words)]))
        assert found == ([want] if want[1] >= 4 * want[2] else [])
    with pytest.raises(ValueError):
        periodic_runs.sequence_runs(np.zeros(9, np.int64), times=3)


def test_separators_part_texts():
    w = np.array([1, 1, 1, -1, 1, 1, 1, 1, 1, 1, -2, 1, 2, 1, 2, 1, 2, 1, 2, -3])
    assert [x.tolist() for x in periodic_runs.sequence_runs(w)] == [[4, 11], [6, 8], [1, 2]]


def test_op11_is_brute_force(spark, documents):
    def want(doc_id, text):
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        ids = {}
        runs = brute_runs([ids.setdefault(x, len(ids)) for x in w])
        drop = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        digests = ["".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(x for i, x in enumerate(w) if i not in drop)]
        return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, *[hashlib.sha256(d.encode()).hexdigest() for d in digests])

    got = {r.doc_id: tuple(r)[:8] for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    rows = [r for r in documents.collect() if len(r.text) < 6000]
    assert sum(got[r.doc_id][1] > 0 for r in rows) > 10
    assert all(got[r.doc_id] == want(r.doc_id, r.text) for r in rows)


def test_runs_of_odd_rows(odd):
    found = periodic_runs.find_runs(odd)
    assert set(found.columns) == set(odd.columns) - {"text"}
    rows = found.collect()
    assert len(rows) == odd.count() and {r.n_words for r in rows if r.doc_id in (2, 3, 5)} == {0}
    long = next(r for r in rows if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 14 * 40_000, 14)] and long.collapsed.count(" ") == 13
    assert next(r for r in rows if r.doc_id == 3).collapsed == ""
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0


def test_white_space_is_that_of_ascii_only(spark):
    text = " a\x0bb\x0cc\r\nd\x1ce\x85f\xa0g h "
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 4 and row.collapsed == " ".join(WORD.findall(text))


def test_resampling_is_sql(spark, oracle):
    got = resampling.op12_importance_resampling(spark, SF).toPandas()
    assert rows_of(got) == rows_of(oracle.execute(resampling.OP12_SQL).fetch_df())


def test_resampling_of_longer_features_is_brute_force(spark, documents):
    texts = {r.doc_id: ALNUM.findall(r.text.translate(LOWER)) for r in documents.where("doc_id < 60").collect()}
    items = [ALNUM.findall(r.text.translate(LOWER)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    buckets = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 500 for n in (1, 2) for i in range(len(w) - n + 1)]
    s, t = Counter(b for w in texts.values() for b in buckets(w)), Counter(b for w in items for b in buckets(w))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (t.total() + 500)))) for b in range(500)]
    want = {k: (len(buckets(w)), sum(gain[b] for b in buckets(w)) // max(1, len(buckets(w)))) for k, w in texts.items()}
    found = resampling.importance(documents.where("doc_id < 60"), spark.read.parquet(f"{SF}/benchmark.parquet"), ngrams=(1, 2), buckets=500)
    assert {r.doc_id: (r.n_features, r.weight) for r in found.collect()} == want


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([("the lazy dog",), (None,)], "text string")
    found = resampling.importance(odd, target, least_words=2, percent=50).collect()
    assert len(found) == odd.count() and sorted(r.rank for r in found if r.rank) == [1, 2, 3]
    assert all(r.weight == 0 for r in found if not r.n_features)
    drawn = resampling.resample(odd, target, least_words=2, percent=50)
    assert drawn.columns == odd.columns and 3 <= drawn.count() <= 4
    assert resampling.importance(odd.limit(0), target).count() == 0
    assert resampling.importance(odd, target.limit(0)).count() == odd.count()
    with pytest.raises(ValueError):
        resampling.importance(odd, target, buckets=1 << 17)


def test_many_rows_of_one_id_are_ranked_by_several_tasks(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("word " * 20).alias("text"))
    found = resampling.importance(rows, rows.limit(1))
    assert sorted(r["rank"] for r in found.where("rank is not null").collect()) == list(range(1, 301))


def brute_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_kneser_ney(texts, order=5):
    """log p of the last byte of an n-gram, by the usual recursion over dictionaries."""
    fold = lambda t: re.sub(rb" +", b" ", bytes(quality._FOLD[np.frombuffer(t.encode(), np.uint8)]))
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = b"\0" * (order - 1) + fold(t) + b"\0"
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    model = []
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [k - (k + 1) * y * b / a if a and n1 else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        context = defaultdict(list)
        for g, c in counts[n].items():
            context[g[:-1]].append(c)
        model.append((counts[n], [0, *[min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]], context))

    def p(g):
        if not g:
            return 1 / 256
        table, d, context = model[len(g) - 1]
        seen = context.get(g[:-1])
        if not seen:
            return p(g[1:])
        return (table[g] - d[min(table[g], 3)] + sum(d[min(c, 3)] for c in seen) * p(g[1:])) / sum(seen)

    return p, lambda t: [(b"\0" * (order - 1) + fold(t) + b"\0")[i : i + order] for i in range(len(fold(t)) + 1)]


def test_quality_counts_are_brute_force(spark, documents, odd):
    got = {r.doc_id: r for r in quality.op13_quality_rules(spark, SF).collect()}
    for r in documents.collect():
        g, want = got[r.doc_id], brute_counts(r.text)
        assert tuple(g[c] for c in quality.COUNTS) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    extra = ["a b c a b c\n\na b c\n a b c", "é* é* é*\né* é* é*\r\n#$%&|<>", "x x x x", "", "\n\n \n"]
    found = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.judged(spark.createDataFrame([(i, t, "en") for i, t in enumerate(extra)], "doc_id long, text string, lang string")).withColumnRenamed("id", "doc_id").collect()}
    assert found == {i: brute_counts(t) for i, t in enumerate(extra)}


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_perplexity_is_brute_force(spark, documents, monkeypatch, most):
    monkeypatch.setattr(quality, "MODEL_BYTES", most)
    docs = documents.where("doc_id < 70 and n_chars < 3000").withColumn("lang", F.when(F.col("lang") == "en", "en")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)))
    monkeypatch.setattr(quality, "LEAST_DOCS", 5)
    rows = docs.collect()
    got = {r.id: r for r in quality.judged(docs).collect()}
    for lang in ("en", None):
        for fold in (0, 1):
            p, grams = brute_kneser_ney([r.text for r in rows if r.lang == lang and r.fold != fold])
            for r in [r for r in rows if r.lang == lang and r.fold == fold][:4]:
                nats = -sum(math.log(p(g)) for g in grams(r.text)) / len(WORD.findall(r.text))
                assert math.log(got[r.doc_id].perplexity) == pytest.approx(nats, rel=1e-5)
    context = b"the "
    p, _ = brute_kneser_ney([r.text for r in rows if r.lang == "en" and r.fold == 0])
    assert sum(p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_rejects_what_is_odd_for_its_language(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    rows = quality.judged(docs).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5


def test_quality_of_odd_rows(odd):
    rows = quality.judged(odd).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows)
    assert next(r for r in rows if r.id == 6).n_repeat_words == 14 * 40_000
    assert quality.accepted(odd).columns == odd.columns and quality.accepted(odd).count() == 0
    assert quality.judged(odd.limit(0)).count() == 0


def test_texts_without_words_beside_a_band(spark, documents, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_DOCS", 5)
    blank = spark.createDataFrame([(-1, "", "en"), (-2, None, "en"), (-3, " \n\t", "en")], "doc_id long, text string, lang string")
    rows = {r.id: r for r in quality.judged(documents.select(*blank.columns).union(blank)).collect()}
    assert len(rows) == documents.count() + 3 and any(r.lower is not None for r in rows.values())
    assert all(tuple(rows[k])[1:] == (0, 0, 0, 0, 0, True, False, None, None, None, "en") for k in (-1, -2, -3))


def test_only_rare_ngrams_leave_the_tasks(spark, documents, monkeypatch):
    docs = documents.unionByName(documents.where("doc_id < 20"))
    want = sorted(tuple(r) for r in quality.judged(docs).collect())
    written = []

    def noting(df, name, keep=quality.stored):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(quality, "stored", noting)
    monkeypatch.setattr(quality, "MODEL_BYTES", quality.ENTRY * 20_000)
    got = sorted(tuple(r) for r in quality.judged(docs).collect())
    model = max(n for name, n in written if name == "probabilities")
    assert model > 40_000 and max(n for name, n in written if name not in ("ngrams", "probabilities")) < 2 * model
    for a, b in zip(got, want, strict=True):
        assert a[:8] == b[:8] and a[8] == pytest.approx(b[8], rel=1e-6)


def test_lookup_tells_what_the_model_lacks():
    keys = np.arange(0, 3000, 3)
    model = quality.Model.of(keys, np.stack([-keys - 1.0, keys + 1.0]).astype(np.float32))
    at = model.find(np.arange(3000))
    assert (at == model.last).tolist() == [k % 3 > 0 for k in range(3000)]
    assert model.logs[1, at].tolist() == [0 if k % 3 else k + 1 for k in range(3000)]
    assert quality.Model.of(keys[:0], np.zeros((2, 0), np.float32)).find(keys).max() == 0
