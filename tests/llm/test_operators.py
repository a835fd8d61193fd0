"""The training-data operators against SQL, brute force and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from webstrata.llm import decontamination, fingerprints, html_extract, kernels, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, queries, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASHING = "key gone row node _node _row _rest size copies sid target host band peer".split()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted(documents.collect(), key=lambda r: r.doc_id)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    some = "the quick brown fox jumps over the lazy dog near the river bank today"
    data = [(1, some, "en", "a"), (1, some, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, some, "en", "b"), (None, None, None, None), (4, "one two", "en", "b"), (5, " \n\n\t ", "en", "a"), (6, (some + "\n") * 4000, "en", "a"), (1, "another text of the same id with some more words", "en", "a")]
    return spark.createDataFrame([(*d, len(d[1] or ""), *["x"] * len(CLASHING)) for d in data], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in CLASHING)}")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, oracle, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(oracle.execute(queries.oracle_sql()[name]).fetch_df())


def test_odd_rows(spark, odd):
    n = odd.count()
    benchmark = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, "")], "item_id long, text string")
    found = decontamination.scan(odd, benchmark).collect()
    assert len(found) == n and {r.doc_id for r in found if r.contaminated} == {1, 6, None}
    assert decontamination.clean(odd, benchmark).columns == odd.columns
    assert sorted(decontamination.clean(odd, benchmark).select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 1, 2, 3, 4, 5]
    assert fingerprints.compare_neighbours(odd).count() == n
    gone = line_dedup.deduplicated(odd)
    assert gone.columns == odd.columns and gone.count() == n
    assert {r.doc_id for r in gone.where("text is null").collect()} == {2, None}
    assert language_id.accepted(odd).columns == odd.columns
    assert language_id.identify(language_id.document_rows(odd)).count() == n
    mix = mixing.mixed(odd)
    assert set(mix.columns) == set(odd.columns) | {"copy"}
    assert mix.where("text is null or trim(text) = ''").count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 2 and kept.where("text is null or text = ''").count() == 1


def test_odd_rows_in_language_models_and_license_scans(spark, odd):
    n = odd.count()
    scored = {r.doc_id: r for r in lm_scoring.scores(odd).collect()}
    assert scored[2].n_tokens == 1 and math.isfinite(scored[6].score)
    files = odd.select("doc_id", "text", *CLASHING).withColumnRenamed("key", "path")
    assert license_scan.scan(files).count() == n
    assert license_scan.scan(files).columns == [c for c in files.columns if c != "text"] + license_scan.RESULTS


_ITEM = "item_id long, text string"
EMPTY = {
    "fingerprints": fingerprints.compare_neighbours, "line_dedup": line_dedup.deduplicated, "language_id": language_id.accepted, "mixing": mixing.mixed, "ngram_join": ngram_join.one_of_each,
    "similar_documents": ngram_join.similar_documents, "lm_scoring": lm_scoring.scores, "license_scan": lambda d: license_scan.scan(d.withColumnRenamed("key", "path")),
    "decontamination": lambda d: decontamination.clean(d, d.sparkSession.createDataFrame([(1, "quick brown fox")], _ITEM)),
    "html_extract": lambda d: html_extract.extract(d.selectExpr("doc_id as page_id", "source as url", "text as html")),
    "warc": lambda d: warc.deduplicated(d.selectExpr("doc_id as page_id", "source as url", "text as html")),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables(odd, name):
    assert EMPTY[name](odd.limit(0)).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "gamma beta alpha"), (3, "alpha beta gamma"), (4, "alpha beta and a long way to gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    found = {r.doc_id: (r["items"], r.near) for r in decontamination.find(decontamination.build_index(docs), items, slop=2).collect()}
    assert found == {1: ([], ["7"]), 2: ([], ["7"]), 3: (["7"], ["7"]), 4: ([], [])}


def test_proximity_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(12)]
    docs = [(k, " ".join(rng.choices(pool, k=rng.randrange(0, 40)))) for k in range(80)]
    items = [(k, " ".join(rng.choices(pool, k=rng.randrange(1, 6)))) for k in range(15)]
    often = Counter(w for _, t in docs for w in t.split())
    found = decontamination.find(decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), window=3, slop=2).collect()
    for r in found:
        d = dict(docs)[r.doc_id].split()
        want = set()
        for item, text in items:
            w = text.split()
            for at in range(max(1, len(w) - 2)):
                win = w[at : at + 3]
                rarest = min(range(len(win)), key=lambda k: (often[win[k]], k))
                reach = len(win) - 1 + 2
                if any(x == win[rarest] and set(win) <= set(d[max(0, i - reach) : i + reach + 1]) for i, x in enumerate(d)):
                    want.add(str(item))
        assert r.near == sorted(want)


def test_repeated_nameless_and_very_long_items(spark, monkeypatch):
    long = " ".join(f"v{k}" for k in range(300))
    docs = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, "x " + " ".join(f"v{k}" for k in range(37, 60))), (3, "lazy dog")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox"), (7, "quick brown fox"), (7, "brown fox"), (None, "lazy dog"), (8, long)], "item_id long, text string")
    for most in (200_000, 104):
        monkeypatch.setattr(decontamination, "WORDS_PER_PASS", most)
        found = sorted((r.doc_id, r["items"], r.n_hit) for r in decontamination.scan(docs, items).collect())
        assert found == [(1, ["7"], 3), (1, ["7"], 3), (2, ["8"], 23), (3, [], 2)]
    assert decontamination.scan(docs, items.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_a_large_benchmark_in_passes_finds_the_same(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = decontamination.build_index(documents)
    whole = {r.doc_id: (r["items"], r.n_hit) for r in decontamination.find(index, items, slop=-1).withColumn("n_hit", decontamination.covered_words()).collect()}
    monkeypatch.setattr(decontamination, "WORDS_PER_PASS", 400)
    parts = {r.doc_id: (r["items"], r.n_hit) for r in decontamination.find(index, items, slop=-1).withColumn("n_hit", decontamination.covered_words()).collect()}
    assert parts == whole


def test_passes_tell_rows_of_one_id_apart(spark, monkeypatch):
    data = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta epsilon zeta"), (None, "alpha beta gamma"), (None, "no hit here"), (None, None), (2, "delta epsilon zeta")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, "delta epsilon zeta"), (9, "other words only")], "item_id long, text string")
    index = decontamination.build_index(docs)
    judged = lambda: sorted(((r.doc_id, r.n_words, r["items"], r.n_hit) for r in decontamination.find(index, items, slop=-1).withColumn("n_hit", decontamination.covered_words()).collect()), key=repr)
    whole = judged()
    monkeypatch.setattr(decontamination, "WORDS_PER_PASS", 3)
    assert judged() == whole
    hits = {"alpha beta gamma": ["7"], "delta epsilon zeta": ["8"]}
    assert whole == sorted(((d, len(words(t)), hits.get(t, []), 3 if t in hits else 0) for d, t in data), key=repr)


def test_fingerprints(spark, rows):
    found = {r.doc_id: r for r in queries.queries()["op2_fingerprints"](spark, SF).collect()}
    assert len(found) == len(rows)
    off = []
    for row, after in zip(rows, rows[1:] + rows[:1]):
        text, other = row.text or "", after.text or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        r = found[row.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, got in ((text, edited, r.near_edited), (text, other, r.near_next)):
            a, b = shingles(a), shingles(b)
            off.append(got - (len(a & b) / len(a | b) if a | b else 1.0))
        assert (edited == text) <= (r.fingerprint == r.edited_fingerprint)
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.2
    by_text = {}
    for row in rows:
        assert by_text.setdefault(row.text or "", found[row.doc_id].fingerprint) == found[row.doc_id].fingerprint


def test_alignment():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_line_dedup(spark):
    block = "this common passage has many words in it\nand goes on for a second line of words"
    docs = spark.createDataFrame([(1, f"first head of its own\n{block}\nfirst tail"), (2, f"second head of its own\n{block}\nsecond tail"), (3, "short one\nfirst tail"), (4, "a single line with words that no other has")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    assert found[2] == "second head of its own\nsecond tail"
    assert all(found[r.doc_id] == r.text for r in docs.collect() if r.doc_id != 2)


def test_line_dedup_finds_blocks_of_short_lines(spark):
    lines = [f"some short words number{k} x{k}" for k in range(12)]
    small = [f"tiny line{k} is" for k in range(9)]
    chinese = "这是一个没有空格的很长的句子用来测试重复文本的删除"
    data = [(k, f"own head of document {k}\n{lines[k]}\nown tail of document {k}") for k in range(12)]
    blocks = "\n".join(lines), "\n\n".join(small), chinese
    data += [(20, "\n".join(["only in twenty", *blocks])), (21, "\n".join(["only in twenty-one", *blocks[::-1], "end of it"]))]
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [x for x in found[21].split("\n") if x] == ["only in twenty-one", "end of it"]
    assert all(found[k] == text for k, text in data if k != 21)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(f"w{k}{i}" for i in range(rng.choice([1, 2, 4, 6, 9]))) for k in range(25)]
    docs = [[pool[(a + i) % 25] for a in (rng.randrange(25) for _ in range(3)) for i in range(rng.randrange(1, 6))] for _ in range(60)]
    data = [(k, "\n".join(lines)) for k, lines in enumerate(docs)]
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    seen = set()
    for k, lines in enumerate(docs):
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if len(" ".join(lines[a:b]).split()) >= line_dedup.BLOCK_WORDS]
        gone = {i for a, b in runs if tuple(lines[a:b]) in seen for i in range(a, b)}
        assert found[k] == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        seen.update(tuple(lines[a:b]) for a, b in runs)


def test_line_dedup_leaves_no_long_repeat(spark, rows):
    got = {r.doc_id: r for r in queries.queries()["op3_line_dedup"](spark, SF).collect()}
    seen, gone = set(), 0
    for row in rows:
        mine = [x.translate(LOWER) for x in (row.text or "").split("\n") if len(x.split()) >= line_dedup.BLOCK_WORDS]
        left = [x.translate(LOWER) for x in (got[row.doc_id].text or "").split("\n") if len(x.split()) >= line_dedup.BLOCK_WORDS]
        kept, fresh = Counter(left), Counter(x for x in mine if x not in seen)
        assert all(kept[x] >= 1 for x in fresh)  # what no earlier document has stays
        gone += len(mine) - len(left)
        seen.update(mine)
    assert gone > 0


def test_html(spark):
    nav = '<div class="x1"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></div>'
    page = lambda k: f"<html><head><title>T{k}</title></head><body>{nav}<article><h1>Story {k}</h1><p>Fish &amp; chips\n no. {k}</p><p>End<br>of it</p></article><div class='comments'><p>Nice!</p></div><script>x()</script></body></html>"
    data = [(k, f"https://a.example/{k}", page(k)) for k in range(6)] + [(10, None, None), (11, "nonsense", ""), (12, "https://b.example/", "<p>Only <b>this</b></p><p>and that")]
    found = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert found[k][0] == f"Story {k}\nFish & chips no. {k}\nEnd of it"
    assert found[10] == ("", 0) and found[11] == ("", 0) and found[12][0] == "Only this\nand that"


def test_site_template_goes_without_names(spark):
    frame = lambda k: f"<html><body><div><p>Welcome to our site, read on</p></div><div><p>Words of page {k} and more</p></div><div><p>All rights kept</p></div></body></html>"
    pages = spark.createDataFrame([(k, f"https://t.example/{k}", frame(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {k: f"Words of page {k} and more" for k in range(8)}


def test_article_text_with_telling_names_stays():
    inner = "<h2 id='social-policy'>Social policy</h2><p id='related-work'>Related work is long.</p><p class='ad-hoc'>An ad-hoc rule</p><section id='social-history'><p title='The hidden valley'>History</p></section><h2 id='comments'>On comments</h2><p class='notice'>Take notice</p><p><math><mi>x</mi>=2</math></p>"
    want = "Social policy\nRelated work is long.\nAn ad-hoc rule\nHistory\nOn comments\nTake notice\nx=2"
    for page in (f"<body><nav>Menu</nav><article>{inner}</article><div class='site-nav related-posts'>More</div></body>", f"<div class='layout with-sidebar'>{inner}</div><div class='cookie-banner'>Take them</div>", f"<form action='/'>{inner}<div class='comment-list'><p>First!</p></div></form>"):
        assert html_extract.Page(page).main_text()[0] == want


def test_recurring_subtrees_decide(spark):
    """The menu of a site names no role and has other links on every page; what recurs is counted by brute force."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdef", k=5))
    story = [[" ".join(word() for _ in range(30)) for _ in range(3)] for _ in range(60)]
    note = "<div class='x7'><p>The same lines stand on all pages of it</p></div>"
    page = lambda k: f"<body><div class='x1'>{''.join(f'<a href=/{word()}>{word()}</a> ' for _ in range(5))}</div><div class='x2'><h1>Title {k}</h1>{note if k % 2 else ''}{''.join(f'<p>{p}</p>' for p in story[k])}</div></body>"
    data = [(k, f"https://{'big' if k < 50 else f'small{k}'}.example/{k}", page(k)) for k in range(60)] + [(100 + k, f"https://copies.example/{k}", page(3)) for k in range(9)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    read = {k: html_extract.Page(html) for k, _, html in data}
    holders = {}
    for k, url, _ in data:
        for h in {h for e in read[k].elements for h in read[k].hashes(e)}:
            holders.setdefault((url.split("/")[2], h), set()).add(read[k].signature())
    often = {key for key, held in holders.items() if len(held) >= html_extract.LEAST_PAGES}
    assert {(r.host, r.hash) for r in html_extract.templates(pages).collect()} == often
    ways = [{r.page_id: r for r in html_extract.extract(pages, limit).collect()} for limit in (1 << 20, 0)]
    assert ways[0] == ways[1]
    for k, r in ways[0].items():
        if k < 50:
            assert r.template_chars > 0 and r.text.split("\n") == [f"Title {k}", *story[k]]
        else:
            assert r.template_chars == 0 and story[3 if k >= 100 else k] == r.text.split("\n")[-3:]


def test_templates_have_a_share_in_the_test_pages(spark):
    got = queries.queries()["op4_html_extract"](spark, "/root/testdata/sf0.01").toPandas()
    assert (got["template_chars"] > 0).mean() > 0.5


def test_long_pages_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        source = "<body>" + "".join(f"<article><ul><li><a href='/{k}'>link {k}</a></li></ul><p>text {k}</p></article>" for k in range(n))
        began = time.process_time()
        html_extract.Page(source).main_text()
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_language_on_labels_that_the_model_cannot_see(documents):
    """A third of the rows lose their declaration: it neither trains the model nor enters their score."""
    rows = language_id.document_rows(documents).withColumn("label", F.col("declared"))
    hidden = F.pmod(F.xxhash64("row"), F.lit(3)) == 0
    found = language_id.identify(rows.withColumn("declared", F.when(~hidden, F.col("declared")))).where(hidden & F.col("label").isNotNull()).toPandas()
    kept = found[~found["rejected"]]
    assert len(kept) > 0.9 * len(found) and (kept["label"] == kept["language"]).mean() > 0.95


def test_a_language_of_few_rows_and_tiles(spark, documents, monkeypatch):
    """More languages than a tile holds, and one that five rows declare: all are candidates."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("ξψωφχθδγ", k=rng.randrange(2, 7)))
    data = [(10**6 + k, " ".join(word() for _ in range(200)), "el" if k < 5 else None, "web", 0) for k in range(12)]
    rows = language_id.document_rows(documents.unionByName(spark.createDataFrame(data, documents.schema)))
    wide = {r.doc_id: (r.language, round(r.posterior, 9)) for r in language_id.identify(rows).collect()}
    assert all(wide[10**6 + k][0] == "el" for k in range(12))
    monkeypatch.setattr(language_id, "TILE", 2)
    assert {r.doc_id: (r.language, round(r.posterior, 9)) for r in language_id.identify(rows).collect()} == wide


def test_fusion_against_brute_force(spark):
    data = [(1, "en", "a.de", "de"), (2, "en", "a.de", "de"), (3, None, "b.de", "de"), (4, "fr", "b.fr", "fr"), (5, None, None, None), (6, "fr", "a.de", "de")]
    texts = ["the old house of the king", "the end of the long day", "la fin de la grande maison", "le roi de la vieille maison", "the king of the day", "la maison du roi de la fin"]
    rows = spark.createDataFrame([(i, str(i).encode(), d, h, x, t) for (i, d, h, x), t in zip(data, texts)], "doc_id long, row binary, declared string, host string, suffix string, text string")
    model = language_id.fit(rows)
    score = {r.doc_id: r for r in language_id.scored(rows, model).collect()}
    n, prior = len(model.languages), language_id.PRIOR_ROWS
    votes = lambda test: [sum(score[i].vote == k for i, *rest in data if test(*rest)) for k in range(n)]
    everywhere = [1 + v for v in votes(lambda d, h, x: True)]
    mix = lambda a, b: [x + prior * y / sum(b) for x, y in zip(a, b)]
    found = {r.doc_id: r for r in language_id.identify(rows, model).collect()}
    for i, d, h, x in data:
        own = [float(score[i].vote == k) for k in range(n)]
        less = lambda v: [a - b for a, b in zip(v, own)]
        p = mix(less(votes(lambda d2, h2, x2: (h2, x2) == (h, x))), mix(less(votes(lambda d2, h2, x2: x2 == x)), everywhere))
        said = [math.log((v + 0.5) / (e + 1)) for v, e in zip(votes(lambda d2, h2, x2: d2 == d), everywhere)]
        flat = -math.log(language_id.GRAMS) * score[i].grams
        logs = [math.log(a / sum(p)) + b + language_id.TEMPER * (c - flat) for a, b, c in zip(p, said, score[i].likelihoods)] + [math.log(language_id.UNKNOWN)]
        top = max(range(n + 1), key=logs.__getitem__)
        assert found[i].language == [*model.languages, "und"][top]
        assert math.isclose(found[i].posterior, 1 / sum(math.exp(v - logs[top]) for v in logs), rel_tol=1e-6)


def test_letters_written_as_references_count(spark):
    page = "<html lang=fr><body>" + "".join(f"&#{ord(c)};" if c != " " else " " for c in "le roi de la vieille maison " * 20)
    rows = language_id.page_rows(spark.createDataFrame([(1, "http://a.fr/", page)], "page_id long, url string, html string"))
    assert rows.first().text.split() == ("le roi de la vieille maison " * 20).split()


def test_gibberish_is_rejected(spark, documents):
    rng = random.Random(9)
    noise = [(10**6 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(300)), "en", "web", 0) for k in range(3)]
    noise.append((10**6 + 3, "0123 4567 --- 89", "en", "web", 0))
    kept = {r.doc_id for r in language_id.accepted(documents.unionByName(spark.createDataFrame(noise, documents.schema))).select("doc_id").collect()}
    assert not kept & {r[0] for r in noise} and len(kept) > 0.95 * documents.count()


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([0, 10]) == [0.0, 15.0]


def test_mixing(spark, rows):
    query = queries.queries()["op6_mixing"]
    found = {r.doc_id: r for r in query(spark, SF).collect()}
    assert found == {r.doc_id: r for r in query(spark, SF).collect()}
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [r.doc_id for r in rows if r.source == s] for s in sources}
    goals = mixing.targets([sum(sizes[d] for d in of[s]) for s in sources])
    for s, goal in zip(sources, goals):
        taken = sum(found[d].taken for d in of[s])
        assert abs(taken - goal) <= max(0.01 * goal, max(sizes[d] for d in of[s]))
        assert all(found[d].size == sizes[d] and math.isclose(found[d].target, goal) and found[d].taken in (0, sizes[d], 2 * sizes[d]) for d in of[s])


def test_many_sources_are_a_table(spark, monkeypatch):
    """Targets and ranks of more sources than any bound on broadcasts here, against the short form."""
    rng = random.Random(6)
    data = [(k, f"s{rng.randrange(200):03d}" if k % 50 else None, rng.randrange(0, 60)) for k in range(3000)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, size long")
    monkeypatch.setattr("webstrata.llm.common.BROADCAST_BYTES", 0)
    found = {(r.sid, r.source): r for r in mixing.with_targets(mixing.ranked_sources(sizes)).collect()}
    names = sorted({s for _, s, _ in data if s is not None}) + [None]
    words = [sum(n for _, s, n in data if s == name) for name in names]
    assert sorted(found, key=lambda k: k[0]) == list(enumerate(names))
    for (sid, _), r in found.items():
        assert r.words == words[sid] and math.isclose(r.target, mixing.targets(words)[sid], rel_tol=1e-12)
    taken = Counter()
    for r in mixing.with_copies(sizes).collect():
        taken[r.source] += r["size"] * r.copies
        assert 0 <= r.copies <= 2
    for name, goal in zip(names, mixing.targets(words)):
        assert abs(taken[name] - goal) <= 60


def test_tilts_meet_the_constraint(spark):
    histogram = spark.createDataFrame([(0, 5, 10), (0, 50, 3), (1, 7, 4), (2, 3, 5), (3, 9, 1)], "sid long, size long, n long")
    sources = spark.createDataFrame([(0, 200, 13, 5, 260.0), (1, 28, 4, 7, 9.0), (2, 15, 5, 3, 30.0), (3, 9, 1, 9, 0.0)], "sid long, words long, full long, shortest long, target double")
    dual = {r.sid: r for r in mixing.tilts(histogram, sources).collect()}
    rate = lambda k, size: min(2.0, math.exp(dual[k].lam * size / dual[k].mean))
    assert math.isclose(10 * 5 * rate(0, 5) + 3 * 50 * rate(0, 50), 260, rel_tol=1e-5)
    assert math.isclose(28 * rate(1, 7), 9, rel_tol=1e-3)
    assert dual[2].lam == mixing.FULL and dual[3].lam is None


def test_license_inheritance(spark):
    mit = license_scan.TEMPLATES[3][1]
    files = spark.createDataFrame([("p/LICENSE", f"Copyright some body\n{mit}"), ("p/src/a.c", "int main"), ("p/src/b.c", "Licensed under CC BY 4.0.\n" + " ".join(f"int x{k} = {k};" for k in range(40))), ("q/c.c", None), (None, "x")], "path string, text string")
    found = {r.path: (r.license, r.origin, r.from_dir) for r in license_scan.scan(files).collect()}
    assert found["p/LICENSE"][:2] == ("MIT", "own") and found["p/src/a.c"] == ("MIT", "inherited", "p")
    assert found["p/src/b.c"][:2] == ("CC-BY-4.0", "own") and found["q/c.c"] == (None, "none", None)


def test_wrapped_notices_and_license_files(spark):
    import textwrap

    code = "\n".join(f"int x{k} = {k};" for k in range(60))
    wrap = lambda k, mark: "\n".join(mark + x for x in textwrap.wrap(license_scan.TEMPLATES[k][1], 60))
    affero = "\n".join(" * " + x for x in textwrap.wrap(license_scan.NOTICES[2][1], 60))
    data = [(f"w/{k}.c", f"/* a file */\n{wrap(k, mark)}\n\n{code}") for k, mark in ((3, " * "), (5, "// "), (11, "# "), (12, "dnl "))]
    data += [("w/affero.c", f"/*\n{affero}\n */\n{code}"), ("w/none.c", code)]
    data += [(f"{name}/COPYING", f"Copyright (c) 2020 Some Body\n\n{text}") for name, text in license_scan.texts()] + [(f"{name}/a.c", code) for name, _ in license_scan.texts()]
    found = {r.path: (r.license, r.origin) for r in license_scan.scan(spark.createDataFrame(data, "path string, text string")).collect()}
    for k, name in ((3, "MIT"), (5, "GPL-3.0"), (11, "BSD-3-Clause"), (12, "ISC")):
        assert found[f"w/{k}.c"] == (name, "own")
    assert found["w/affero.c"] == ("AGPL-3.0", "own") and found["w/none.c"] == (None, "none")
    for name, _ in license_scan.texts():
        assert found[f"{name}/COPYING"] == (name, "own") and found[f"{name}/a.c"] == (name, "inherited")


def test_language_model(spark, rows):
    found = {r.doc_id: r for r in queries.queries()["op8_lm_scoring"](spark, SF).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)), None] for r in rows}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for d, ts in tokens.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ts), sum(t in counts for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
    kept = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept) and all(r.score <= 0 for r in kept)


def word_model(texts, lex, weights):
    """A function that scores texts by brute force, token by token, as the docstring of lm_scoring says."""
    M, no_words = lm_scoring, [r"[^\x20\x09-\x0D]+"]
    cut = lambda t: re.findall(no_words[0], (t or "").translate(LOWER))
    docs = [cut(t) for t in texts]
    counts = Counter(t for d in docs for t in d)
    top = {t for t, _ in sorted(counts.items(), key=lambda x: -x[1])[: M.TOP]}

    def kind(t):
        import pyarrow as pa

        return int(M.TOP + M._shapes(next(kernels.words(pa.array([t]), kernels.SOLID)))[0])

    kinds = {t: kind(t) for t in counts}
    words, tokens = Counter(), Counter()
    for t, n in counts.items():
        if t not in top:
            words[kinds[t]] += 1
            tokens[kinds[t]] += n

    def context(d, i):
        if i and d[i - 1] == d[i] or d[i] in top or d[i] not in counts:
            return None
        if i >= 1 and d[i - 1] not in top:
            return d[i - 1], True, kinds[d[i]]
        if i >= 2 and d[i - 2] not in top:
            return d[i - 2], False, kinds[d[i]]
        return None

    uses, total = Counter(), Counter()
    for d in docs:
        for i in range(len(d)):
            c = context(d, i)
            if c:
                uses[c, d[i]] += 1
                total[c] += 1
    share = Counter()
    for (c, _), n in uses.items():
        share[c] += (n - M.OFF) / total[c] if n >= M.LEAST else 0

    def score(text):
        d, out = cut(text), 0.0
        for i, t in enumerate(d):
            if (i and d[i - 1] == t) or t in top:
                continue
            k = kinds[t] if t in counts else kind(t)
            own = (counts[t] + 1) / (tokens[k] + words[k] + 1)
            c = context(d, i)
            if c and uses[c, t] >= M.LEAST:
                own = (uses[c, t] - M.OFF) / total[c]
            elif c:
                own *= 1 - share[c]
            out += math.log10(own)
        return out

    return score


def test_word_features_against_brute_force(spark, rows, documents):
    import pyarrow as pa

    docs = documents.select("doc_id", lm_scoring.is_held_out().alias("held_out"), "text")
    _, lex, weights = lm_scoring.fitted(docs)
    score = word_model([r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2], lex, weights)
    found = {r.doc_id: r.score for r in lm_scoring.scores(documents).collect()}
    table, some = weights.all_log10(), 0
    for r in rows[:60]:
        w = next(kernels.words(pa.array([r.text or ""]), kernels.SOLID, 1 << 30))
        history, target, *_ = lm_scoring._events(w, lex)
        classes = float(table[history * lm_scoring.CLASSES + target].astype(float).sum())
        assert math.isclose(found[r.doc_id], classes + score(r.text), rel_tol=1e-6, abs_tol=1e-6)
        some += 1
    assert some == 60


def test_word_features_grow_with_the_input_and_know_copies(spark, documents):
    """Held-out texts whose words another text has in the same order gain, others hardly change."""
    rng = random.Random(13)
    pool = [f"{''.join(rng.choices('abcdefgh', k=6))}" for _ in range(400)]
    text = lambda: " ".join(rng.choices(pool, k=80))
    held = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 7 == 2]
    train = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 7 != 2]
    twins = [text() for _ in range(20)]
    data = [(train[k], twins[k % 20]) for k in range(40)] + [(train[100 + k], text()) for k in range(300)] + [(held[k], twins[k]) for k in range(20)] + [(held[50 + k], text()) for k in range(20)]
    found = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.scores(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert min(found[held[k]] for k in range(20)) > max(found[held[50 + k]] for k in range(20)) + 0.5


def test_model_sums_to_one():
    rng = np.random.default_rng(1)
    weights = lm_scoring.Weights(rng.normal(size=lm_scoring.Weights.empty().table.shape).astype(np.float32))
    history = rng.integers(0, lm_scoring.CLASSES, (2, 50))
    assert np.allclose(np.exp(weights.log_classes(history[0], history[1], np.zeros(50, int))).sum(axis=1), 1)


def classes_by_force(texts, threshold=0.8):
    """(class of each text, links of each text) from all pairs."""
    sets = {t: shingles(t) for t in set(texts)}
    names = sorted(sets)
    root, links = {t: t for t in names}, Counter()

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return {t: find(t) for t in names}, links


def test_ngram_join(spark, rows):
    found = {r.doc_id: r for r in queries.queries()["op9_ngram_join"](spark, SF).collect()}
    classes, links = classes_by_force([r.text or "" for r in rows])
    first = {}
    for r in rows:
        first.setdefault(classes[r.text or ""], r.doc_id)
    copies = Counter(r.text or "" for r in rows)
    for r in rows:
        got = found[r.doc_id]
        assert (got.class_id, got.n_links, got.n_copies) == (first[classes[r.text or ""]], links[r.text or ""], copies[r.text or ""])
    assert len(first) < len(rows)


def test_a_split_component_keeps_its_links(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(40):
        w = list(base)
        w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = classes_by_force(texts)
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs).collect()}
    assert len({r.class_id for r in got.values()}) == len(set(classes.values())) and all(got[k].n_links == links[t] for k, t in enumerate(texts))


def test_band_plan():
    bands, size = ngram_join.band_plan()
    assert 1 - (1 - 0.8**size) ** bands >= ngram_join.RECALL and bands * size <= ngram_join.MAX_HASHES


def test_word_kernel():
    import pyarrow as pa

    texts = ["", "Ab cd-Ef é9", None, "x" * 10 + " " + "long words " * 60000]
    got = [w.ends - w.starts for w in kernels.words(pa.array(texts))]
    assert np.concatenate(got).tolist() == [len(x.encode()) for t in texts for x in words(t)]


def test_archives_survive_odd_payloads(spark, tmp_path):
    long = "WARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é\r\n\r\n" * 40
    pages = spark.createDataFrame([(5, "http://a/", long), (3, "http://b/\r\nx", long), (None, None, long), (7, "u", None), (8, "u", "short"), (9, "u", "short")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = {r.page_id: r for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {3: ("response", None), 5: ("revisit", 3), None: ("revisit", 3), 7: ("response", None), 8: ("response", None), 9: ("response", None)}
    assert bytes(found[5].payload) == long.encode() and found[5].payload_bytes == len(long.encode()) and found[7].payload_bytes == 0
