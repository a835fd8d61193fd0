"""Matches of two observers by blocks of time, against a walk in order of arrival."""

import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webstrata.operators import capture
from webstrata.operators.settle import settle

SCHEMA = "k string, id long, at_ms long, headers array<struct<name:string,value:binary>>"


def _walk(ours, theirs, within):
    """Their id, our id and score, one record of theirs after the other."""
    free, out = list(ours), set()
    for k, one, at, headers in sorted(theirs, key=lambda r: (r[2], r[1])):
        near = []
        for o in free:
            if o[0] == k and abs(o[2] - at) <= within:
                same = [(h["name"].lower(), h["value"]) for h in o[3]]
                score = sum(1 if (h["name"].lower(), h["value"]) in same else -1000 if h["name"].lower() in dict(same) else 0 for h in headers)
                near.append((-score, abs(o[2] - at), o[1], o))
        if near:
            best = min(near, key=lambda n: n[:3])
            free.remove(best[3])
            out.add((one, best[2], -best[0]))
    return out


@pytest.mark.parametrize("plenty", [0.25, 0.5, 0.9])
def test_blocks_give_what_a_walk_gives(spark, plenty):
    rng = random.Random(7)
    head = lambda: [{"name": rng.choice(["A", "a", "B"]), "value": bytearray(rng.choice("12").encode())} for _ in range(rng.randrange(3))]
    rows = [(rng.choice("xy"), k, 1_700_000_000_000 + rng.randrange(400) * 50, head()) for k in range(900)]
    ours, theirs = [r for r in rows if rng.random() < plenty], rows
    got = [tuple(r) for r in capture.match(spark.createDataFrame(ours, SCHEMA), spark.createDataFrame(theirs, SCHEMA), ["k"], 300).collect()]
    assert len(got) == len(set(got)) and set(got) == _walk(ours, theirs, 300)


def test_a_busy_window_makes_no_pairs(spark):
    size = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file())
    rows = spark.range(3000).select(F.lit("k").alias("k"), "id", (F.lit(1_700_000_000_000) + F.col("id") % 100).alias("at_ms"), F.array(F.struct(F.lit("A").alias("name"), F.encode((F.col("id") % 3).cast("string"), "UTF-8").alias("value"))).alias("headers"))
    before = size()
    got = capture.match(rows.where("id % 2 = 0"), rows, ["k"], 1000).collect()
    assert len(got) == len({r.our_id for r in got}) == 1500
    assert size() - before < 2_000_000  # 4.5 million pairs


def _one_by_one(theirs, ours, within):
    free = list(ours)
    for at, one, kind in theirs:
        near = [(-(capture._kind_score(k, kind) or 0), abs(t - at), o, t, k) for t, o, k in free if abs(t - at) <= within]
        if near:
            best = min(near)
            free.remove((best[3], best[2], best[4]))
        yield (one, best[2], capture._kind_score(best[4], kind), best[3]) if near else (one, None, None, None)


@pytest.mark.parametrize("seed", range(60))
def test_kinds_by_headers_give_what_all_pairs_give(seed):
    rng = random.Random(seed)
    value = {"a": lambda: rng.choice("12"), "b": lambda: rng.choice(["1", None]), "id": lambda: str(rng.randrange(rng.choice([3, 40])))}

    def kind():
        names = [rng.choice(["a", "b", "id"]) for _ in range(rng.randrange(4))]
        return None if rng.random() < 0.03 else json.dumps([{"n": n} | ({"v": v} if (v := value[n]()) else {}) for n in names] + [{"v": "1"}] * (rng.random() < 0.03))

    span, within = rng.choice([20, 200]), rng.choice([0, 3, 60])
    ours = [(rng.randrange(span), k, kind()) for k in range(rng.choice([1, 60]))]
    theirs = sorted(((rng.randrange(span), k, rng.choice([rng.choice(ours)[2], kind()])) for k in range(50)), key=lambda r: r[:2])
    assert list(settle(theirs, ours, capture._kind_score, within, capture._kind_headers)) == list(_one_by_one(theirs, ours, within))


def test_kinds_of_their_own_are_not_compared_with_each_other():
    asked = []

    def score(ours, theirs):
        asked.append((ours, theirs))
        return capture._kind_score(ours, theirs)

    kinds = [json.dumps([{"n": "accept", "v": "all"}, {"n": "x-id", "v": str(k)}]) for k in range(1500)]
    got = list(settle([(k % 7 + 5, 5000 + k, kind) for k, kind in enumerate(kinds)], [(k % 7, k, kind) for k, kind in enumerate(kinds)], score, 60_000, capture._kind_headers))
    assert got == [(5000 + k, k, 2, k % 7) for k in range(1500)]
    assert len(asked) <= 3 * 1500  # 2.25 million pairs


def test_blocks_of_a_few_rows_share_a_batch():
    kind = json.dumps([{"n": "x", "v": "1"}])
    rows = [(user, 0, side, 2 * user + side, 100 * user + side, kind, False) for user in range(3000) for side in (1, 0)]
    names = ["user", "_block", "side", "id", "at_ms", "kind", "taken"]
    batches = pa.table([pa.array(c) for c in zip(*rows)], names=names).to_batches(max_chunksize=999)  # an odd size cuts blocks in two
    schema = pa.schema([("user", pa.int64()), ("_block", pa.int64()), ("their_id", pa.int64()), ("our_id", pa.int64()), ("score", pa.int32()), ("over", pa.bool_())])
    got = list(capture._settle_blocks(iter(batches), 2, 60_000, schema))
    assert len(got) <= len(batches) + 1
    assert sorted(map(tuple, (r.values() for r in pa.Table.from_batches(got).to_pylist()))) == [(u, 0, 2 * u + 1, 2 * u, 1, False) for u in range(3000)]


@pytest.mark.parametrize("last, runs", [(1550, 1), (1360, 2)])
def test_only_what_the_next_block_can_want_is_handed_on(spark, last, runs):
    """Blocks of 400 ms: the first takes 1290, which the second has as well with a record of theirs that is far from it or near to it."""
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "webstrata"
    stored = lambda: len(list(folder.glob("match-*"))) if folder.exists() else 0
    ours = spark.createDataFrame([("k", 1, 1290, []), ("k", 2, last, [])][: 3 - runs], SCHEMA)
    theirs = spark.createDataFrame([("k", 10, 1195, []), ("k", 11, last, [])], SCHEMA)
    before = stored()
    got = sorted(tuple(r) for r in capture.match(ours, theirs, ["k"], 100).collect())
    assert got == [(10, 1, 0), (11, 2, 0)][: 3 - runs]
    assert stored() - before == runs
