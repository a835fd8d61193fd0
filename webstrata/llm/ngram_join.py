"""N-gram Jaccard self-join of documents by MinHash banding, exact after verification.

1. Texts are identified by digest, so exact copies collapse to one node with a membership row each.
2. Every node's 5-word shingle hashes get ``bands * rows`` MinHashes; ``band_plan`` picks the counts
   for a target recall at the threshold (default 0.9999 at 0.8).
3. Band hashes are shuffled. A bucket yields only the edges to its smallest node, never its pairs, so
   a bucket costs as much as it has members; edges between the same two nodes merge.
4. Connected components of those edges hold every candidate pair. Full shingle sets of their members
   (only theirs) are gathered by component and all pairs inside are verified by set intersection, as
   products of incidence matrices; nothing but degrees and spanning links leaves a task. Components
   of more than ``BLOCK_DOCS`` nodes or ``BLOCK_SHINGLES`` shingles are cut into hashed blocks, and
   each pair of blocks is a task of its own, so no component has to fit one task.
5. Classes are the components of verified links.

Joins on a band, a node or a class are salted where one of them has many rows.

Defined cases: an empty table gives no rows; a null text is an empty text; equal texts are always in one class; texts of fewer than
five words have one shingle of all words; texts without words have no shingle and link to nothing but
their equals; differing rows may share a doc_id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import kernels as K
from webstrata.llm.common import components, cut, join_salted, join_sized, partitions, put_back, set_aside, small_batches, stored, text_id

THRESHOLD, NGRAM, RECALL, MAX_HASHES = 0.8, 5, 0.9999, 128
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 19


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective plan of at most ``most`` hashes that reaches the recall."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no plan of that many hashes reaches the recall")
    return best


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def _band_hashes(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (documents x bands); every document has a shingle."""
    mul, add = _permutations(bands * rows)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            least = np.minimum.reduceat((values ^ add[k]) * mul[k], offsets[:-1])
            out[:, k // rows] = out[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + least
        return K.mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for w in K.words(texts):
            values, offsets = K.shingles(w, n)
            count = np.diff(offsets)
            some = count > 0
            hashes = _band_hashes(values, np.append(offsets[:-1][some], offsets[-1]), bands, rows) if some.any() else np.zeros((0, bands), np.uint64)
            first = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            nodes = [hashlib.sha256((t or "").encode()).digest()[:16] for t in texts.slice(w.docs.start, len(w.docs)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(w.docs.start, len(w.docs)), pa.array(nodes, pa.binary()), pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(first), pa.array(hashes.reshape(-1).view(np.int64)))],
                names=["doc_id", "node", "shingles", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Replace the last column, the text, by its sorted distinct shingle hashes."""
    for batch in batches:
        for w in K.words(batch.column(batch.num_columns - 1)):
            values, offsets = K.unique_by_document(*K.shingles(w, n))
            sets = [values[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([c.slice(w.docs.start, len(w.docs)) for c in batch.columns[:-1]] + [pa.array(sets, pa.binary())], names=batch.schema.names[:-1] + ["shingles"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over shared shingles."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    values, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[at] > 1  # a shingle of one set alone adds nothing
    number = np.cumsum(held > 1) - 1
    of, column = of[shared], number[at[shared]]
    n, m = len(left), len(sets)
    out = np.zeros((n, n if right is None else m - n), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    step = max(64, (1 << 22) // max(1, m))
    total = int(held[held > 1].size)
    for lo in range(0, total, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        dense = np.zeros((m, min(step, total - lo)), np.float32)
        dense[of[a:b], column[a:b] - lo] = 1
        out += dense[:n] @ (dense[:n] if right is None else dense[n:]).T
    return out


def _verify(nodes: list[bytes], sets: list[np.ndarray], other: tuple[list[bytes], list[np.ndarray]] | None, threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(node, smallest node it is connected with here, verified links) of all nodes with a link."""
    size = np.array([len(s) for s in sets], np.float32)
    shared = _overlaps(sets, other[1] if other else None)
    size2 = np.array([len(s) for s in other[1]], np.float32) if other else size
    link = shared >= threshold * (size[:, None] + size2[None, :] - shared) - 1e-6
    link &= shared > 0
    if other is None:
        np.fill_diagonal(link, False)
        names = nodes
    else:
        names = nodes + other[0]
        full = np.zeros((len(names), len(names)), np.bool_)
        full[: len(nodes), len(nodes) :] = link
        full[len(nodes) :, : len(nodes)] = link.T
        link = full
    order = sorted(range(len(names)), key=names.__getitem__)
    label = np.empty(len(names), np.int64)
    label[order] = np.arange(len(names))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(names)).min(axis=1))
        if (least == label).all():
            break
        label = least
    degree = link.sum(axis=1)
    return [(names[i], names[order[label[i]]], int(degree[i])) for i in np.flatnonzero(degree)]


def _verify_group(key: tuple, group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    found = []
    for _, part in group.drop_duplicates("node").groupby("root", sort=False):
        sets = {b: ([], []) for b in sorted(part["block"].unique())}
        for node, block, raw in zip(part["node"], part["block"], part["shingles"]):
            sets[block][0].append(bytes(node))
            sets[block][1].append(np.frombuffer(raw, np.uint64))
        if key[1] == key[2]:
            names, values = next(iter(sets.values()))
            if len(names) > 1:
                found += _verify(names, values, None, threshold)
        elif len(sets) == 2:
            found += _verify(*sets[key[1]], sets[key[2]], threshold)
    return pd.DataFrame(found, columns=["node", "peer", "links"])


def nodes_and_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): doc_id and node of every row; class_id, links and copies of every node."""
    spark = docs.sparkSession
    bands, rows = band_plan(threshold, recall)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, node binary, shingles bigint, bands array<bigint>"
    with small_batches(spark):
        signed = stored(source.mapInArrow(lambda b: _signatures(b, bands, rows, n), schema), "signatures")
    texts = stored(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")), "texts")

    keyed = texts.select("node", F.explode("bands").alias("band"))
    buckets = stored(keyed.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    edges = join_salted(keyed, buckets.drop("n"), ["band"], "inner", counts=buckets).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    grouped = cut(components(edges))

    sized = grouped.join(texts.select(F.col("node"), "first", "shingles"), "node")
    stats = cut(sized.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.sum("shingles").alias("load")))
    total, split = stats.agg(F.sum("load"), F.max("blocks")).first()
    bundles = max(4 * partitions(spark), int(total or 0) // BLOCK_SHINGLES)
    picks = cut(sized.join(stats, "root").select("node", "root", "first", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    wanted = join_sized(source.withColumn("node", text_id()), picks, ["node"], "inner", row_bytes=80).where(F.col("doc_id").eqNullSafe(F.col("first")))
    sets = wanted.select("node", "root", "blocks", "block", "text").mapInArrow(lambda b: _sets(b, n), "node binary, root binary, blocks int, block int, shingles binary")
    one = F.col("blocks") <= 1
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(one, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.xxhash64("root")).alias("bundle"),
        F.when(one, F.lit(-1)).otherwise(F.least("block", "other")).alias("i"),
        F.when(one, F.lit(-1)).otherwise(F.greatest("block", "other")).alias("j"),
        "node", "root", "block", "shingles",
    )

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _verify_group(key, group, threshold)

    with small_batches(spark):
        links = cut(pairs.groupBy("bundle", "i", "j").applyInPandas(verify, "node binary, peer binary, links bigint").groupBy("node", "peer").agg(F.sum("links").alias("links")))
    if split and split > 1:  # links of a component may lie in several tasks
        roots = components(links.select(F.col("node").alias("u"), F.col("peer").alias("v"))).withColumnRenamed("root", "peer")
        links = links.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left").withColumn("peer", F.coalesce("peer", "node"))
    # the order of classes and of their members: null ids come last, then by digest
    rank = lambda i: F.struct(F.col(i).isNull().alias("last"), F.col(i).alias("doc_id"), F.col("node"))
    own = texts.select("node", "first", "copies")
    heads = cut(own.join(links.select("node", "peer"), "node").groupBy("peer").agg(F.min(rank("first")).alias("head"), F.count(F.lit(1)).alias("n")))
    linked = join_salted(links, heads.drop("n"), ["peer"], "inner", counts=heads).select("node", "links", "head")
    nodes = own.join(linked, "node", "left").select("node", "first", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("head", rank("first")).alias("head"))
    return signed.select("doc_id", "node"), nodes


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """One row a document: class_id (the smallest doc_id of its class), n_links (different texts of
    at least that similarity) and n_copies (rows with the same text, itself included)."""
    members, nodes = nodes_and_classes(docs, threshold, n, recall)
    nodes = stored(nodes, "classes")
    return join_salted(members, nodes, ["node"], "inner", counts=nodes.select("node", F.col("copies").alias("n"))).select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of the smallest doc_id.

    Repeated rows of that document are copies, so one of them stays too. Texts are not shuffled
    unless more documents go than may be broadcast.
    """
    members, nodes = nodes_and_classes(docs, threshold, n)
    judged = members.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows")).join(nodes.select("node", "head"), "node")
    stays = (F.col("head.node") == F.col("node")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id"))
    marks = stored(judged.where(~stays | (F.col("rows") > 1)).select(F.xxhash64("doc_id", "node").alias("_row"), F.col("node").alias("_node"), stays.alias("_repeated")), "copies")
    used = ["doc_id", "text"]
    keyed = set_aside(docs, used).withColumn("_node", text_id()).withColumn("_row", F.xxhash64("doc_id", "_node"))
    marked = join_sized(keyed, marks, ["_row", "_node"], "left", row_bytes=64)
    kept = marked.where(F.col("_repeated").isNull()).unionByName(marked.where("_repeated").dropDuplicates(["_row", "_node"]))
    return kept.select(*put_back(docs.columns, used))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
