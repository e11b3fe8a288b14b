"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``BANDS`` half keys, each of ``ROWS`` minhashes, are computed per document; every pair (i, j)
of half keys, one of each collection, is a table key. That gives BANDS² tables of 2·ROWS minhashes from 2·BANDS·ROWS
minhash functions (196 tables from 84 functions, where plain banding would take 1,176). A pair of Jaccard similarity s
shares a key with probability (1 - (1 - s^ROWS)^BANDS)².

Candidates are verified on their shingle sets. Texts with the same words collapse first; then each bucket links its
members to its least member; then, as similarity is not transitive, all pairs of a bucket that are still in different
groups are verified too. Any candidate pair is thus either verified or already in one group, which is all that grouping
needs, and a bucket of thousands of copies costs thousands of verifications, not millions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_rows, drop_ids, table
from folioforge.llm.textblock import U, Words, grams, inside, list_array, mix, pieces
from folioforge.plans.components import connected_components
from folioforge.plans.lineage import shared_table

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 14, 3, 0.5
#: Node ids up to this many (16 MB) are broadcast to select texts to verify; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**63, 2 * BANDS * ROWS, U) * U(2) + U(1)
_B = _rng.integers(0, 2**63, 2 * BANDS * ROWS, U)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE words, and how many each document has; a text of fewer words is one shingle."""
    h, n = w.hashes(), w.counts()
    g = grams(h, SHINGLE)
    ok = inside(w.first, SHINGLE, len(g))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return g[ok], np.maximum(n - SHINGLE + 1, 0)
    lengths = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    out = np.zeros(lengths.sum(), U)
    at = np.concatenate([[0], np.cumsum(lengths)])
    full = np.repeat(n >= SHINGLE, lengths)
    out[full] = g[ok]
    for d in short:
        v = np.zeros(1, U)
        for x in h[w.first[d] : w.first[d + 1]]:
            v = mix(v * U(31) + x)
        out[at[d]] = v[0]
    return out, lengths


def _signatures(batches):
    for batch in pieces(batches):
        w = Words(batch.column("text"))
        g, lengths = shingles(w)
        bare = np.flatnonzero((lengths == 0) & pc.is_valid(batch.column("text")).to_numpy(zero_copy_only=False))
        if len(bare):  # no words to compare: equal to the same text only, and in no bucket
            digests = b"".join(hashlib.md5(t.encode()).digest() for t in batch.column("text").take(pa.array(bare)).to_pylist())
            f = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            none = list_array(np.zeros(0, np.int64), np.zeros(len(bare), np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(bare)), pa.array(f[0].copy()), pa.array(f[1].copy()), none, none], ["id", "f1", "f2", "a", "b"])
        has = np.flatnonzero(lengths)
        ids = batch.column("doc_id").take(pa.array(has))
        if not len(has):
            continue
        at = (np.concatenate([[0], np.cumsum(lengths)])[:-1])[has]
        halves = np.zeros((2 * BANDS, len(has)), U)
        for i in range(2 * BANDS * ROWS):
            halves[i // ROWS] = mix(halves[i // ROWS] ^ np.minimum.reduceat(g * _A[i] + _B[i], at)) + U(i % ROWS + 1)
        h, first = w.hashes(), w.first
        place = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))).astype(U)
        whole = []
        for seed in (1, 2):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h * U(2 * seed + 1) + place * U(0x9E3779B97F4A7C15)), dtype=U)])
            whole.append((total[first[1:]] - total[first[:-1]])[has].view(np.int64))
        a, b = (np.ascontiguousarray(x.T).ravel().view(np.int64) for x in (halves[:BANDS], halves[BANDS:]))
        per = np.full(len(has), BANDS)
        yield pa.RecordBatch.from_arrays([ids, pa.array(whole[0]), pa.array(whole[1]), list_array(a, per, pa.int64()), list_array(b, per, pa.int64())], ["id", "f1", "f2", "a", "b"])


def _sets(batches):
    for batch in pieces(batches):
        g, lengths = shingles(Words(batch.column("text")))
        owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        keys = np.unique((owner << 32) | (g >> U(32)).astype(np.int64))
        values = (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(values, np.bincount(keys >> 32, minlength=len(lengths)), pa.int32())], ["id", "set"])


def _similar(edges: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``(src, dst, similarity)`` of the edges whose shingle sets (by 32-bit hashes) have Jaccard similarity of at least ``threshold``."""
    nodes = shared_table(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "nodes")
    few = nodes.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(nodes) if few else nodes, texts["doc_id"] == nodes["id"], "left_semi")
    sets = shared_table(chosen.mapInArrow(_sets, f"id {dict(texts.dtypes)['doc_id']}, set array<int>"), "sets")
    left = edges.join(sets.select(F.col("id").alias("dst"), F.col("set").alias("t")), "dst")
    both = left.join(sets.select(F.col("id").alias("src"), F.col("set").alias("s")), "src")
    shared = both.select("src", "dst", F.size(F.array_intersect("s", "t")).alias("n"), F.size("s").alias("p"), F.size("t").alias("q"))
    scored = shared.select("src", "dst", (F.col("n") / (F.col("p") + F.col("q") - F.col("n"))).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, group_id)`` of every document that has a near duplicate; ``group_id`` is the least doc_id of the group.

    A group is a connected component of pairs whose sets of word 3-grams have Jaccard similarity of at least
    ``threshold``. A text of one or two words matches only the same words, one without words (empty, punctuation only)
    exactly the same text; null has no duplicates. Rows without a doc_id take no part; doc_id is of any type with an order.
    Rows that repeat a doc_id count as one document.
    Whole texts are compared, of any length; further columns are not looked at; an empty table gives an empty result.
    """
    arrow_rows(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    signed = texts.mapInArrow(_signatures, f"id {kind}, f1 bigint, f2 bigint, a array<bigint>, b array<bigint>")
    # one row for each distinct sequence of words (or text without words); equal words have equal a and b
    signed = shared_table(signed, "signed")
    rep = signed.groupBy("f1", "f2").agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("n"))
    copies = signed.select("f1", "f2", F.col("id").alias("dst")).join(rep.where("n > 1"), ["f1", "f2"]).where("src <> dst").select("src", "dst")
    heads = signed.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min("a").alias("a"), F.min("b").alias("b")).select("id", "a", "b")
    halves = heads.select("id", F.posexplode("a").alias("i", "x"), "b").select("id", "i", "x", F.posexplode("b").alias("j", "y"))
    keys = halves.select("id", F.xxhash64("i", "x", "j", "y").alias("key"))
    w = Window.partitionBy("key")
    buckets = shared_table(keys.withColumn("hub", F.min("id").over(w)).withColumn("top", F.max("id").over(w)).where("hub < top").select("key", "id", "hub"), "buckets")
    star = shared_table(buckets.where("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct(), "star")
    linked = shared_table(_similar(star, texts, threshold), "linked")
    part = connected_components(linked)
    member = buckets.select("key", "id").join(part.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    split = member.withColumn("p0", F.min("part").over(w)).withColumn("p1", F.max("part").over(w)).where("p0 < p1").select("key", "id", "part")
    split = shared_table(split, "split")
    cross = split.alias("l").join(split.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.part") != F.col("r.part")) & (F.col("l.id") < F.col("r.id")))
    cross = cross.select(F.col("l.id").alias("src"), F.col("r.id").alias("dst")).distinct().join(star, ["src", "dst"], "left_anti")
    more = shared_table(_similar(shared_table(cross, "cross"), texts, threshold), "more")
    edges = linked.select("src", "dst").union(more.select("src", "dst")).union(copies)
    return connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the members of a duplicate group but that of the least doc_id, and of rows that repeat a doc_id one,
    the first by text; rows without a doc_id all stay, and so do all columns."""
    groups = duplicate_groups(docs, threshold)
    kept = drop_ids(docs, groups.where("doc_id <> group_id").select(F.col("doc_id").alias("__id")))
    again = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__id is not null and __n > 1").select("__id")
    again = shared_table(again, "again")
    if again.isEmpty():
        return kept
    few = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    twice = kept.join(few, kept["doc_id"] == few["__id"], "left_semi")
    one = twice.withColumn("__rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__rn = 1").drop("__rn")
    return drop_ids(kept, again).unionByName(one)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
