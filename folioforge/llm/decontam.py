"""Benchmark decontamination by winnowing.

Of each window of WINDOW consecutive word K-grams the one of least hash is kept, in training and test texts alike, so
two texts that share WINDOW + K - 1 words in a row keep at least one K-gram in common. Fingerprints of the test set are
joined to those of the corpus; each hit is then extended to the left and right on the words of both texts, and the
maximal shared spans are reported. A test text that is too short for that guarantee has one fingerprint, of all its words,
which is looked for at every word of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_rows, drop_ids, table
from folioforge.llm.textblock import U, Words, grams, inside, mix, pieces, sliding_min
from folioforge.plans.lineage import shared_table

K, WINDOW = 5, 4
#: Words in a row that both texts must share; a shorter item must be shared whole. Winnowing finds every span of GUARANTEE words.
MIN_SPAN = 10
GUARANTEE = K + WINDOW - 1
#: Test fingerprints up to this many (64 MB) are broadcast; beyond, Spark shuffles both sides by fingerprint.
BROADCAST_FINGERPRINTS = 4_000_000
#: Ids of contaminated documents up to this many are broadcast to select their texts; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def winnow(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept K-grams as (document, word position in it, hash); a text of fewer than WINDOW K-grams keeps all of them."""
    g = grams(w.hashes(), K)
    ok = inside(w.first, K, len(g))
    doc = w.docs()[: len(g)]
    low = sliding_min(g, WINDOW)
    whole = inside(w.first, K + WINDOW - 1, len(low))
    keep = np.zeros(len(g), bool)
    for j in range(WINDOW):
        at = np.flatnonzero(whole & (g[j : j + len(low)] == low))
        keep[at + j] = True
    short = w.counts() < K + WINDOW - 1
    keep |= short[doc]
    at = np.flatnonzero(keep & ok)
    return doc[at], at - w.first[doc[at]], g[at].view(np.int64)


def _whole(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, other ones than those of winnowing."""
    return (grams(h, n) ^ mix(np.full(1, n, U))).view(np.int64)


def _listed(batch, doc: np.ndarray, pos: np.ndarray, g: np.ndarray, words: np.ndarray):
    order = np.argsort(doc, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(g[order]), pa.array(pos[order].astype(np.int32)), pa.array(words[order].astype(np.int32))], ["fp", "pos", "words"])
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), items)], ["id", "fps"])


def _test_fingerprints(batches):
    """``words`` is 0 for fingerprints of winnowing, for others the number of the short item's words."""
    for batch in pieces(batches):
        w = Words(batch.column("text"))
        h, n = w.hashes(), w.counts()
        doc, pos, g = winnow(w)
        keep = n[doc] >= GUARANTEE
        parts = [(doc[keep], pos[keep], g[keep], np.zeros(keep.sum(), np.int64))]
        for k in range(1, GUARANTEE):
            d = np.flatnonzero(n == k)
            if len(d):
                parts.append((d, np.zeros(len(d), np.int64), _whole(h, k)[w.first[d]], np.full(len(d), k)))
        yield _listed(batch, *(np.concatenate(x) for x in zip(*parts)))


def _train_fingerprints(shared):
    """``shared``: by number of words the sorted hashes of the short items, or None, where they are too many to be sent around."""

    def run(batches):
        short = shared.value
        for batch in pieces(batches):
            w = Words(batch.column("text"))
            doc, pos, g = winnow(w)
            parts = [(doc, pos, g, np.zeros(len(doc), np.int64))]
            h, owner = (w.hashes(), w.docs()) if short else (None, None)
            for k, known in short.items():
                x = _whole(h, k)
                ok = inside(w.first, k, len(x))
                if known is not None:
                    ok &= known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
                at = np.flatnonzero(ok)
                parts.append((owner[at], at - w.first[owner[at]], x[at], np.full(len(at), k)))
            yield _listed(batch, *(np.concatenate(x) for x in zip(*parts)))

    return run


def spans(doc: np.ndarray, item: np.ndarray, at: np.ndarray, least: int = MIN_SPAN) -> list[tuple[int, int, int]]:
    """Maximal spans (start in doc, start in item, words) that hold one of the hits ``at`` (position in doc, in item)."""
    out = []
    for d in np.unique(at[:, 0] - at[:, 1]):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        equal = np.zeros(hi - lo + 2, np.int8)
        equal[1:-1] = item[lo:hi] == doc[lo + d : hi + d]
        step = np.diff(equal)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        hit = np.unique(at[at[:, 0] - at[:, 1] == d, 1]) - lo
        hit = hit[(hit >= 0) & (hit < hi - lo)]
        for r in np.unique(np.searchsorted(starts, hit, "right") - 1):
            if r >= 0 and (n := int(ends[r] - starts[r])) >= min(least, len(item)):
                out.append((int(starts[r] + lo + d), int(starts[r] + lo), n))
    return out


def _extend(batches):
    for batch in pieces(batches):
        docs, items = Words(batch.column("text")), Words(batch.column("item_text"))
        h, g = docs.hashes(), items.hashes()
        out = []
        for r, hits in enumerate(batch.column("hits").to_pylist()):
            at = np.array([(x["pos"], x["item_pos"]) for x in hits], np.int64)
            for a, b, n in spans(h[docs.first[r] : docs.first[r + 1]], g[items.first[r] : items.first[r + 1]], at):
                out.append((r, a, b, n))
        rows = np.array(out, np.int64).reshape(-1, 4)
        ids = [batch.column(c).take(pa.array(rows[:, 0])) for c in ("id", "item_id")]
        yield pa.RecordBatch.from_arrays([*ids, *(pa.array(rows[:, c]) for c in (1, 2, 3))], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, doc_word, item_word, n_words)``: maximal spans of at least MIN_SPAN words that a document shares
    with a benchmark item, with the word positions where they start.

    Words are compared in lower case without punctuation. An item of fewer than MIN_SPAN words, down to one, counts when all
    of it is shared. Null and empty texts share nothing; rows without a doc_id or item_id take no part; ids are of any type;
    repeated rows give their spans once; further columns are not looked at; an empty table on either side gives an empty
    result.
    """
    arrow_rows(docs.sparkSession)
    of_doc, of_item = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    items = benchmark.select(F.col("item_id").alias("id"), "text").where("id is not null and text is not null").distinct()
    fps = "fps array<struct<fp: bigint, pos: int, words: int>>"
    test = items.mapInArrow(_test_fingerprints, f"id {of_item}, {fps}").select(F.col("id").alias("item_id"), F.inline("fps")).withColumnRenamed("pos", "item_pos")
    test = shared_table(test, "test")
    short = test.where("words > 0").groupBy("words").agg(F.count(F.lit(1)).alias("n")).collect()  # GUARANTEE - 1 rows at most
    known: dict[int, np.ndarray | None] = {r["words"]: None for r in short}
    if sum(r["n"] for r in short) <= BROADCAST_FINGERPRINTS // 4:
        rows = test.where("words > 0").select("words", "fp").distinct().toArrow()
        k, fp = (rows.column(c).to_numpy() for c in ("words", "fp"))
        known = {n: np.sort(fp[k == n]) for n in known}
    if test.count() <= BROADCAST_FINGERPRINTS:
        test = F.broadcast(test)
    train = texts.mapInArrow(_train_fingerprints(docs.sparkSession.sparkContext.broadcast(known)), f"id {of_doc}, {fps}").select("id", F.inline("fps"))
    hits = train.join(test, ["fp", "words"]).groupBy("id", "item_id").agg(F.collect_set(F.struct("pos", "item_pos")).alias("hits"))
    hits = shared_table(hits, "hits")
    ids = hits.select("id").distinct()
    found = texts.join(F.broadcast(ids) if hits.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    pairs = hits.join(items.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id").join(found, "id")
    return pairs.mapInArrow(_extend, f"doc_id {of_doc}, item_id {of_item}, doc_word bigint, item_word bigint, n_words bigint").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that share a span with ``benchmark``; all columns stay, other rows as they are."""
    return drop_ids(docs, contamination(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct())


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontam": op3_decontam}
ORACLES: dict[str, str] = {}
