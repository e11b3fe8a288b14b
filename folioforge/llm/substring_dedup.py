"""Repeated passages, exactly, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the M-gram of least hash in it. Consecutive windows that share
their minimiser travel as one packed string to the bucket of that minimiser, about three times the text in all instead of
WINDOW times. Equal windows have equal minimisers, so each bucket counts its windows by itself: it sorts their 128-bit
fingerprints. Equal strings of a piece of the input are sent once, with the list of their places, so that a passage that very
many documents share comes to its bucket as few strings. Buckets arrive sorted in a partition and are counted a group of
buckets at a time, so a worker holds no more than about GROUP_BYTES of text, or one bucket; in it the holders of a window
are told apart CHUNK at a time, as many windows as have so many holders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_rows, table
from folioforge.llm.textblock import U, Words, grams, inside, pieces, sliding_min

WINDOW, M = 50, 8
GROUP_BYTES = 8 << 20
CHUNK = 4 << 20
_PLACE = U((1 << 22) - 1)


def super_kmers(w: Words, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, first word in it, words, minimiser hash)`` of maximal runs of windows that share the place of their minimiser."""
    g = grams(w.hashes(), m)
    # order by the upper bits of the hash, ties by place: the leftmost
    packed = (g & ~_PLACE) | (np.arange(len(g), dtype=U) & _PLACE)
    low = sliding_min(packed, window - m + 1)
    at = np.flatnonzero(inside(w.first, window, len(low)))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    doc = np.searchsorted(w.first, at, "right") - 1
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(at)))
    first = at[begin]
    place = (low[begin] & _PLACE).astype(np.int64)
    place += (first >> 22 << 22)
    place[place < first] += 1 << 22
    return doc[begin], first - w.first[doc[begin]], runs + window - 1, g[place]


def _cut(batches):
    for batch in pieces(batches):
        w = Words(batch.column("text"))
        doc, first, n, mini = super_kmers(w)
        a = w.first[doc] + first
        raw = w.data.tobytes()
        packed = [raw[x:y] for x, y in zip(w.start[a].tolist(), w.end[a + n - 1].tolist())]
        each = pa.array(packed, pa.binary()).dictionary_encode()
        code = each.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(each.dictionary))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, batch.column("doc_id").take(pa.array(doc[order])))
        places = pa.ListArray.from_arrays(offsets, pa.array(first[order].astype(np.int32)))
        bucket = mini[order][np.cumsum(n) - n]  # equal strings have equal minimisers
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), ids, places, each.dictionary], ["bucket", "docs", "firsts", "packed"])


def _codes(ids: pa.Array) -> tuple[np.ndarray, pa.Array | None]:
    """Numbers in the order of the ids, and the ids of the numbers where they aren't the numbers themselves."""
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).to_numpy(), None
    each = ids.dictionary_encode()
    order = pc.sort_indices(each.dictionary).to_numpy()
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[each.indices.to_numpy()], each.dictionary.take(pa.array(order))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then as many from first[1] on as n[1] says, and so on."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _holders(key: np.ndarray, row: np.ndarray, begin: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By key (sorted): how many documents have it, and the least. Row r is at the places from begin[r] on, n[r] of them."""
    keys = int(key[-1]) + 1 if len(key) else 0
    many, least = np.zeros(keys, np.int64), np.zeros(keys, np.int64)
    size = np.cumsum(n[row])
    at = 0
    while at < len(key):
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right"))
        to = int(np.searchsorted(key, key[min(max(to, at + 1), len(key)) - 1], "right"))  # up to the end of a key
        r = row[at:to]
        k, d = np.repeat(key[at:to], n[r]), doc[_spread(begin[r], n[r])]
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        least[k[new]] = d[new]
        new[1:] |= d[1:] != d[:-1]
        many[: k[-1] + 1] += np.bincount(k[new], minlength=k[-1] + 1)
        at = to
    return many, least


def _repeats(t: pa.Table):
    """Runs of windows that occur in two documents or more: one batch for whole buckets."""
    w = Words(t.column("packed").cast(pa.large_binary()).cast(pa.large_string()).combine_chunks())
    bucket = t.column("bucket").to_numpy()
    docs, firsts = (pa.concat_arrays([c.flatten() for c in t.column(name).chunks]) for name in ("docs", "firsts"))
    doc, ids = _codes(docs)
    start, n = firsts.to_numpy(), pc.list_value_length(t.column("docs")).to_numpy().astype(np.int64)
    begin = np.cumsum(n) - n
    a, b = grams(w.hashes(), WINDOW), grams(w.hashes(1), WINDOW)
    at = np.flatnonzero(inside(w.first, WINDOW, len(a)))
    row = np.searchsorted(w.first, at, "right") - 1
    a, b = a[at] ^ (bucket[row].view(U) * U(0x9E3779B97F4A7C15)), b[at]
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    key = np.cumsum(new) - 1
    again = np.bincount(key, n[row[order]], len(x))[key] > 1 if len(x) else np.zeros(0, bool)  # what has one place isn't looked at
    own = order[again]
    _, key = np.unique(key[again], return_inverse=True)
    many, least = _holders(key, row[own], begin, n, doc)
    held, first = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    held[own], first[own] = many[key], least[key]
    found = np.flatnonzero(held > 1)
    cut = np.ones(len(found), bool)
    cut[1:] = (row[found][1:] != row[found][:-1]) | (found[1:] != found[:-1] + 1)
    s = np.flatnonzero(cut)
    if not len(s):
        return None
    e = np.append(s[1:], len(found)) - 1
    r, word = row[found[s]], at - w.first[row]
    place, times = _spread(begin[r], n[r]), n[r]
    numbers = [start[place] + np.repeat(word[found[s]], times), start[place] + np.repeat(word[found[e]], times), np.repeat(np.maximum.reduceat(held[found], s), times)]
    least = np.repeat(np.minimum.reduceat(first[found], s), times)
    of = lambda c: docs.take(pa.array(place)) if c is None else (pa.array(c).cast(docs.type) if ids is None else ids.take(pa.array(c)))
    return pa.RecordBatch.from_arrays([of(None), *(pa.array(c.astype(np.int64)) for c in numbers), of(least)], ["doc_id", "a", "b", "n_docs", "first_doc_id"])


def _count(batches):
    held, size, most = [], 0, GROUP_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        t = pa.Table.from_batches(held)
        buckets = t.column("bucket").to_numpy()
        whole = int(np.searchsorted(buckets, buckets[-1], "left"))  # the last bucket may go on in the next batch
        if whole:
            if (out := _repeats(t.slice(0, whole))) is not None:
                yield out
            held = t.slice(whole).to_batches()
            size = sum(x.nbytes for x in held)
        most = max(GROUP_BYTES, 2 * size)
    if held and (out := _repeats(pa.Table.from_batches(held))) is not None:
        yield out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words, n_docs, first_doc_id)``: the maximal passages of a document whose every
    window of WINDOW words is also in another document.

    Words are compared in lower case without punctuation; ``end_word`` is one past the last. ``n_docs`` is the most
    documents that any window of the passage is in, ``first_doc_id`` the least doc_id among all holders of its windows:
    where it is less than ``doc_id`` the passage repeats an earlier document. Texts of fewer words, null and empty ones
    have no window. What repeats only inside one document doesn't count, nor do rows that repeat a doc_id; rows without
    a doc_id take no part; doc_id is of any type with an order; further columns are not looked at; texts may be of any length; an empty table gives an empty
    result.
    """
    arrow_rows(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    cut = texts.mapInArrow(_cut, f"bucket bigint, docs array<{kind}>, firsts array<int>, packed binary")
    runs = cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, f"doc_id {kind}, a bigint, b bigint, n_docs bigint, first_doc_id {kind}")
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("doc_id", "island").agg(F.min("a").alias("start_word"), (F.max("b") + WINDOW).alias("end_word"), F.max("n_docs").alias("n_docs"), F.min("first_doc_id").alias("first_doc_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_docs", "first_doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
