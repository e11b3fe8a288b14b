"""Byte-level BPE with Spark's higher-order functions.

The ranked merges are folded over the byte array of a word: each step looks up the rank of every neighbouring pair in a
literal map, and joins the first pair of least rank. As words repeat, the fold runs once for each distinct word that
occurs more than once, and its result is looked up for every occurrence. The words that occur once (or are beyond the
bounded dictionary) are merged where they stand, all of a piece of text at once, step for step as in the fold and by the
same pairs. Nothing but word counts is shuffled.

Texts are cut into words a batch at a time, by the classes of all its characters at once. The dictionary goes to the
workers as 128-bit fingerprints in order, with the ids; a worker takes it over once, not once a batch.

The literal map is two arrays, the rows of the table of pairs pushed into each other: the entry of pair (a, b) is in slot
shift[a] + b, as a·2^16 + merged id. Lookups thus cost the same for any vocabulary (Spark's own map literals are searched
from end to end).
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import arrow_rows, table
from folioforge.llm.textblock import U, Words, buffers, list_array, pieces
from folioforge.plans.lineage import release, shared_table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most frequent words whose ids are kept on the driver and broadcast (some 60 MB); all other words are merged in place.
DICTIONARY = 2_000_000
#: The fold copies a word's ids once a merge; longer words are merged with a heap, in n log n.
FOLD_BYTES = 64
#: Bytes of text that are cut at a time, to count words and to look them up; a worker holds some 100 bytes for each.
COUNTED, PIECE = 1 << 20, 1 << 19

@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The entry of no pair: of row 65535, which no vocabulary has.
_NONE = 65535 << 16


def _split(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a token when all merges of lower rank are done."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while True:
        found = [(ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)]
        low, i = min(found, default=(limit, 0))
        if low >= limit:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@functools.lru_cache(maxsize=4)
def _pairs(path: str) -> tuple[list[int], list[int]]:
    """Shifts of the rows, slots.

    Merges go by rank and never take a boundary back, so when a token's merge has its turn its bytes stand as they would
    without their neighbours: as two pieces, always the same. That pair is its only entry.
    """
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    if size >= 1 << 16:
        raise ValueError("ids must be below 65535")
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        if len(token) > 1 and len(parts := _split(token, ranks)) == 2:
            rows.setdefault(ranks[parts[0]], {})[ranks[parts[1]]] = rank
    n = sum(map(len, rows.values()))
    slots, free, shifts = np.full(4 * n + 4 * size, _NONE, np.int64), np.ones(4 * n + 4 * size, bool), [0] * size
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        columns = np.fromiter(row, np.int64)
        low, step, shift = columns.min(), 4096, -1
        at = int(free.argmax()) if len(columns) < 3 else 0
        while shift < 0:  # the first place, from at on, where the whole row falls on free slots
            ok = np.ones(step, bool)
            for c in columns - low:
                ok &= free[at + c : at + c + step]
            shift = at + int(ok.argmax()) if ok.any() else -1
            at += step
        shifts[a] = int(shift - low)
        slots[shift - low + columns] = a * 65536 + np.fromiter(row.values(), np.int64)
        free[shift - low + columns] = False
    pad = max(0, -min(shifts))  # shifts may be negative; all slots that any (a, b) asks for must exist
    slots = np.concatenate([np.full(pad, _NONE), slots])[: max(shifts) + pad + size]
    return [x + pad for x in shifts], slots.tolist()


def _literal(values: list[int]) -> Column:
    """An array literal; Spark folds the split and cast when it plans the query."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(word: Column, path: str = RANKS) -> Column:
    """Token ids of one word: its bytes' ids, then merges by rank, leftmost first, until no neighbours can merge."""
    ranks = load_ranks(path)
    shift, slot = map(_literal, _pairs(path))
    byte = _literal([ranks[bytes([b])] for b in range(256)])
    none = F.lit(65536).cast("bigint")

    def ranked(a: Column, b: Column) -> Column:
        """The merged id; 65536 or more where the pair has none, as the slot then holds another row's entry, or none."""
        return slot[shift[a] + b].bitwiseXOR(F.shiftleft(a, 16))

    def step(acc: Column, _: Column) -> Column:
        def join(pairs: Column, low: Column) -> Column:
            at = F.array_position(pairs, low).cast("int")
            merged = _let(at, lambda k: F.concat(F.slice(acc, F.lit(1), k - 1), F.array(low), F.slice(acc, k + 2, F.size(acc))))
            return F.when(low < none, merged).otherwise(F.transform(acc, lambda a: -a - 1))  # done: all ids negative

        pairs = F.transform(acc, lambda a, i: ranked(a, F.get(acc, i + 1)))  # the last has no neighbour: null
        return F.when(F.get(acc, F.lit(0)) < 0, acc).otherwise(_let(pairs, lambda x: _let(F.array_min(x), lambda low: join(x, low))))

    chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(chars, lambda c: byte[F.ascii(c)])
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    finish = lambda acc: F.transform(acc, lambda a: F.when(a < 0, -a - 1).otherwise(a).cast("int"))
    return F.aggregate(steps, start, step, finish)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places from each start on, ``n`` of them, one span after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Merges:
    """The pairs of ``fold`` as arrays, for ``merge_words``."""

    NONE = 1 << 16

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.shift, self.slot = (np.array(x, np.int64) for x in _pairs(path))

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged ids; NONE where the pair has none."""
        return np.minimum(self.slot[self.shift[a] + b] ^ (a << 16), self.NONE)


def merge_words(data: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many words, and how many each has. ``data`` has their bytes one after the other, at least one each.

    Each step joins the first pair of least rank of every word that still has one, as ``fold`` does word by word; as many
    steps as the longest word has bytes at most.
    """
    base = np.cumsum(lengths) - lengths
    out, size = np.zeros(len(data), np.int32), np.zeros(len(lengths), np.int64)
    word, n, start, ids = np.arange(len(lengths)), lengths.astype(np.int64), base.astype(np.int64), merges.byte[data]
    rank = np.full(len(ids), merges.NONE, np.int64)
    rank[:-1] = merges.ranked(ids[:-1], ids[1:])
    rank[start + n - 1] = merges.NONE  # the last of a word has no neighbour
    while len(word):
        low = np.minimum.reduceat(rank, start)
        going = low < merges.NONE
        if not going.all():
            stays, m = np.repeat(going, n), n[~going]
            out[_spans(base[word[~going]], m)] = ids[~stays]
            size[word[~going]] = m
            ids, rank, word, low, n = ids[stays], rank[stays], word[going], low[going], n[going]
            start = np.cumsum(n) - n
            if not len(word):
                break
        hits = np.flatnonzero(rank == np.repeat(low, n))
        at = hits[np.searchsorted(hits, start)]
        ids[at], rank[at] = low, merges.NONE
        more = at + 2 < start + n
        rank[at[more]] = merges.ranked(low[more], ids[at[more] + 2])
        more = at > start
        rank[at[more] - 1] = merges.ranked(ids[at[more] - 1], low[more])
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids, rank, n = ids[stays], rank[stays], n - 1
        start = start - np.arange(len(word))
    return out[np.arange(len(out)) - np.repeat(base, lengths) < np.repeat(size, lengths)], size


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length, by a heap of pairs over a linked list."""
    n = len(word)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def push(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != to:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, to, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(before[i])
        push(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 any other character."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = 1 if kind == "L" else 2
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = 3
    return out


def cut(texts: pa.Array) -> Words:
    """The words of a batch, as the vocabulary's authors cut texts before the merges: ``'s 't 're 've 'm 'll 'd``, runs of
    letters, of numbers and of other characters, each with one blank before it, and runs of white space. All bytes of a
    text are in a word. Bytes that are no UTF-8 count as U+FFFD."""
    data, offsets = buffers(texts)
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        data, offsets = buffers(pa.array([x.decode("utf-8", "replace") for x in pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()], pa.large_string()))
        text = data.tobytes().decode()
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n, plain = len(c), len(c) == len(data)
    at = np.arange(n + 1) if plain else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    begins = np.searchsorted(at, offsets[:-1])
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    kind = _classes()[c]
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == 3
    last = np.zeros(n, bool)  # white space right before a character of the same text that is none
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~first[1:]
    start[:n] |= last
    start[np.flatnonzero(last & (c == 32)) + 1] = False  # the blank goes with what follows
    padded = np.concatenate([c, np.zeros(2, np.uint32)])
    ends = np.concatenate([first, np.ones(2, bool)])
    mark = np.flatnonzero((c == 39) & start[:n])
    mark = mark[~ends[mark + 1]]
    x, y = padded[mark + 1], padded[mark + 2]
    one = np.isin(x, [ord(k) for k in "stmd"])
    two = ~ends[mark + 2] & (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
    for which, size in ((mark[one], 2), (mark[two], 3)):
        start[which + 1] = False
        start[which + size] = True
    begin = np.flatnonzero(start[:n])
    w = Words.__new__(Words)
    w.data, w.offsets = data, offsets
    w.start = at[begin]
    w.end = np.append(w.start[1:], len(data)) if len(begin) else w.start
    w.first = np.searchsorted(w.start, offsets)
    return w


def _strings(w: Words, chosen: np.ndarray) -> pa.Array:
    """Some of the words; as they follow each other without gaps, their starts are the offsets of one array."""
    if not len(chosen):
        return pa.array([], pa.large_string())
    offsets = np.append(w.start, len(w.data)).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w.data)))
    return every.take(pa.array(chosen))


def _counted(batches):
    """The distinct words of each piece of a batch that are short enough to fold, with how often they occur."""
    for batch in pieces(batches, most=COUNTED):
        w = cut(batch.column("text"))
        short = np.flatnonzero(w.end - w.start <= FOLD_BYTES)
        _, at, n = np.unique(w.hashes()[short], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([_strings(w, short[at]).cast(pa.string()), pa.array(n)], ["word", "n"])


def fingerprints(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of an array, whole strings."""
    w = Words.__new__(Words)
    w.data, w.offsets = buffers(words)
    w.start, w.end, w.first = w.offsets[:-1], w.offsets[1:], np.arange(len(words) + 1)
    return w.hashes(), w.hashes(1)


class Dictionary:
    """Ids by the fingerprints of words: ``keys`` in order, ``checks`` beside them, ids from ``first`` on in ``ids``."""

    def __init__(self, words: pa.Array, lengths: np.ndarray, ids: np.ndarray):
        keys, checks = fingerprints(words)
        order = np.argsort(keys, kind="stable")
        start = np.cumsum(lengths) - lengths
        to = np.cumsum(lengths[order]) - lengths[order]
        inner = np.arange(len(ids)) - np.repeat(to, lengths[order])
        self.keys, self.checks, self.lengths = keys[order], checks[order], lengths[order].astype(np.uint8)
        self.ids = ids[np.repeat(start[order], lengths[order]) + inner].astype(np.uint16)

    def prepare(self) -> None:
        """What lookups need besides, made once in each worker."""
        if hasattr(self, "bins"):
            return
        self.bits = max(1, len(self.keys)).bit_length()
        n = np.bincount((self.keys >> U(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.bins = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        self.first = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for those that are not in it."""
        self.prepare()
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        box = (h >> U(64 - self.bits)).astype(np.int64)
        at, to = self.bins[box], self.bins[box + 1]
        todo = np.flatnonzero(at < to)
        at, to = at[todo], to[todo]
        while len(todo):
            hit = (self.keys[at] == h[todo]) & (self.checks[at] == check[todo])
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < to)
            todo, at, to = todo[more], at[more], to[more]
        return out


def _lookup(shared, path: str):
    """Batches of (doc_id, text) to (doc_id, none: text is null, ids)."""

    def run(batches):
        book, merges = shared.value
        book.prepare()
        for batch in pieces(batches, most=PIECE):
            w = cut(batch.column("text"))
            first = w.first.astype(np.int64)
            at = book.find(w.hashes(), w.hashes(1))
            known, size = at >= 0, (w.end - w.start).astype(np.int64)
            short, long = np.flatnonzero(~known & (size <= FOLD_BYTES)), np.flatnonzero(~known & (size > FOLD_BYTES))
            n = np.zeros(len(at), np.int64)
            n[known] = book.lengths[at[known]]
            merged, n[short] = merge_words(w.data[_spans(w.start[short].astype(np.int64), size[short])], size[short], merges)
            extra = []
            for i in long.tolist():
                extra.append(merge_long(w.data[w.start[i] : w.end[i]].tobytes(), load_ranks(path)))
                n[i] = len(extra[-1])
            total = np.concatenate([[0], np.cumsum(n)])
            out = np.zeros(total[-1], np.int32)
            out[_spans(total[:-1][known], n[known])] = book.ids[_spans(book.first[at[known]], n[known])]
            out[_spans(total[short], n[short])] = merged
            for i, found in zip(long.tolist(), extra, strict=True):
                out[total[i] : total[i + 1]] = found
            ids = list_array(out, np.diff(total[first]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.is_null(batch.column("text")), ids], ["doc_id", "none", "ids"])

    return run


def _frequent(texts: DataFrame, dictionary: int) -> DataFrame:
    """The words that occur more than once, at most ``dictionary`` of them: the most frequent."""
    counts = texts.where("text is not null").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = shared_table(counts, "words")
    if counts.count() <= dictionary:
        return counts
    by = sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda x: -x["n"])
    total, least = 0, by[0]["n"] + 1
    for x in by:
        if (total := total + x["c"]) > dictionary:
            break
        least = x["n"]
    return counts.where(F.col("n") >= least)


def _folded(words: DataFrame, path: str) -> Dictionary:
    got = words.repartition("word").select("word", fold(F.col("word"), path).alias("ids")).toArrow()
    ids = got.column("ids").combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return Dictionary(got.column("word").cast(pa.large_string()).combine_chunks(), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False))


def encode(docs: DataFrame, path: str = RANKS, dictionary: int = DICTIONARY) -> DataFrame:
    """``(doc_id, token_ids, n_tokens)`` of every row of ``docs``.

    A null text gives null ids, an empty one an empty array. Rows without a doc_id and repeated rows are encoded like any
    other; further columns are not looked at; texts and words can be of any length; an empty table gives an empty one.
    The result doesn't depend on ``dictionary``, the bound of what is broadcast.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    # the literals would be printed in full for each node of each plan, and the driver keeps these records
    spark.conf.set("spark.sql.maxPlanStringLength", "100000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "0")
    texts = docs.select("doc_id", "text")
    words = _frequent(texts.select("text"), dictionary)
    shared = spark.sparkContext.broadcast((_folded(words, path), Merges(path)))
    release(words)
    kind = dict(docs.dtypes)["doc_id"]
    looked = texts.mapInArrow(_lookup(shared, path), f"doc_id {kind}, none boolean, ids array<int>")
    out = looked.select("doc_id", F.when(~F.col("none"), F.col("ids")).alias("token_ids"))
    return out.select("doc_id", "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"))


def decode_bytes(ids: Column, path: str = RANKS) -> Column:
    """The bytes of token ids: the tokens' binary pieces, concatenated. ``array_join`` copies each piece once; Spark has it
    for strings only, so the pieces are cast, which leaves their bytes as they are (as does the cast back)."""
    ranks = load_ranks(path)
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = base64.b64encode(token).decode()
    piece = F.from_json(F.lit(json.dumps(tokens)), "array<binary>").cast("array<string>")  # a literal: Spark reads it when it plans the query
    return F.array_join(F.transform(ids, lambda i: piece[i]), "").cast("binary")


def decode(ids: Column, path: str = RANKS) -> Column:
    """The text of token ids. Bytes that are not UTF-8 are an error, as Spark's ``decode`` has it; null gives null, no ids an empty text."""
    return F.decode(decode_bytes(ids, path), "UTF-8")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents")
    return encode_checked(docs)


def encode_checked(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``encode`` with ``sha``, the SHA-256 of the decoded bytes, which equals that of the text (null for a null text)."""
    out = encode(docs, path)
    return out.withColumn("sha", F.sha2(decode_bytes(F.col("token_ids"), path), 256))


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
