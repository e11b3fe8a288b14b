"""Words of a whole Arrow batch as numpy arrays.

The operators that hash every word of the corpus work on a batch's UTF-8 buffer at once, without a Python loop over
words. A word is a maximal run of letters and digits after lower-casing: ASCII letters and digits and every character
from U+00C0 on, without the punctuation and symbol blocks U+2000-U+2FFF and U+3000-U+303F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], U)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (one more than documents) of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """``start``, ``end``: byte ranges in ``data`` (lower case); ``first``: each document's first word, and the number of words at the end."""

    def __init__(self, texts: pa.Array):
        data, offsets = buffers(pc.utf8_lower(texts))
        n = len(data)
        self.data, self.offsets = data, offsets
        word = _WORD[data]
        for lead, more, ok in ((0xC2, 1, None), (0xE2, 2, None), (0xE3, 2, 0x80)):
            at = np.flatnonzero(data == lead)
            if ok is not None:
                at = at[data[at + 1] == ok]
            for j in range(more + 1):
                word[at + j] = False
        inner = offsets[1:-1]
        inner = inner[inner < n]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[inner] = False
        after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes a step."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        length = self.end - self.start
        h = mix(length.astype(U) * U(0x9E3779B97F4A7C15) + U((seed * 0xD1B54A32D192ED03 + 1) % 2**64))
        at, left, todo = self.start, length, None
        while len(at):
            v = eight[at] & _MASK[np.minimum(left, 8)]
            if todo is None:
                h = mix(h ^ (v * U(0x9E3779B97F4A7C15)))
            else:
                h[todo] = mix(h[todo] ^ (v * U(0x9E3779B97F4A7C15)))
            more = np.flatnonzero(left > 8)
            todo = more if todo is None else todo[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` items; ``len(h) - k + 1`` of them, also across documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = np.zeros(n, U)
    for j in range(k):
        g = g * U(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(g)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` runs of ``k`` words stay in one document."""
    ok = np.ones(max(n, 0), bool)
    ends = first[1:-1]
    for j in range(1, k):
        at = ends - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours; ``len(v) - w + 1`` of them."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    span, m = 1, v
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[w - span : w - span + n])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most`` bytes of text (or one document), which bounds a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
