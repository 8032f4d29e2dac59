"""Vectorised word scanning of Arrow text columns.

A word is a maximal run of characters outside ``\\x20`` and ``\\x09-\\x0D``.
All functions work on raw UTF-8 bytes in blocks of a bounded size, so the
memory of a task does not grow with its partition, only with its longest text.
Hashes depend on the bytes alone: every executor and every run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_SEGMENT = 1 << 15

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers of a seed."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.full(n, seed, np.uint64) * np.uint64(0xD1342543DE82EF95))


_BYTE = stream(11, 256)
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, n of each at least."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(int(base), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return known


class Text:
    """The words of the documents of one block.

    data: bytes; docs: byte offsets of documents (n + 1); start, end: byte
    offsets of words; first: index of each document's first word (n + 1).
    """

    def __init__(self, data: np.ndarray, docs: np.ndarray):
        self.data, self.docs, n = data, docs, len(data)
        word = ~IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[docs] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.word = word
        self.first = np.searchsorted(self.start, docs)

    @property
    def n(self) -> int:
        return len(self.docs) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document of a value per byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.docs[1:]] - total[self.docs[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out, k = np.empty(len(self.start), np.uint64), 0
        while k < len(out):
            at = self.start[k]
            stop = max(k + 1, int(np.searchsorted(self.end, at + _SEGMENT, "right")))
            end = self.end[stop - 1]
            up, down = _tables(_BASE, max(_SEGMENT, int(end - at)) + 1)
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(_BYTE[self.data[at:end]] * up[: end - at], out=sums[1:])
            a, b = self.start[k:stop] - at, self.end[k:stop] - at
            out[k:stop] = (sums[b] - sums[a]) * down[a]
            k = stop
        return mix64(out)


def windows(h: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words that lie in one document, and each one's first word.

    h: word hashes; first: index of each document's first word (n + 1).
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, base = np.empty(n, np.uint64), stream(101 + seed, 1)[0] | np.uint64(1)
    step = _SEGMENT >> 1
    up, down = _tables(base, step + size)
    sums = np.zeros(step + size, np.uint64)
    for a in range(0, n, step):  # sums of powers from the segment's first word, so a run is a difference of two
        b = min(n, a + step)
        m = b - a + size - 1
        np.cumsum(h[a : b + size - 1] * down[:m], out=sums[1 : m + 1])
        out[a:b] = (sums[size : m + 1] - sums[: m + 1 - size]) * up[size - 1 : size - 1 + b - a]
    inside = np.ones(n, bool)
    for j in range(1, size):
        cut = first[1:-1] - j
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return mix64(out[at]), at


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with repeats, and offsets by document (n + 1).

    A document of 1 to size - 1 words has one shingle: all its words.
    """
    w, at = windows(h, first, size)
    doc = np.searchsorted(first, at, "right") - 1
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short.tolist()):
            value = np.full(1, counts[d], np.uint64)
            for j in range(first[d], first[d + 1]):
                value = mix64(value + h[j : j + 1])
            extra[k] = value[0]
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        w, doc = np.concatenate([w, extra])[order], doc[order]
    return w, np.searchsorted(doc, np.arange(len(first)))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Slices of the batches with at most limit bytes of text (one document at least), and their words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_column(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), Text(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b
