"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, lines and their 64-bit hashes, without Python strings.

Hashes are polynomials over a fixed random byte table modulo 2**64, finished with a mixer. Equal byte strings have
equal hashes on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Hasher:
    """Hash of any byte range of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Texts:
    """The bytes of consecutive documents: data, and starts[i]:ends[i] of document i."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self.n = len(starts)
        self.full = np.flatnonzero(ends > starts)

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, "right") - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.starts, self.ends)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes within a document."""
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[self.starts[self.full]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[self.ends[self.full] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes other than space and \\t-\\r."""
        return self.runs(~WHITE[self.data])

    def count(self, marked: np.ndarray) -> np.ndarray:
        """Marked bytes of each document."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[self.ends] - sums[self.starts]


def texts_of(column: pa.Array) -> Texts:
    """A null text counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    return Texts(data, at[:-1], at[1:])


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches of about `most` bytes of text (a longer text stands alone), with their bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(lengths)
        lo = 0
        while lo < batch.num_rows:
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + most, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, texts_of(part.column(k))
            lo = hi


def grams(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and the index of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[: len(docs) - n + 1] == docs[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + words[at + k]
    return mix(h), at


def per_doc_sum(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, weights=values, minlength=n) if len(docs) else np.zeros(n)
