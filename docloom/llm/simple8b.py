"""Simple-8b: ids packed into 64-bit words, and segments of such words with their documents.

A word's upper four bits select how many ids of how many bits its lower sixty hold (`COUNT`, `BITS`); selector 1 is a run of
zeros, selector 0 an escape: its word holds the place of an id of more than sixty bits in the segment's list of such ids. Ids
are cut into blocks of `BLOCK`, each of which begins with a word of its own, so blocks are packed side by side, unpacked side
by side, and one range of ids is read without what stands before it.

A segment is a run of little-endian 64-bit words: magic, place (file number, number in the file), the counts of documents,
ids, words and escapes, ids a block; then each document's id, its number of ids (upper bit: the id is null), each block's
first word (upper half: its first escape), the words, the escapes, and `END`. Segments stand one after another in a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 512
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = int.from_bytes(b"S8BTOK01", "little")
END = "\nS8BEND\n"
_HEAD = 8
_NULL = np.uint64(1 << 63)
_LARGEST = np.array([(1 << int(b)) - 1 for b in BITS[1:]], np.uint64)
_SMALL = (np.searchsorted(_LARGEST, np.arange(1 << 16, dtype=np.uint64)) + 1).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and each block's first word and escape. A word takes as many ids as the widest of them lets it."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    wide = np.zeros((blocks, BLOCK + int(COUNT.max())), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[: len(ids)] = ids
    wide[:, :BLOCK] = full.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = len(ids) - (blocks - 1) * BLOCK
    need = _SMALL[np.minimum(wide, len(_SMALL) - 1).astype(np.int32)]  # the narrowest selector that holds the id; 16: an escape
    large = wide >= len(_SMALL)
    if large.any():
        need[large] = np.searchsorted(_LARGEST, wide[large]) + 1
    best = np.zeros((blocks, BLOCK), np.uint8)
    widest, reach = need, 1  # of the next `reach` ids: a window is two that overlap
    for selector in range(len(COUNT) - 1, 0, -1):
        while reach < COUNT[selector]:
            step = min(reach, int(COUNT[selector]) - reach)
            widest = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            reach += step
        np.copyto(best, selector, where=widest[:, :BLOCK] <= selector)
    at, live, rows, places, chosen = np.zeros(blocks, np.int64), np.arange(blocks), [], [], []
    while len(live):
        own = best[live, at[live]]
        rows.append(live)
        places.append(at[live])
        chosen.append(own)
        at[live] += COUNT[own]
        live = live[at[live] < length[live]]
    rows, places, chosen = np.concatenate(rows), np.concatenate(places), np.concatenate(chosen)
    order = np.argsort(rows, kind="stable")
    rows, places, chosen = rows[order], places[order], chosen[order].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat = wide.ravel()
    places += rows * wide.shape[1]
    for selector in np.unique(chosen[chosen > 1]):
        some = np.flatnonzero(chosen == selector)
        value, begin = words[some], places[some]
        for k in range(COUNT[selector]):
            value |= flat[begin + k] << np.uint64(k * BITS[selector])
        words[some] = value
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    escapes = flat[places[escaped]]
    first = np.searchsorted(rows, np.arange(blocks)).astype(np.uint64)
    starts = first | np.searchsorted(rows[escaped], np.arange(blocks)).astype(np.uint64) << np.uint64(32)
    return words, escapes, starts


def unpack(words: np.ndarray, escapes: np.ndarray, starts: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from `first` up to `last` (all) of the n that were packed; only the blocks that hold them are looked at."""
    last = n if last is None else min(last, n)
    if last <= first:
        return np.zeros(0, np.uint64)
    low, high = first // BLOCK, -(-last // BLOCK)
    begin = (starts & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.append(begin[1:], len(words))
    own = words[begin[low] : ends[high - 1]]
    selector = (own >> np.uint64(60)).astype(np.int64)
    counts = COUNT[selector]
    block = np.repeat(np.arange(high - low), ends[low:high] - begin[low:high])
    before = np.cumsum(counts) - counts
    inside = before - before[begin[low:high] - begin[low]][block]
    out = np.zeros((high - low) * BLOCK, np.uint64)
    place = block * BLOCK + inside
    left = BLOCK - inside  # a block's last word may have room for more
    for s in np.unique(selector):
        some = np.flatnonzero(selector == s)
        if s == 0:
            out[place[some]] = escapes[(own[some] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif s > 1:
            for k in range(COUNT[s]):
                held = some if s == len(COUNT) - 1 else some[left[some] > k]
                out[place[held] + k] = own[held] >> np.uint64(k * BITS[s]) & _LARGEST[s - 1]
    return out[first - low * BLOCK : last - low * BLOCK]


def segment(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, part: int = 0, number: int = 0) -> bytes:
    """The bytes of a segment, without END."""
    words, escapes, starts = pack(ids)
    if len(words) >> 32:
        raise ValueError("a segment holds fewer than 2^32 words")
    head = np.array([MAGIC, part, number, len(keys), len(ids), len(words), len(escapes), BLOCK], np.uint64)
    known = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    sizes = np.asarray(lengths, np.uint64) | np.where([k is None for k in keys], _NULL, np.uint64(0)) if len(keys) else np.zeros(0, np.uint64)
    return np.concatenate([head, known, sizes, starts, words, escapes]).astype("<u8").tobytes()


class Segment:
    """A segment as read: keys, lengths and, on demand, ids."""

    def __init__(self, data: np.ndarray):
        magic, self.part, self.number, docs, self.n, words, escapes, block = (int(x) for x in data[:_HEAD])
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a segment of ids")
        blocks, at = -(-self.n // BLOCK), _HEAD
        self._cut = []
        for size in (docs, docs, blocks, words, escapes):
            self._cut.append(data[at : at + size])
            at += size
        self.size = at + 1  # END is one word
        if len(data) < self.size or data[at] != np.frombuffer(END.encode(), "<u8")[0]:
            raise ValueError("a segment is cut off")
        keys, sizes = self._cut[:2]
        self.keys = [None if null else int(k) for k, null in zip(keys.view(np.int64), sizes & _NULL, strict=True)]
        self.lengths = (sizes & ~_NULL).astype(np.int64)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        starts, words, escapes = self._cut[2:]
        return unpack(words, escapes, starts, self.n, first, last)


def segments(content: bytes) -> Iterator[Segment]:
    """The segments of a file, in its order."""
    data = np.frombuffer(content, "<u8")
    while len(data):
        found = Segment(data)
        yield found
        data = data[found.size :]
