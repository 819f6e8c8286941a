"""Language-model scoring from a log-frequency Bloom filter.

Texts become runs of local token numbers once (chunks, written to the shared folder); everything later works on those.
Chunks send their counts of words and word pairs by hash segment. Each segment's reducer sums them and fills its part of
the filter: an n-gram of count c is entered for the levels 1..1+floor(log2 c), so that probing level after level until
one misses reads the quantised count back. It answers every chunk with the exact counts of its words and with the levels
that the filter gives for its words and pairs, those of held-out texts too.

A segment's part has `ENTRY_BITS` bits for each level of each n-gram counted in it, so the filter grows with the corpus
and no n-gram stays out of it. It is probed where it was filled, segment by segment; nothing of it is broadcast or sent
to the driver, and segments are added as the corpus grows.

A token's probability is `MIX` * c(v w) / c(v) + (1 - MIX) * (c(w) + 0.1) / (N + 0.1 (V + 1)), c quantised, the end of
the text standing before its first word too; a pair's count is at most its words', so after a word that is not seen only
the second part counts. The quantisation is at most a factor of 1.42 off a count, so the probabilities of all words after
one sum to 1 within about that factor, not exactly.

Defined results: a null or empty text is its end token alone; rows with a null doc_id count as held out (checksum of an
empty string); repeated rows train and are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import Hasher, mix, pieces
from docloom.llm._spark import written

#: Bits of the filter for each level of each n-gram: an unseen one is taken for seen with a chance of 0.24 %.
ENTRY_BITS = 16
SEGMENT_BITS = 6
PROBES = 4
MIX = 0.6
CHUNK_TEXT = 4 << 20
END = np.uint64(0x5851F42D4C957F2D)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR_BITS = 40


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(raw)))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """40-bit keys of word pairs."""
    return mix(before * _ODD + word) >> np.uint64(64 - _PAIR_BITS)


def _tokenize(chunk_text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        held: list[tuple] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            hashes, ends, ids, known_id, held_out = zip(*held)
            words = np.concatenate(hashes)
            uniq, local = np.unique(words, return_inverse=True)
            lengths = np.concatenate(ends)
            blob = _save(uniq=uniq, local=local.astype(np.int32), lengths=lengths, ids=np.concatenate(ids), known=np.concatenate(known_id), held=np.concatenate(held_out))
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + made], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for part, t in pieces(batches, "text"):
            t = t.lower()
            starts, ends = t.words()
            h = Hasher(t.data)(starts, ends)
            count = np.bincount(t.doc_of(starts), minlength=t.n)
            after = np.cumsum(count)
            tokens = np.insert(h, after, END)
            ids = part.column(0)
            held.append((tokens, count + 1, pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False).astype(bool)))
            size += len(t.data) + 8 * t.n
            if size > chunk_text:
                yield flush()
                held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return run


def _pairs(blob: dict[str, np.ndarray]) -> np.ndarray:
    """The key of each token with the one before it; the first of a text follows an end."""
    words = blob["uniq"][blob["local"]]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[:1] = END
    return pair_keys(before, words)


def _trained(blob: dict[str, np.ndarray]) -> np.ndarray:
    return np.repeat(~blob["held"], blob["lengths"])


def _send(cut_bits: int):
    """A chunk's words and pairs, by segment, with their local counts in training (0 if held out only); pairs as 32-bit
    steps from the first, which holds since segments of 2**cut_bits leave a pair's key 40 - cut_bits bits or are parted
    further. `at` orders a chunk's rows of one kind: the segment, or the first pair."""
    part_bits = max(cut_bits, _PAIR_BITS - 32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                blob = _load(raw.as_py())
                train = _trained(blob)
                uniq, n = blob["uniq"], np.bincount(blob["local"][train], minlength=len(blob["uniq"])).astype(np.uint32)
                pairs, which = np.unique(_pairs(blob), return_inverse=True)
                m = np.bincount(which[train], minlength=len(pairs))
                rows: list[tuple] = []
                bounds = np.searchsorted(uniq >> np.uint64(64 - cut_bits), np.arange((1 << cut_bits) + 1))
                for s in range(1 << cut_bits):
                    a, b = bounds[s], bounds[s + 1]
                    if b > a:  # so there are never more rows than n-grams
                        rows.append((s, chunk, 1, s, uniq[a:b].tobytes(), n[a:b].tobytes()))
                cuts = np.searchsorted(pairs >> np.uint64(_PAIR_BITS - part_bits), np.arange((1 << part_bits) + 1))
                for s in range(1 << part_bits):
                    a, b = cuts[s], cuts[s + 1]
                    if b > a:
                        step = np.diff(pairs[a:b], prepend=pairs[a]).astype(np.uint32)
                        rows.append((s >> (part_bits - cut_bits), chunk, 2, int(pairs[a]), step.tobytes(), m[a:b].astype(np.uint32).tobytes()))
                seg, who, kind, at, keys, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), pa.array(who, pa.int64()), pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["seg", "who", "kind", "at", "keys", "counts"])

    return run


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(count)).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range."""
    return np.where(level <= 1, level, 2.0 ** (level - 1) * 1.4)


def _bit(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    return mix(keys * _ODD + np.uint64(level * 64 + probe)) % np.uint64(bits)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def size_of(*grams: tuple[np.ndarray, np.ndarray]) -> int:
    """Bits of a segment's filter, from the levels of what it has to hold."""
    entries = sum(int(levels(counts[counts > 0]).sum()) for _, counts in grams)
    return max(64, entries * ENTRY_BITS)


def fill(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """One segment's bits, with every level of every n-gram counted."""
    out = np.zeros(bits, bool)
    for keys, counts in (words, pairs):
        seen = counts > 0
        keys, q = keys[seen], levels(counts[seen])
        for level in range(1, int(q.max(initial=0)) + 1):
            keys, q = keys[q >= level], q[q >= level]
            for p in range(PROBES):
                out[_bit(keys, level, p, bits).astype(np.int64)] = True
    return out


class Filter:
    """A filter of 2**cut_bits segments; counts are read back by probing level after level."""

    def __init__(self, packed: np.ndarray, bits: int, cut_bits: int):
        self.packed, self.bits, self.cut_bits = packed, bits, cut_bits

    def level(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        at = 1
        while len(live) and at < 64:
            for p in range(PROBES):
                place = segment[live].astype(np.int64) * self.bits + _bit(keys[live], at, p, self.bits).astype(np.int64)
                live = live[(self.packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
            out[live] = at
            at += 1
        return out


def _reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment: the segment's N and V (kind 0), and answers to the chunks' words (kind 1: exact counts,
    and levels) and pairs (kind 2: levels)."""
    rows: list[tuple] = []
    seg = None

    def close() -> pa.RecordBatch:
        asked = [(who, at, np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32)) for who, kind, at, k, c in rows if kind == 1]
        keys, counts = _sum(np.concatenate([a[2] for a in asked]), np.concatenate([a[3] for a in asked]))
        said = [(who, at, np.uint64(at) + np.cumsum(np.frombuffer(k, np.uint32).astype(np.uint64)), np.frombuffer(c, np.uint32)) for who, kind, at, k, c in rows if kind == 2]
        two, times = _sum(np.concatenate([a[2] for a in said]), np.concatenate([a[3] for a in said])) if said else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        marked = two | np.uint64(1 << 63)
        bits = size_of((keys, counts), (marked, times))
        model = Filter(np.packbits(fill((keys, counts), (marked, times), bits)), bits, 0)
        alone, joint = (model.level(k, np.zeros(len(k), np.uint64)).astype(np.uint8) for k in (keys, marked))
        out = [(0, seg, seg, b"", b"", int(counts.sum()), int((counts > 0).sum()))]
        for who, at, k, _ in asked:
            place = np.searchsorted(keys, k)
            out.append((1, who, at, counts[place].tobytes(), alone[place].tobytes(), 0, 0))
        out += [(2, who, at, b"", joint[np.searchsorted(two, k)].tobytes(), 0, 0) for who, at, k, _ in said]
        cols = list(zip(*out))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "chunk", "at", "body", "levels", "n", "v"])

    for batch in batches:
        for s, who, kind, at, k, c in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if s != seg and rows:
                yield close()
                rows = []
            seg = s
            rows.append((who, kind, at, k, c))
    if rows:
        yield close()


def _score(total: int, distinct: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORED.empty_table()
        blob = _load(left.column("blob")[0].as_py())
        kind = right.column("kind").to_numpy()
        order = np.lexsort((right.column("at").to_numpy(), kind))
        bodies, said = right.column("body").to_pylist(), right.column("levels").to_pylist()
        counts = np.concatenate([np.frombuffer(bodies[k], np.int64) for k in order if kind[k] == 1])
        read = [level_count(np.concatenate([np.frombuffer(said[k], np.uint8) for k in order if kind[k] == x]).astype(np.int64)) for x in (1, 2)]
        local, lengths = blob["local"], blob["lengths"]
        below = total + 0.1 * (distinct + 1)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((counts + 0.1) / below)[local]
        alone = read[0]
        joint = read[1][np.unique(_pairs(blob), return_inverse=True)[1]]
        before = np.empty(len(local))
        end = np.searchsorted(blob["uniq"], END)
        before[1:], before[:1] = alone[local[:-1]], alone[end]
        # a pair is not seen more often than either of its words, and not at all after a word that is not seen
        follows = np.minimum(np.minimum(joint, alone[local]), before) / np.maximum(before, 1.0)
        p = MIX * follows + (1 - MIX) * (alone[local] + 0.1) / below
        n = len(lengths)
        made = {
            "doc_id": pa.array(blob["ids"], mask=~blob["known"]),
            "held_out": pa.array(blob["held"]),
            "n_tokens": pa.array(lengths.astype(np.int64)),
            "n_known": pa.array(np.bincount(owner[counts[local] > 0], minlength=n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(np.bincount(owner, weights=base, minlength=n)),
            "score": pa.array(np.bincount(owner, weights=np.log10(p), minlength=n)),
        }
        return pa.table(made).cast(_SCORED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, *, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    chunks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text").mapInArrow(_tokenize(chunk_text), "chunk long, blob binary"), "chunks")
    # about 16 chunks' counts to a segment, so that a reducer's memory does not grow with the corpus
    cut_bits = min(24, max(SEGMENT_BITS, (chunks.count() >> 4).bit_length()))
    sent = chunks.mapInArrow(_send(cut_bits), "seg int, who long, kind int, at long, keys binary, counts binary")
    dealt = sent.repartition(1 << cut_bits, "seg").sortWithinPartitions("seg", "kind", "who")
    solved = written(dealt.mapInArrow(_reduce, "kind int, chunk long, at long, body binary, levels binary, n long, v long"), "counts")
    total, distinct = (x or 0 for x in solved.filter("kind = 0").agg(F.sum("n"), F.sum("v")).first())
    answers = solved.filter("kind > 0").select("chunk", "kind", "at", "body", "levels")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(total, distinct), kinds)
