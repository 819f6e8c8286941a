"""Token ids as binary files: texts encoded, written in order of doc_id as Simple-8b segments, and read back.

Encoding calls the tokenizers library on pieces of text and remembers what it said of short ones. A text is cut only where
the library's byte-level splitter always ends a match: between ASCII letters, digits and other printable characters (not
after an apostrophe), before white space that follows one of these or a Latin letter, and around a lone line feed between
two of them. A piece then has the same ids by itself as in its text. Remembered pieces are compared by all their bytes.

Rows are dealt to files by ranges of doc_id, so a file holds a stretch of the order; a text's ids travel once, as two
bytes each, and no list of ids meets in one task. Files are written and read by Spark's own text and binary sources, so they
may lie in any store that Spark reaches; a task that is lost is done again.

Defined results: a null text is empty and has the end id alone; rows without doc_id come last; rows with one doc_id follow
each other by what is in them, repeated rows each count; an empty table gives no rows; other columns are not read. A text and
its ids pass through one worker whole: about ten bytes for each byte of a text.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import simple8b
from docloom.llm._spark import scratch_dir, written

#: Bytes of input for one file of ids, and ids of a segment (more, if one text has more).
FILE_BYTES = 16 << 20
SEGMENT = 1 << 18
#: Distinct pieces that a worker remembers (about 50 bytes each), and the longest of them in bytes.
REMEMBERED = 3_000_000
PIECE = 24
_BATCH = 2 << 20

# Classes of bytes: letter, digit, other printable, apostrophe, space, line feed, anything else.
_L, _D, _P, _Q, _S, _N, _X = range(7)
_CLASS = np.full(256, _X, np.uint8)
_CLASS[33:127] = _P
_CLASS[48:58] = _D
_CLASS[65:91] = _CLASS[97:123] = _L
_CLASS[39], _CLASS[32], _CLASS[10] = _Q, _S, _N
_SOLID = np.array([True, True, True, True, False, False, False])
#: _ENDS[before, at]: a match always ends between two bytes of these classes.
_ENDS = np.zeros((7, 7), bool)
for _a in (_L, _D, _P):
    for _b in (_L, _D, _P):
        _ENDS[_a, _b] = _a != _b
_ENDS[_L, _Q] = _ENDS[_D, _Q] = True
_ENDS[np.ix_([_L, _D, _P, _Q], [_S, _N])] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def pieces(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces of UTF-8 bytes begin; rows: where the texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    lead = lead[(data[lead] != 0xC3) | (data[lead + 1] & 0xDF != 0x97)]  # the signs of times and division are no letters
    kind[lead] = kind[lead + 1] = _L
    cut = np.zeros(len(data), bool)
    cut[1:] = _ENDS[kind[:-1], kind[1:]]
    feed = np.flatnonzero(kind[1:-1] == _N) + 1  # a lone line feed is a match of its own
    feed = feed[_SOLID[kind[feed - 1]] & _SOLID[kind[feed + 1]]]
    cut[feed + 1] = True
    cut[rows[rows < len(data)]] = True
    cut[0] = True
    return np.flatnonzero(cut)


class Encoder:
    """The library's ids of whole texts, by pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self._forget()

    def width(self, end: int) -> type:
        """Of an id on its way to a file: of the library's and of the end id."""
        return np.uint16 if max(self.library.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.keys = np.zeros((0, PIECE // 8), np.uint64)
        self._slot = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.known = np.zeros(0, np.uint32)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and how many each has. data: their bytes; rows: where each begins, and the end of the last."""
        begin = pieces(data, rows)
        raw = data.tobytes()
        whole = [k for k in range(len(rows) - 1) if any(s in raw[rows[k] : rows[k + 1]] for s in self.special)] if any(s in raw for s in self.special) else []
        for k in whole:  # the library looks for its special tokens first: such a text is one piece
            begin = begin[(begin <= rows[k]) | (begin >= rows[k + 1])]
        size = np.diff(np.append(begin, len(data)))
        short = np.flatnonzero(size <= PIECE)
        key = np.zeros((len(short), PIECE), np.uint8)
        padded = np.concatenate([data, np.zeros(PIECE, np.uint8)])
        for k in range(PIECE):
            some = np.flatnonzero(size[short] > k) if k else np.arange(len(short))
            if not len(some):
                break
            key[some, k] = padded[begin[short[some]] + k]
        key = key.view(np.uint64)
        hashed = (key * _MIX).sum(1, dtype=np.uint64) + size[short].astype(np.uint64)
        hashed ^= hashed >> np.uint64(29)
        order = np.argsort(hashed, kind="stable")
        new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]]) if len(order) else np.zeros(0, bool)
        one, group = order[new], np.zeros(len(short), np.int64)
        group[order] = np.cumsum(new) - 1
        twin = (key == key[one][group]).all(1) & (size[short] == size[short[one]][group])  # else its hash is that of another piece
        place = self._recall(hashed[one], key[one], size[short[one]], raw, begin[short[one]])
        count = np.zeros(len(begin), np.int64)
        source = np.zeros(len(begin), np.int64)
        at = place[group]
        count[short], source[short] = self.begin[at + 1] - self.begin[at], self.begin[at]
        alone = np.concatenate([np.flatnonzero(size > PIECE), short[~twin]])
        said = self._ask([raw[begin[k] : begin[k] + size[k]].decode() for k in alone])
        extra = [np.array(x, np.uint32) for x in said]
        pool = np.concatenate([self.known, *extra])
        count[alone] = [len(x) for x in extra]
        source[alone] = len(self.known) + np.cumsum(count[alone]) - count[alone]
        ends = np.cumsum(count)
        ids = pool[np.repeat(source - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[np.searchsorted(begin, rows)])

    def _recall(self, hashed: np.ndarray, key: np.ndarray, size: np.ndarray, raw: bytes, begin: np.ndarray) -> np.ndarray:
        """The place of each piece (distinct, by rising hash) among the remembered ones; new ones are asked for."""
        if len(self.hashes) + len(hashed) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashed), max(len(self.hashes) - 1, 0))
        found = (self.hashes[at] == hashed) if len(self.hashes) else np.zeros(len(hashed), bool)
        if len(self.hashes):
            clash = found & (self.keys[at] != key).any(1)
            if clash.any():  # two pieces of one hash: begin anew, as this batch has no two
                self._forget()
                return self._recall(hashed, key, size, raw, begin)
        new = np.flatnonzero(~found)
        said = self._ask([raw[b : b + s].decode() for b, s in zip(begin[new].tolist(), size[new].tolist(), strict=True)])
        first = len(self.begin) - 1
        counts = np.fromiter((len(x) for x in said), np.int64, len(said))
        fresh = np.fromiter((i for x in said for i in x), np.uint32, int(counts.sum()))
        # the ids of pieces lie in order of asking, their hashes in order of value
        place = np.where(found, self._slot[at], 0) if len(self.hashes) else np.zeros(len(hashed), np.int64)
        place[new] = first + np.arange(len(new))
        self.known = np.concatenate([self.known, fresh])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        into = np.searchsorted(self.hashes, hashed[new])
        self._slot = np.insert(self._slot, into, place[new])
        self.keys = np.insert(self.keys, into, key[new], axis=0)
        self.hashes = np.insert(self.hashes, into, hashed[new])
        return place


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, with what it remembers of earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _parted(keys: pa.Array, bounds: np.ndarray, unnamed: int, texts: list[bytes]) -> Iterator[int]:
    """The file of each row: by doc_id between the bounds; a value that fills several files, and rows without doc_id, are
    dealt over theirs by what they hold. Numbers go up with (doc_id, check sum)."""
    for key, text in zip(keys.to_pylist(), texts, strict=True):
        share = zlib.crc32(text) / 2**32
        if key is None:
            yield len(bounds) + 1 + int(share * unnamed)
        else:
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            yield int(low) if low == high else int(low + share * (high - low + 1))


def encoded(docs: DataFrame, path: str, end: int, bounds: list[int], unnamed: int) -> DataFrame:
    """part, doc_id, tie (equal doc_ids follow it) and ids, two or four bytes each, with the end id. bounds: upper ends of all
    ranges of doc_id but the last; unnamed: files for rows without doc_id."""
    limits = np.array(bounds, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        width = own.width(end)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= _BATCH):
                    size += len(texts[upto])
                    upto += 1
                some, keys = texts[at:upto], batch.column(0)[at:upto]
                rows = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
                ids, counts = own.encode(np.frombuffer(b"".join(some), np.uint8), rows)
                held, ends = np.insert(ids.astype(width), np.cumsum(counts), end), np.cumsum(counts + 1)
                packed = [held[a:b].tobytes() for a, b in zip(ends - counts - 1, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_parted(keys, limits, unnamed, some), pa.int32()), keys.cast(pa.int64()), pa.array([zlib.crc32(t) for t in some], pa.int64()), pa.array(packed, pa.binary())],
                    names=["part", "doc_id", "tie", "ids"],
                )
                at = upto

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, doc_id long, tie long, ids binary")


def _bounds(docs: DataFrame, file_bytes: int) -> tuple[list[int], int]:
    """Ends of the ranges of doc_id, and how many files rows without one get. They change how rows are dealt, never what
    comes out. The number of files follows the input's size as the plan knows it, or else the texts' own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = min(max(-(-size // file_bytes), 4 * docs.sparkSession.sparkContext.defaultParallelism), 1 << 16)
    shares = F.array(*(F.lit(k / files) for k in range(1, files)))
    ends, rows, named = docs.agg(F.percentile_approx("doc_id", shares, F.lit(10_000)), F.count("*"), F.count("doc_id")).first()
    return ends or [], -(-files * (rows - named) // max(rows, 1))


def write(docs: DataFrame, path: str, out: str, end: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Files of segments in the folder `out`, in ascending doc_id order by (file, segment) as their heads number them."""
    bounds, unnamed = _bounds(docs, file_bytes)
    rows = encoded(docs, path, end, bounds, unnamed)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, lengths, held, total, number = None, [], [], [], 0, 0
        kind = encoder(path).width(end)

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([simple8b.segment(keys, np.array(lengths), np.concatenate(held), part, number)], pa.binary())], names=["value"])

        for batch in batches:
            for p, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if keys and (p != part or total >= SEGMENT):
                    yield cut()
                    number = number + 1 if p == part else 0
                    keys, lengths, held, total = [], [], [], 0
                part = p
                held.append(np.frombuffer(ids.as_buffer(), kind))
                keys.append(key)
                lengths.append(len(held[-1]))
                total += lengths[-1]
        if keys:
            yield cut()

    dealt = rows.repartitionById(len(bounds) + 1 + unnamed, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "tie", "ids")
    packed = dealt.select("part", "doc_id", "ids").mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", simple8b.END).text(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """part, number, row (place in the segment), doc_id, n_tokens and ids_crc32 of every document in the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in simple8b.segments(content.as_buffer()):
                    ids = found.ids().astype("<u4")
                    ends = np.cumsum(found.lengths)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - found.lengths, ends, strict=True)]
                    n = len(found.keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([found.part] * n, pa.int64()), pa.array([found.number] * n, pa.int64()), pa.array(ends - found.lengths), pa.array(found.keys, pa.int64()), pa.array(found.lengths), pa.array(crc, pa.int64())],
                        names=["part", "number", "row", "doc_id", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    return files.select("content").mapInArrow(run, "part long, number long, row long, doc_id long, n_tokens long, ids_crc32 long")


def table(docs: DataFrame, path: str, end: int = 0, out: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `docs` (doc_id, text) as files of ids and return what the files hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    out = out or f"{scratch_dir(spark)}/docloom-ids-{uuid.uuid4().hex}"
    write(docs, path, out, end, file_bytes)
    rows = written(read(spark, out), "ids-read")
    # one row a segment, of at least 2^18 ids unless it ends a file: sums of the files first, then of a file's segments
    sums = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    bases = sums.select("part", "number", before.alias("before")).join(earlier, "part")
    placed = rows.join(bases, ["part", "number"])
    return placed.select("doc_id", (F.col("earlier") + F.col("before") + F.col("row")).alias("start"), "n_tokens", "ids_crc32")
