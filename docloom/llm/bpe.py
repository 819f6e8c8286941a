"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table holds the one token that its encoding ends with. A token ending at a prefix
is the right one if the encoding of what precedes it stays the encoding when the token is appended, which depends on
the two neighbouring tokens alone. So bytes can be appended exactly, and an edit re-encodes only until the table meets
its old values again.

Defined results: a null or empty text has no tokens; lone surrogates cannot occur in Arrow strings; ties cannot occur
since the last token is unique; repeated rows are encoded each; an empty table gives no rows; further columns of the
input are ignored except those named in `keep`. Vocabulary files are read on the driver and broadcast (their size is
fixed by the tokenizer).
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import Hasher, Texts, pieces, texts_of

#: Pieces whose encodings a worker remembers; the table is dropped when full, so its memory stays bounded.
REMEMBERED = 800_000
#: Pairs of tokens whose verdicts a worker remembers, about 130 bytes each; bounded likewise.
JUDGED = 500_000
#: Fixed value: the pattern whose matches `cuts` finds on whole buffers; any other goes through the matcher itself.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The code points with the Unicode property White_Space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@cache
def _kinds() -> np.ndarray:
    """Letter, number, white space or other, by code point, as tiktoken's own matcher has them: asked through a vocabulary
    of single bytes, which keeps what a class matches and drops the rest. Other libraries have other Unicode versions."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N")):
        asked = tiktoken.Encoding(f"class {name}", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        table[list(map(ord, asked.decode(asked.encode_ordinary(every))))] = kind
    table[_SPACES] = _SPACE
    return table


def cuts(t: Texts) -> np.ndarray:
    """Starts of the matches of PATTERN, which part the texts without gaps."""
    data, n = t.data, len(t.data)
    if not n:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # a character each
    first = data[lead].astype(np.int32)
    point, padded = first.copy(), np.concatenate([data, np.zeros(3, np.uint8)])
    for low, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero(first >= low)  # a longer form replaces what the shorter one gave
        value = first[at] & bits
        for k in range(1, more + 1):
            value = (value << 6) | (padded[lead[at] + k] & 0x3F)
        point[at] = value
    kind = _kinds()[point]
    m = len(lead)
    opens = np.zeros(m + 1, bool)  # characters that begin a text
    opens[np.searchsorted(lead, t.starts[t.full])] = True
    opens[m] = True
    run = opens.copy()
    run[1:m] |= kind[1:] != kind[:-1]
    begins = run.copy()
    space = kind == _SPACE
    blank = point == 32
    # a white run before other text gives its last character away; a blank goes to that text
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:m])
    begins[last] = True
    begins[last[blank[last]] + 1] = False
    # an apostrophe alone, without a blank before it, takes one or two letters of those after it
    quote = np.flatnonzero((point[:-1] == 39) & run[:-2] & run[1:-1] & ~opens[1:m] & begins[:-2])
    after = point[quote + 1]
    second = np.where(quote + 2 < m, point[np.minimum(quote + 2, m - 1)], 0)
    second[opens[np.minimum(quote + 2, m)]] = 0
    one = np.isin(after, [ord(c) for c in "stmd"])
    two = np.zeros(len(quote), bool)
    for pair in ("re", "ve", "ll"):
        two |= (after == ord(pair[0])) & (second == ord(pair[1]))
    for chosen, length in ((quote[one], 1), (quote[two], 2)):
        begins[chosen + 1] = False
        begins[chosen + 1 + length] = True
    return lead[np.flatnonzero(begins[:m])]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Token bytes, ranks, and how each token came from two earlier ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._made_of(token, rank)):
                self.halves[rank] = pair
                self.joined[pair] = rank
        #: what a merge can make; other tokens stand only for a whole piece
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.halves}

    def _made_of(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges before `rank` leave of the token's bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts) if all(p in self.ranks for p in parts) else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of left's bytes followed by right's is these two tokens.

        Merges run in rank order. Undo them from the last on either side: a merge across the border that could have
        run before the ones still standing would have taken their place.
        """
        key = left << 32 | right
        if (known := self._fits.get(key)) is not None:
            return known
        if len(self._fits) > JUDGED:
            self._fits.clear()
        bound = 1 << 62
        good = True
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                good = False
                break
            # of merges with one rank the left one runs first, so the right side's is undone first
            if left > right and left in self.halves:
                bound, left = left, self.halves[left][1]
            elif right in self.halves:
                bound, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                bound, left = left, self.halves[left][1]
            else:
                break
        self._fits[key] = good
        return good


class Prefixes:
    """The table of one piece: last[i] is the token that the encoding of its first i bytes ends with."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _fill(self, end: int) -> int:
        v, piece, last = self.vocabulary, self.piece, self.last
        usable, fits = v.usable, v.fits
        for start in range(max(0, end - v.longest), end):
            token = usable.get(piece[start:end])
            if token is not None and (not start or fits(last[start], token)):
                return token
        raise ValueError(f"byte {piece[end - 1]} is in no token")

    def append(self, more: bytes) -> None:
        """Lengthen the piece; the table of what it had stays."""
        begin = len(self.piece)
        self.piece += more
        for end in range(begin + 1, len(self.piece) + 1):
            self.last.append(self._fill(end))

    def truncate(self, length: int) -> None:
        """Shorten the piece; any prefix of the table is the table of that prefix."""
        self.piece = self.piece[:length]
        del self.last[length + 1 :]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in place of bytes start:end; returns how many prefixes were worked out anew."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[: start + 1]
        same, done = 0, 0
        for at in range(start + 1, len(self.piece) + 1):
            token = self._fill(at)
            done += 1
            self.last.append(token)
            before = at - shift
            # past the edit, once a longest token's length of entries agree, all later ones do
            same = same + 1 if at > start + len(new) and old[before] == token else 0
            if same > self.vocabulary.longest and at - same >= start + len(new):
                self.last += old[before + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        """Walk back from the last byte."""
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


class Codec:
    """Encodes each match of a pattern separately, as rank-file tokenizers do; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), pattern
        self._forget()

    def _forget(self) -> None:
        """Tables in Arrow and numpy, since Python's objects take some 200 bytes a piece."""
        self.keys = np.zeros(0, np.uint64)  # hashes of pieces, ascending
        self.place = np.zeros(0, np.int32)  # of each, its row in the tables
        self.names = pa.array([], pa.large_binary())  # its ids in decimal, a comma after each
        self.bytes = pa.array([], pa.large_binary())  # the bytes of those ids

    def split(self, t: Texts) -> np.ndarray:
        if self.pattern == PATTERN:
            return cuts(t)
        found, matcher = [], regex.compile(self.pattern)
        for start, end in zip(t.starts.tolist(), t.ends.tolist()):
            at = start
            for piece in matcher.findall(bytes(t.data[start:end]).decode()):
                found.append(at)
                at += len(piece.encode())
            if at != end:
                raise ValueError("the pattern leaves text out")
        return np.array(found, np.int64)

    def learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """Encode new pieces, whose hashes ascend, in byte order, each from the table of the prefix that it shares with the
        one before."""
        table, names, decoded = Prefixes(self.vocabulary), [], []
        whole_of, token_bytes = self.vocabulary.ranks.get, self.vocabulary.bytes_of
        order = sorted(range(len(raw)), key=raw.__getitem__)
        for piece in map(raw.__getitem__, order):
            whole = whole_of(piece)
            if whole is not None:  # a piece that is a token stands whole
                ids = [whole]
            else:
                same, most = 0, min(len(piece), len(table.piece))
                while same < most and piece[same] == table.piece[same]:
                    same += 1
                table.truncate(same)
                table.append(piece[same:])
                ids = table.tokens()
            names.append(b"".join([b"%d," % i for i in ids]))
            decoded.append(b"".join([token_bytes[i] for i in ids]))
        rows = np.empty(len(raw), np.int32)
        rows[order] = np.arange(len(self.names), len(self.names) + len(raw), dtype=np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, rows)
        self.names = pa.concat_arrays([self.names, pa.array(names, pa.large_binary())])
        self.bytes = pa.concat_arrays([self.bytes, pa.array(decoded, pa.large_binary())])

    def run(self, t: Texts) -> tuple[np.ndarray, bytes, np.ndarray, bytes]:
        """Ids of all texts in decimal (a comma after each) and the decoded bytes, each with the bound of every text."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        starts = self.split(t)
        ends = np.append(starts[1:], len(t.data))
        keys, index, inverse = np.unique(Hasher(t.data)(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        raw = t.data.tobytes()
        if len(new):
            self.learn(keys[new], [raw[a:b] for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist())])
        rows = pa.array(self.place[np.searchsorted(self.keys, keys)][inverse])
        out: list = []
        owner = np.searchsorted(starts, np.append(t.starts, len(t.data)), "left")
        for table in (self.names, self.bytes):
            taken = table.take(rows)
            offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(inverse) + 1] if len(inverse) else np.zeros(1, np.int64)
            body = taken.buffers()[2]
            out += [offsets[owner], body.to_pybytes() if body is not None and len(inverse) else b""]
        if out[3] != raw:  # two pieces with one hash: encode these texts without the table
            return self._apart(t)
        return tuple(out)

    def _apart(self, t: Texts) -> tuple[np.ndarray, bytes, np.ndarray, bytes]:
        starts = self.split(t).tolist()
        names, decoded, at = [], [], {}
        for start, end in zip(starts, [*starts[1:], len(t.data)]):
            piece = t.data[start:end].tobytes()
            ids = self.encode_piece(piece)
            at[start] = (sum(map(len, names)), sum(map(len, decoded)))
            names.append(b"".join([b"%d," % i for i in ids]))
            decoded.append(self.decode(ids))
        ends = (len(b"".join(names)), len(b"".join(decoded)))
        bounds = np.array([at.get(int(s), ends) for s in [*t.starts, len(t.data)]], np.int64).reshape(-1, 2)
        return bounds[:, 0], b"".join(names), bounds[:, 1], b"".join(decoded)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(piece)
        return [whole] if whole is not None else Prefixes(self.vocabulary, piece).tokens()

    def encode(self, text: str) -> list[int]:
        names = self.run(texts_of(pa.array([text], pa.string())))[1]
        return [int(x) for x in names.split(b",")[:-1]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def digest(ranks: dict[bytes, int], pattern: str) -> str:
    """Of every token, its rank, and the pattern."""
    said = hashlib.sha256(pattern.encode())
    for token, rank in ranks.items():
        said.update(b"%d:%d:" % (rank, len(token)) + token)
    return said.hexdigest()


def _codec(shipped, key: str, pattern: str) -> Codec:
    """One codec for a worker's life, whatever number of tasks it runs."""
    if key not in _codecs:
        _codecs[key] = Codec(shipped.value, pattern)
    return _codecs[key]


def _mapper(shipped, key: str, pattern: str, keep: list[str], with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped, key, pattern)
        for part, t in pieces(batches, "__text"):
            at, names, bound, decoded = codec.run(t)
            counts, shas, plain, all_ids = [], [], [], []
            for lo, hi, begin, end in zip(at[:-1].tolist(), at[1:].tolist(), bound[:-1].tolist(), bound[1:].tolist()):
                own = names[lo : max(lo, hi - 1)]
                counts.append(own.count(b",") + (hi > lo))
                shas.append(hashlib.sha256(own).hexdigest())
                plain.append(hashlib.sha256(decoded[begin:end]).hexdigest())
                if with_ids:
                    all_ids.append(np.array(own.split(b","), np.int32) if own else np.zeros(0, np.int32))
            arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(plain, pa.string())]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None, *, with_ids: bool = True) -> DataFrame:
    """The `keep` columns (default doc_id) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    keep = keep or ["doc_id"]
    held = [f"__k{i}" for i in range(len(keep))]
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    read = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)), F.col("text").alias("__text"))
    kinds = ", ".join(f"{h} {read.schema[h].dataType.simpleString()}" for h in held)
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = read.mapInArrow(_mapper(shipped, digest(ranks, pattern), pattern, held, with_ids), f"{kinds}, {made}")
    return out.select(*(F.col(h).alias(c) for c, h in zip(keep, held)), *(c.split()[0] for c in made.split(", ")))


def decode(frame: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """frame with the bytes of its ids column; null ids count as none."""
    tokens = {rank: token for token, rank in ranks.items()}
    shipped = frame.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("binary")
    def joined(column):
        table = shipped.value
        return column.map(lambda x: b"".join(table[i] for i in x) if x is not None else b"")

    return frame.withColumn(out, joined(F.col(ids)))
