"""Repeat removal: the array's own verdicts, and grams of very many runs."""

import collections
import hashlib

import numpy as np
import pytest

from docloom.llm import repeats
from docloom.llm._bytes import Hasher, Texts


def test_common_symbols():
    s = np.array([5, 3, 4, 3, 4, 3, 5, 1, 3, 4, 3, 9, 0])
    order = np.array(repeats.suffix_array(s.tolist()))
    for most in (1, 2, 4):
        got = repeats.common_symbols(s, order, most)
        for k in range(1, len(order)):
            a, b = s[order[k] :].tolist(), s[order[k - 1] :].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[k] == min(most, same)


@pytest.mark.parametrize("pack", [1, 8, 16])
def test_marks_are_those_of_brute_force(pack):
    r = np.random.default_rng(8)
    for _ in range(20):
        core = bytes(r.integers(97, 99, 24, dtype=np.uint8))
        parts, leads = [], []
        for _ in range(12):
            left, right = (bytes(r.integers(97, 99, int(r.integers(0, 40)), dtype=np.uint8)) for _ in range(2))
            some = b"".join([left, core, right])
            parts.append(some)
            leads.append(len(left))
        length = 40
        want = collections.Counter((lead - i, p[i : i + length]) for p, lead in zip(parts, leads) for i in range(len(p) - length + 1))
        for p, lead, marks in zip(parts, leads, repeats.equal_windows(parts, leads, length, pack)):
            assert marks.tolist() == [want[lead - i, p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def brute(rows, length=200):
    raw = [(d, t.encode()) for d, t in rows]
    seen = collections.Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw:
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_gram_of_many_runs(spark):
    """A shared passage of 110 bytes between other texts: every run has its gram, few windows repeat."""
    r = np.random.default_rng(9)
    word = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    shared, sides = word(110), [word(60) for _ in range(6)]
    rows = [(k, word(150) + (sides[k % 6] if k % 2 else word(60)) + shared + (sides[(k + 1) % 6] if k % 3 else "é" * 30) + word(150)) for k in range(60)]
    rows += [(100, "x" * 900), (101, "xy" * 450), (102, rows[0][1]), (103, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for hot in (3, 1024):
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove_repeats(frame, hot=hot).collect()}
        assert got == want


def test_picks_do_not_depend_on_what_stands_around():
    """Grams whose hashes differ in their last bits alone tie in the same way in a short and in a long buffer."""
    text = np.random.default_rng(3).integers(97, 123, 900).astype(np.uint8)
    rest = np.random.default_rng(4).integers(97, 123, 90_000).astype(np.uint8)

    def picks(data, ends):
        full = Hasher(data)
        starts = np.array([0, *ends[:-1]])
        _, _, doc, first, last, lead = repeats.runs(Texts(data, starts, np.array(ends)), lambda a, b: full(a, b) & np.uint64(0xFFFFF))
        return [x[doc == 0].tolist() for x in (first, last, lead)]

    assert picks(text, [900]) == picks(np.concatenate([text, rest]), [900, 90_900])
