"""Simple-8b words against a greedy packer, pieces against whole texts, files against lists of ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import simple8b, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "Z", " ", "  ", "\n", "\t", "'", "'s", "'ll", "é", "ß", "×", "÷", " ", "　", "\u0085", "漢", "😀", "1", "²", ".", "--", "<|endoftext|>", "\x1c", "\r", "́", "ʼ", "Ȁ", "\x00", "the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def greedy(ids):
    out, at = [], 0
    while at < len(ids):
        fits = (s for s in range(1, 16) if all(int(x) < 2 ** int(simple8b.BITS[s]) for x in ids[at : at + int(simple8b.COUNT[s])]))
        out.append(next(fits, 0))
        at += int(simple8b.COUNT[out[-1]])
    return out


@pytest.mark.parametrize("kind", ["ids", "bits", "zeros", "wide", "escapes", "runs"])
def test_words(kind):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 511, 512, 513, 1024, 2777):
        make = {
            "ids": lambda n: rng.integers(0, 50257, n), "bits": lambda n: rng.integers(0, 2, n), "zeros": lambda n: np.zeros(n, int), "wide": lambda n: (2 ** rng.uniform(0, 63.9, n)).astype(np.uint64),
            "escapes": lambda n: np.where(rng.random(n) < 0.1, np.uint64(2**64 - 1), rng.integers(0, 9, n).astype(np.uint64)), "runs": lambda n: np.repeat(rng.integers(0, 3, n // 100 + 1), 100)[:n] * 70000,
        }
        ids = np.asarray(make[kind](n), np.uint64)
        words, escapes, starts = simple8b.pack(ids)
        assert (simple8b.unpack(words, escapes, starts, n) == ids).all()
        want = [s for k in range(0, n, simple8b.BLOCK) for s in greedy(ids[k : k + simple8b.BLOCK])]
        assert (words >> np.uint64(60)).tolist() == want
        for first, last in ((0, n // 2), (n // 3, n), (n // 2, n // 2 + 1), (n, n)):
            assert (simple8b.unpack(words, escapes, starts, n, first, last) == ids[first:last]).all()


def test_segment_round_trip_and_cut():
    ids = np.array([1, 2**62, 0, 5, 2**63], np.uint64)
    one, two = simple8b.segment([7, None, -3], np.array([2, 0, 3]), ids, 4, 1), simple8b.segment([], np.array([], int), np.array([], np.uint64))
    end = simple8b.END.encode()
    got = list(simple8b.segments(one + end + two + end))
    assert [(s.part, s.number, s.keys, s.lengths.tolist(), s.ids().tolist()) for s in got] == [(4, 1, [7, None, -3], [2, 0, 3], ids.tolist()), (0, 0, [], [], [])]
    with pytest.raises(ValueError):
        list(simple8b.segments(one[:-8] + end))


def test_pieces_have_the_ids_of_their_texts(library):
    own, rng = tokenfile.Encoder(PATH), random.Random(2)
    for trial in range(150):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(20)]
        held = [t.encode() for t in texts]
        ids, counts = own.encode(np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        if trial == 70:
            own._forget()


def test_two_pieces_of_one_hash(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "_MIX", np.zeros(3, np.uint64))  # every piece of one length has one hash
    own = tokenfile.Encoder(PATH)
    for text in ("some words with other words", "more of these", "some more"):
        ids, _ = own.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def expected(rows, library):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, library, tmp_path):
    rng = random.Random(4)
    long = " ".join(f"word{k % 911} tail{k}" for k in range(60000))
    rows = [(k, "".join(rng.choice(ODD) for _ in range(rng.randrange(80)))) for k in rng.sample(range(-500, 500), 300)]
    rows += [(1000, None), (1001, ""), (1002, long), (None, "no number"), (None, "another"), (5000, "same number"), (5000, "other text"), (5000, "other text")]
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, part string, ids int, start int").repartition(3)
    for out, size in (("a", 1 << 24), ("b", 40_000)):
        got = tokenfile.table(docs, PATH, out=str(tmp_path / out), file_bytes=size).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, library)
    held = spark.read.format("binaryFile").load(str(tmp_path / "b")).collect()
    assert sum(len(s.keys) for f in held for s in simple8b.segments(bytes(f["content"]))) == len(rows)
    assert tokenfile.table(docs.limit(0), PATH).collect() == []


def test_a_number_of_a_third_of_all_rows_fills_several_files(spark, library, tmp_path):
    rows = [(7 if k % 3 == 0 else k, f"text {k}") for k in range(900)]
    got = tokenfile.table(spark.createDataFrame(rows, "doc_id long, text string"), PATH, out=str(tmp_path / "x"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows, library)
    per_file = [sum(s.keys.count(7) for s in simple8b.segments(bytes(f["content"]))) for f in spark.read.format("binaryFile").load(str(tmp_path / "x")).collect()]
    assert max(per_file) < 150


def test_query(spark, sf, library):
    from docloom.llm.queries import op12_token_file

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_token_file(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows, library)
