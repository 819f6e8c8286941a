"""Codebooks and codes against plain Lloyd's rounds."""

import math
import random

import numpy as np
import pytest

from docloom.llm import codes

SHAPE = "vec_id long, embedding array<float>, label int, code string, entry int, part string"


def plain(rows):
    """vec_id, code, error, label_error, seal, in the order of rows."""
    kept = [(v, x, g) for v, x, g in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    if not kept:
        return []
    length = -(-max(max(len(x) for _, x, _ in kept), 1) // 4) * 4
    grid = [[math.floor(1024 * float(np.float32(c))) for c in x] + [0] * (length - len(x)) for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(c)) for c in kept[k][1]]))
    side = length // 4
    books = [[grid[k][p * side : (p + 1) * side] for k in order[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            groups = {}
            for x in grid:
                groups.setdefault(nearest(x[p * side : (p + 1) * side], books[p])[1], []).append(x[p * side : (p + 1) * side])
            for k, held in groups.items():
                books[p][k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    found = [[nearest(x[p * side : (p + 1) * side], books[p]) for p in range(4)] for x in grid]
    total = {}
    for (_, _, g), f in zip(kept, found, strict=True):
        total[g] = total.get(g, 0) + sum(d for d, _ in f)
    sealed = codes.seal(np.array(books, np.int64))
    return [(v, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[g], sealed) for (v, _, g), f in zip(kept, found, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, "clash") for r in rows], SHAPE)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("leaf", [1, 16])
def test_tree_gives_every_point_its_nearest_entry(leaf):
    rng = np.random.default_rng(1)
    for scale, n, k in ((8, 700, 40), (1 << 25, 300, 30), (1, 200, 10), (4, 1, 1), (300, 1000, 256)):
        points, entries = rng.integers(-scale, scale, (n, 5)), rng.integers(-scale, scale, (k, 5))
        points[n // 3 :: 3] = points[0]
        sums, counts, own, compared = codes.Tree(points, leaf).assign(entries)
        tree = codes.Tree.of(codes.Tree(points, leaf).arrays("x"), "x")
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (tree.assign(entries)[2] == own).all() and (own == want[tree.order]).all()
        assert (counts == np.bincount(want, minlength=k)).all() and (sums == np.stack([points[want == e].sum(0) for e in range(k)])).all()
        assert compared <= n


def test_a_tree_gives_whole_subtrees():
    rng = np.random.default_rng(2)
    centers = rng.integers(-1000, 1000, (20, 4)) * 1000
    points = np.repeat(centers, 200, axis=0) + rng.integers(-5, 5, (4000, 4))
    assert codes.Tree(points).assign(centers)[3] < 400
    same = codes.Tree(np.zeros((4000, 4), np.int64)).assign(np.zeros((256, 4), np.int64))
    assert same[3] == 0 and same[1][0] == 4000


def test_codes(spark, monkeypatch):
    monkeypatch.setattr(codes, "CHUNK", 100)
    rng = random.Random(3)
    rows = [(k * 3 % 701, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([0, 1, 1, None])) for k in range(350)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(150)]  # a third are one vector
    rows += [(2000, None, 1), (2001, [None, 1.0], 1), (2002, [math.nan] * 8, 0), (2003, [math.inf] * 8, 0), (2004, [], None), (2005, [0.5] * 3, 2), (None, [0.25] * 8, 2), (3, [0.1] * 8, 0), rows[5], rows[5]]
    assert ordered(codes.codes(table(spark, rows).repartition(3)).collect()) == ordered(plain(rows))


def test_few_rows_and_none(spark):
    rows = [(5, [0.5, 0.25, -0.5, 1.0, 2.0], 1), (5, [0.5, 0.25, -0.5, 1.0, -2.0], None), (4, [0.5, 0.25, -0.5, 1.0, 2.0], None)]
    assert ordered(codes.codes(table(spark, rows)).collect()) == ordered(plain(rows))
    assert codes.codes(table(spark, [])).collect() == [] and codes.codes(table(spark, [(1, None, 1)])).collect() == []


def test_query(spark, sf):
    from docloom.llm.queries import op13_vector_codes

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert ordered(op13_vector_codes(spark, sf).collect()) == ordered(plain(rows))
