"""Hard negatives against all pairs of anchors and rows."""

import math
import random

import numpy as np
import pytest

from docloom.llm import negatives

SHAPE = "vec_id long, embedding array<float>, label int, anchor boolean, key string, score int"


def plain(rows):
    kept = {}
    for v, x, g, a in rows:
        if v is not None and g is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            q = tuple(math.floor(256 * float(np.float32(c))) for c in x)
            kept[v, q, g] = kept.get((v, q, g), False) or bool(a)
    out = []
    for (v, q, g), anchor in kept.items():
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), w, h, x) for (w, x, h) in kept)
        for s, p, _, _ in [r for r in scored if r[2] == g and (r[1], r[3]) != (v, q)][:5]:
            fit = [(-n, w) for n, w, h, _ in scored if h != g and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(v, p, k, w, -s, n) for k, (n, w) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], SHAPE)


def rows_of(seed=3, n=500):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(12)]
    rows = [(k, [c + rng.gauss(0, 0.15) for c in rng.choice(centers)], rng.choice([0, 1, 2, 2, 17]), k % 9 == 0) for k in range(n)]
    rows += [(1000 + k, rows[0][1], k % 2, k % 10 == 0) for k in range(n // 3)]  # many copies, some of them anchors
    return rows


ODD = [
    (3000, None, 1, True), (3001, [0.1] * 6, None, True), (None, [0.1] * 6, 1, True), (3002, [0.1, None], 1, True), (3003, [math.nan] * 6, 0, True), (3004, [math.inf] * 6, 0, False),
    (3005, [], 1, True), (3006, [2.0, 0.5], 2, True), (5, [0.5] * 6, 1, True), (3007, [0.0] * 6, 99, True), (3008, [0.0] * 6, 98, None), (3009, [3.0] * 6, 5, True),
]


@pytest.mark.parametrize("small", [False, True])
def test_mine(spark, monkeypatch, small):
    monkeypatch.setattr(negatives, "CELL", 9)
    if small:
        monkeypatch.setattr(negatives, "SLICE", 100)
        monkeypatch.setattr(negatives, "BLOCK", 10)
        monkeypatch.setattr(negatives, "_CHUNK", 30)
        monkeypatch.setattr(negatives, "_ROWS", 4)
    rows = rows_of()
    got = sorted(map(tuple, negatives.mine(table(spark, rows + ODD + rows[:20]).repartition(3)).collect()))
    want = plain(rows + ODD)
    assert len(want) > 1000 and got == want


def test_few_rows_and_none(spark):
    assert negatives.mine(table(spark, [])).collect() == []
    assert negatives.mine(table(spark, [(1, [1.0], 1, True)])).collect() == []
    rows = [(1, [1.0, 0.0], 1, True), (2, [0.9, 0.0], 1, False), (3, [0.9, 0.1], 2, False), (4, [-0.9, 0.1], 2, False), (5, [0.5, 0.1], 2, True), (6, [0.9, 0.0], 3, False)]
    assert sorted(map(tuple, negatives.mine(table(spark, rows)).collect())) == plain(rows)


def test_bounds_leave_out_candidates_but_no_result():
    """Of clusters far from each other, a candidate goes to few groups, and to every group that holds an anchor it serves."""
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 1, (30, 8))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    x = np.round((centers[rng.integers(0, 30, 3000)] + rng.normal(0, 0.01, (3000, 8))) * 256).astype(np.int64)
    norms = (x**2).sum(1)
    space = negatives.Space(x[:30], norms[:30].astype(float), float(norms.max()), 8)
    anchors = x[:200]
    far = space.distances(anchors, norms[:200], True)
    cell = far.argmin(1)
    scores = anchors @ x.T
    last = np.sort(scores, axis=1)[:, -6]
    away = lambda s, q: np.sqrt(np.maximum(q + space.most - 2 * s, 0))
    cells = np.unique(cell)
    high = np.array([max(away(last[k], norms[k]) for k in np.flatnonzero(cell == c)) for c in cells])
    groups = negatives.Groups(cells, np.zeros(len(cells), int), np.array([far[cell == c, c].max() for c in cells]), np.zeros(len(cells)), high, np.bincount(cell)[cells], 1, np.ones(len(cells), int))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 16] * 3000), pa.array(np.zeros(3000, int)), pa.array([v.astype("<i4").tobytes() for v in x]), pa.array(norms)], names=["key", "label", "vec", "norm"])
    pairs = set()
    for home in (True, False):
        row, group = negatives._pairs(batch, space, groups, home)
        pairs |= set(zip(row.tolist(), cells[group].tolist(), strict=True))
    needed = {(int(c), int(cell[k])) for k in range(200) for c in np.flatnonzero(scores[k] >= last[k])}
    assert needed <= pairs and len(pairs) < 3000 * len(cells) / 3


def test_query(spark, sf):
    from docloom.llm.queries import op11_hard_negatives

    rows = [(v, x, (g + 1) % 10 if g is not None and v % 7 == 0 else g, v % 100 == 0) for v, x, g in map(tuple, spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect())]
    got = op11_hard_negatives(spark, sf)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["negative_score"] == "bigint"
    assert sorted(map(tuple, got.collect())) == plain(rows)
