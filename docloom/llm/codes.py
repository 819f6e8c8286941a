"""Vector code compression: codebooks by Lloyd's rounds, filtered through kd-trees.

The rows are cut into chunks of at most `CHUNK` where they lie. Each chunk gets a kd-tree over every part of its vectors, with
the box, count and sum of every node; trees are written once and read in each round. A round takes the codebooks to the
trees: at a node, an entry is dropped if at the box's corner that suits it best it is farther than the entry nearest to
the box's middle (or as far, with a higher index), so no point of the box can be its own. A node with one entry left gives its
sum and count whole; only points of leaves with several are compared one by one. All numbers are whole, so sums, and with them
results, do not depend on how rows are dealt. A task gives at most one row an entry, and the driver gets one row an entry.

Defined results: vectors that are null or hold null or non-finite components (or components whose floor passes
`_vectors.LARGEST`, which have no exact error) are dropped; shorter vectors are continued by zeros to the longest, and that
to a multiple of the parts; rows of one vec_id count each, ordered by their vectors, rows without vec_id last; with fewer
rows than entries, there are as many entries as rows; equal entries go to the lower index; an empty table gives no rows; null
labels are one label; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._spark import written
from docloom.llm._vectors import floors, usable, width

PARTS = 4
ENTRIES = 256
ROUNDS = 4
FACTOR = 1024
CHUNK = 4096
LEAF = 16


def _number(x: np.ndarray, entries: np.ndarray) -> type:
    """The type in which distances are exact: doubles where all sums stay below 2^53, else longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    return np.float64 if 8 * most * most * max(x.shape[1], 1) < 1 << 53 else np.int64


class Tree:
    """A kd-tree over whole-number points. Nodes of a level halve those of the level above, each along its widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        bounds, order = np.array([0, len(points)]), np.arange(len(points))
        cuts = [bounds]
        while np.diff(bounds).max() > leaf:
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            held = points[order]
            spread = np.maximum.reduceat(held, bounds[:-1]) - np.minimum.reduceat(held, bounds[:-1])
            order = order[np.lexsort((held[np.arange(len(held)), spread.argmax(1)[node]], node))]
            bounds = np.unique(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2]))
            cuts.append(bounds)
        self.order, self.points, self.cuts = order, points[order], cuts
        self._cache()

    def _cache(self) -> None:
        x = self.points
        self.nodes = [(np.minimum.reduceat(x, c[:-1]), np.maximum.reduceat(x, c[:-1]), np.add.reduceat(x, c[:-1])) for c in self.cuts]

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        out = {f"{name}order": self.order.astype(np.int32), f"{name}points": self.points.astype(np.int32)}
        for k, (cut, (low, high, total)) in enumerate(zip(self.cuts, self.nodes, strict=True)):
            out |= {f"{name}cut{k}": cut.astype(np.int32), f"{name}low{k}": low.astype(np.int32), f"{name}high{k}": high.astype(np.int32), f"{name}sum{k}": total}
        return out

    @classmethod
    def of(cls, held: dict[str, np.ndarray], name: str) -> Tree:
        self = cls.__new__(cls)
        self.order, self.points, self.cuts, self.nodes = held[f"{name}order"], held[f"{name}points"].astype(np.int64), [], []
        while f"{name}cut{len(self.cuts)}" in held:
            k = len(self.cuts)
            self.cuts.append(held[f"{name}cut{k}"].astype(np.int64))
            self.nodes.append((held[f"{name}low{k}"].astype(np.int64), held[f"{name}high{k}"].astype(np.int64), held[f"{name}sum{k}"]))
        return self

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sums and counts by entry, the entry of each point (in the order of the tree), and how many points were compared
        one by one."""
        kind = _number(self.points, entries)
        e = entries.astype(kind)
        square = (e * e).sum(1)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        own = np.full(len(self.points), -1, np.int64)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(e)), bool)
        compared = 0
        for level, (cut, (low, high, total)) in enumerate(zip(self.cuts, self.nodes, strict=True)):
            middle, side = (low[nodes] + high[nodes]).astype(kind), (high[nodes] - low[nodes]).astype(kind)
            toward = middle @ e.T
            best = np.where(alive, square - toward, np.iinfo(np.int64).max if kind is np.int64 else np.inf).argmin(1)
            row, entry = np.nonzero(alive)
            near = best[row]
            far = square[entry] - square[near] - (toward[row, entry] - toward[row, near]) - (np.abs(e[entry] - e[near]) * side[row]).sum(1)
            alive[row, entry] = (far < 0) | ((far == 0) & (entry <= near))
            single = alive.sum(1) == 1
            done, chosen = nodes[single], alive[single].argmax(1)
            np.add.at(sums, chosen, total[done])
            np.add.at(counts, chosen, cut[done + 1] - cut[done])
            begin, size = cut[done], cut[done + 1] - cut[done]
            own[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(chosen, size)
            nodes, alive = nodes[~single], alive[~single]
            if not len(nodes):
                break
            if level + 1 < len(self.cuts):
                below = self.cuts[level + 1]
                first, last = np.searchsorted(below, cut[nodes]), np.searchsorted(below, cut[nodes + 1])
                parts = last - first
                nodes = np.repeat(first - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
                alive = np.repeat(alive, parts, axis=0)
            else:
                begin, size = cut[nodes], cut[nodes + 1] - cut[nodes]
                at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                x = self.points[at].astype(kind)
                cost = square - 2 * (x @ e.T)
                cost[~np.repeat(alive, size, axis=0)] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
                own[at] = cost.argmin(1)  # the first of equals
                np.add.at(sums, own[at], self.points[at])
                np.add.at(counts, own[at], 1)
                compared = len(at)
        return sums, counts, own, compared


def _planted(rows: DataFrame, length: int) -> DataFrame:
    """One row a chunk: its vec_ids, labels, and the trees of its parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def plant() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            vectors = floors(whole.column(2).combine_chunks(), FACTOR, length)
            out = io.BytesIO()
            np.savez(out, **{k: v for p, x in enumerate(np.split(vectors, PARTS, axis=1)) for k, v in Tree(x).arrays(f"{p}_").items()})
            lists = [pa.array([whole.column(k).to_pylist()], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.string()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([out.getvalue()], pa.binary())], names=["vec_id", "label", "trees"])

        for batch in batches:
            while batch.num_rows:
                room = CHUNK - sum(b.num_rows for b in held)
                held.append(batch[:room])
                batch = batch[room:]
                if sum(b.num_rows for b in held) == CHUNK:
                    yield plant()
                    held = []
        if held:
            yield plant()

    return rows.mapInArrow(run, "vec_id array<long>, label array<string>, trees binary")


def _trees(data: bytes) -> list[Tree]:
    held = dict(np.load(io.BytesIO(data)))
    return [Tree.of(held, f"{p}_") for p in range(PARTS)]


def _summed(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, count and component sums of what the entries got."""
    side = books.shape[2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for data in batch.column(0):
                for p, tree in enumerate(_trees(data.as_py())):
                    s, n, _, _ = tree.assign(books[p])
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        values = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].ravel()), side).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), values], names=["part", "entry", "n", "s"])

    each = trees.select("trees").mapInArrow(run, "part int, entry int, n long, s array<long>")
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[k]) for k in range(side))).alias("s"))


def _coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{k:02x}" for k in range(ENTRIES)], object)
        for batch in batches:
            for ids, labels, data in zip(*batch.columns, strict=True):
                code, error = np.full(len(ids.values), "", object), np.zeros(len(ids.values), np.int64)
                for p, tree in enumerate(_trees(data.as_py())):
                    own = tree.assign(books[p])[2]
                    code[tree.order] += hexes[own]
                    off = tree.points - books[p][own]
                    error[tree.order] += (off * off).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every usable row of (vec_id, embedding, label), and the codebooks (part, entry,
    component)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(usable(F.col("embedding"), FACTOR))
    length = -(-max(width(rows, "embedding"), 1) // PARTS) * PARTS
    trees = written(_planted(rows, length), "trees")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow().column(0).combine_chunks()
    books = np.stack(np.split(floors(first, FACTOR, length), PARTS, axis=1)) if len(first) else np.zeros((PARTS, 0, length // PARTS), np.int64)
    for _ in range(ROUNDS if len(first) else 0):
        for r in _summed(trees, books).collect():  # one row an entry
            books[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return (_coded(trees, books) if len(first) else trees.selectExpr("vec_id[0] AS vec_id", "label[0] AS label", "'' AS code", "0L AS error")), books


def seal(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row."""
    found, books = compress(vectors)
    found = written(found, "codes")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return found.join(by_label, found["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(seal(books)).alias("codebooks_sha256"))
