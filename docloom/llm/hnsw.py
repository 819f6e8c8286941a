"""Embedding near-duplicates over hierarchical navigable small-world graphs.

Vectors with one label are cut into shards of at most `SHARD`; each shard gets a graph, kept as one row. Every vector
queries every shard of its label, in blocks. A query's beam is widened while its whole result lies over the threshold,
and for all queries of a block until audits against brute force reach `RECALL`: of the nearest points of `AUDIT` evenly
spaced queries, and of the links of eight times as many that are drawn before the search. Points that a search may not
come by (no neighbour links back to them, or no way leads there) are compared with every query. A block whose audits fail at the widest beam is
compared with the whole shard. What
the beams find is verified by cosine in double precision. Equal vectors with one label are one point with a weight, so
many copies cost one query; links are counted and united where they are found, never listed.

Defined results: null, zero, or non-finite vectors, vectors with null components, and null labels link with nothing and
are their own component; repeated rows are copies of each other and link; rows without vec_id link with nothing and have
no component; vectors of another length than a query's are no neighbours of it; an empty table gives no rows; other
columns are not read.
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
from docloom.llm.components import components, spanning

SHARD = 8192
QUERIES = 4096
NEIGHBOURS = 24
BEAM = 48
BUILD_BEAM = 64
AUDIT = 64
RECALL = 0.99
NEAREST = 10
COSINE = 0.98
_GROW = 256


class Graph:
    """Layers of neighbour tables over unit vectors. Points enter in batches: a batch searches what is there, and its
    own members are compared with each other, so it links as one-by-one insertion would."""

    def __init__(self, points: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM, seed: int = 3):
        self.points = points
        self.width = neighbours
        n = len(points)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(neighbours)).astype(int), 6)
        level[:1] = level.max(initial=0)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for height in range(int(level.max(initial=0)) + 1):
            members = np.flatnonzero(level >= height)
            self.layers.append((members, self._layer(members, beam)))

    def _layer(self, members: np.ndarray, beam: int) -> np.ndarray:
        """Links among the members, as places within members; -1 where there are fewer."""
        most = self.width * 2
        table = np.full((len(members), most), -1, np.int32)
        value = np.full((len(members), most), -np.inf, np.float32)
        x = self.points[members].astype(np.float32)
        done = 0
        while done < len(members):
            new = np.arange(done, min(len(members), done + (_GROW if done >= _GROW else max(1, done or 32))))
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            place, score = [np.broadcast_to(new, own.shape)], [own]
            if done:
                found, close = search(x[:done], table[:done], x[new], beam, np.zeros((len(new), 1), np.int32) + (new[:, None] * 7919) % done)
                place.append(found)
                score.append(close)
            place, score = np.concatenate(place, 1), np.concatenate(score, 1)
            k = min(self.width, place.shape[1])
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            ids, close = np.take_along_axis(place, best, 1), np.take_along_axis(score, best, 1)
            ids = np.where(np.isfinite(close), ids, -1)
            table[new, :k], value[new, :k] = ids, np.where(ids >= 0, close, -np.inf)
            # links back: a point that has no room gives up its farthest
            src, dst, s = np.repeat(new, k), ids.ravel(), close.ravel()
            good = dst >= 0
            src, dst, s = src[good], dst[good], s[good]
            order = np.lexsort((-s, dst))
            src, dst, s = src[order], dst[order], s[order]
            start = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, int)
            rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.append(start, len(dst))))
            touched = dst[start]
            extra_id = np.full((len(touched), most), -1, np.int32)
            extra_s = np.full((len(touched), most), -np.inf, np.float32)
            row = np.cumsum(rank == 0) - 1
            some = rank < most
            extra_id[row[some], rank[some]], extra_s[row[some], rank[some]] = src[some], s[some]
            joint_id, joint_s = np.concatenate([table[touched], extra_id], 1), np.concatenate([value[touched], extra_s], 1)
            for c in range(most, joint_id.shape[1]):  # a link that is there already
                again = (joint_id[:, :most] == joint_id[:, c : c + 1]).any(1) & (joint_id[:, c] >= 0)
                joint_s[again, c] = -np.inf
            top = np.argsort(-joint_s, axis=1, kind="stable")[:, :most]
            table[touched] = np.where(np.isfinite(np.take_along_axis(joint_s, top, 1)), np.take_along_axis(joint_id, top, 1), -1)
            value[touched] = np.take_along_axis(joint_s, top, 1)
            done = int(new[-1]) + 1
        return table

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest found for each row of q: points and cosines."""
        q = q.astype(np.float32)
        entry = None
        for height in range(len(self.layers) - 1, -1, -1):
            members, table = self.layers[height]
            x = self.points[members].astype(np.float32)
            start = np.zeros((len(q), 1), np.int32) if entry is None else np.searchsorted(members, entry).astype(np.int32)
            found, close = search(x, table, q, beam if height == 0 else min(4, len(members)), start)
            entry = np.where(found >= 0, members[found], -1)
            if height:
                entry = np.where(entry >= 0, entry, entry[:, :1])
                if height == 1:  # the root too, from which `apart` looks at what can be reached
                    entry = np.concatenate([np.full((len(q), 1), self.root), entry], 1)
        return entry, close

    @property
    def root(self) -> int:
        return int(self.layers[-1][0][0])

    def apart(self) -> np.ndarray:
        """Points that a search may not come by: those that cannot be reached from the root, and those to which none of
        their own neighbours has a link."""
        table, n = self.layers[0][1], len(self.points)
        mutual = np.zeros(n, bool)
        for c in range(table.shape[1]):
            there = np.flatnonzero((table[:, c] >= 0) & ~mutual)
            mutual[there] = (table[table[there, c]] == there[:, None]).any(1)
        reached, front = np.zeros(n, bool), np.array([self.root])
        reached[front] = True
        while len(front):
            front = np.unique(table[front])
            front = front[front >= 0]
            front = front[~reached[front]]
            reached[front] = True
        return np.flatnonzero(~(mutual & reached))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, count=len(self.layers), **{f"m{k}": m for k, (m, _) in enumerate(self.layers)}, **{f"t{k}": t for k, (_, t) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        data = np.load(io.BytesIO(raw))
        self = cls.__new__(cls)
        self.points = data["points"]
        self.layers = [(data[f"m{k}"], data[f"t{k}"]) for k in range(int(data["count"]))]
        self.width = NEIGHBOURS
        return self


def search(x: np.ndarray, table: np.ndarray, q: np.ndarray, beam: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries in step; each expands its nearest unexpanded points until its beam has none."""
    n, rows = len(x), len(q)
    beam = min(beam, n)
    ids = np.full((rows, beam), -1, np.int32)
    close = np.full((rows, beam), -np.inf, np.float32)
    opened = np.ones((rows, beam), bool)
    seen = np.zeros((rows, n), bool)
    start = start[:, : max(1, beam)]
    for c in range(start.shape[1]):
        s = start[:, c]
        fresh = ~seen[np.arange(rows), s] & (c < beam)
        seen[np.arange(rows), s] = True
        ids[fresh, c] = s[fresh]
        close[fresh, c] = np.einsum("ij,ij->i", x[s[fresh]], q[fresh])
        opened[fresh, c] = False
    live = np.arange(rows)
    step = min(beam, 8 if beam >= 32 else 2)
    while len(live):
        waiting = np.where(opened[live], -np.inf, close[live])
        pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), waiting.shape)
        chosen = np.isfinite(np.take_along_axis(waiting, pick, 1))
        going = chosen.any(1)
        live, pick, chosen = live[going], pick[going], chosen[going]
        if not len(live):
            break
        opened[np.repeat(live, chosen.sum(1)), pick[chosen]] = True
        near = table[np.take_along_axis(ids[live], pick, 1)]
        near = np.where(chosen[:, :, None], near, -1).reshape(len(live), -1)
        near.sort(axis=1)
        ok = near >= 0
        ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        safe = np.where(ok, near, 0)
        ok &= ~seen[live[:, None], safe]
        r, c = np.nonzero(ok)
        at = safe[r, c]
        seen[live[r], at] = True
        score = np.full(near.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("ij,ij->i", x[at], q[live[r]])
        all_s = np.concatenate([close[live], score], 1)
        all_i = np.concatenate([ids[live], safe.astype(np.int32)], 1)
        all_o = np.concatenate([opened[live], ~ok], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        close[live], ids[live], opened[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_o, top, 1)
    return np.where(np.isfinite(close), ids, -1), close


def recall_of(found: np.ndarray, truth: np.ndarray) -> float:
    """Share of the true pairs that are found; 1 where there is none."""
    return float((found & truth).sum() / truth.sum()) if truth.any() else 1.0


def links_of(graph: Graph, q: np.ndarray, cosine: float = COSINE, beam: int = BEAM, recall: float = RECALL, audit: int = AUDIT) -> tuple[np.ndarray, np.ndarray, tuple[int, float]]:
    """(query, point) pairs with a cosine of at least `cosine` in double precision; the beam accepted and its recall.

    Points that the graph may hide (`apart`) are compared with every query. A beam is audited twice against brute force: by
    the `NEAREST` nearest points of `audit` evenly spaced queries, which have such whether or not they have links, and by
    the links of `8 * audit` queries drawn before the search, found or not, and of `audit` that have found some. The lower
    recall counts."""
    n, rows = len(graph.points), len(q)
    margin = 1e-4  # single precision searches, double precision decides
    spaced = lambda x: x[np.unique(np.linspace(0, len(x) - 1, min(audit, len(x))).astype(int))] if len(x) else x
    looked = spaced(np.arange(rows))
    scores = q[looked] @ graph.points.T
    nearest = min(NEAREST, n)
    close_enough = np.partition(scores, n - nearest, axis=1)[:, n - nearest, None] - 1e-6  # ties count as found
    truth = np.zeros(scores.shape, bool)
    np.put_along_axis(truth, np.argpartition(-scores, nearest - 1, axis=1)[:, :nearest], True, 1)

    hidden = graph.apart()
    drawn = np.sort(np.random.default_rng(11).choice(rows, min(8 * audit, rows), replace=False))
    by_hand = [np.nonzero(q[k : k + 256] @ graph.points[hidden].T >= cosine - margin) for k in range(0, rows, 256)] if len(hidden) else []
    hidden_left = np.concatenate([r + 256 * k for k, (r, _) in enumerate(by_hand)]) if by_hand else np.zeros(0, np.int64)
    hidden_right = hidden[np.concatenate([c for _, c in by_hand])] if by_hand else np.zeros(0, np.int64)

    def gather(which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [hidden_left], [hidden_right]
        while len(which):
            again = []
            for k in range(0, len(which), 1024):
                part = which[k : k + 1024]
                ids, close = graph.query(q[part], width)
                hit = (ids >= 0) & (close >= cosine - margin)
                full = hit.all(1) & (width < n)  # nothing under the threshold was met: there may be more
                again.append(part[full])
                r, c = np.nonzero(hit & ~full[:, None])
                left.append(part[r])
                right.append(ids[r, c])
            which, width = np.concatenate(again), min(n, width * 4)
        pairs = np.unique(np.concatenate(left).astype(np.int64) * n + np.concatenate(right))  # a hidden point may be found too
        return pairs // n, pairs % n

    def near_recall(width: int) -> float:
        ids, _ = graph.query(q[looked], width)
        got = np.zeros(scores.shape, bool)
        r, c = np.nonzero(ids >= 0)
        got[r, ids[r, c]] = True
        got[:, hidden] = True
        reached = (got & (scores >= close_enough)).sum(1)
        return float(np.minimum(reached, nearest).sum() / (nearest * len(looked)))

    def link_recall(left: np.ndarray, right: np.ndarray) -> float:
        some = np.union1d(drawn, spaced(np.unique(left)))
        linked = (q[some] @ graph.points.T) >= cosine
        place = np.minimum(np.searchsorted(some, left), len(some) - 1)
        mine = some[place] == left
        got = np.zeros(linked.shape, bool)
        got[place[mine], right[mine]] = True
        return recall_of(got, linked)

    if 2 * len(hidden) > n:  # the graph is of no use
        beam = n
    while True:
        width = min(max(beam, nearest), n)
        measured = near_recall(width) if 2 * len(hidden) <= n else 0.0
        if measured >= recall:
            left, right = gather(np.arange(rows), width)
            measured = min(measured, link_recall(left, right))
        if measured >= recall:
            break
        if beam >= n:  # the graph does not reach them: every query is compared with every point
            near = [np.nonzero(q[k : k + 256] @ graph.points.T >= cosine - margin) for k in range(0, rows, 256)]
            left = np.concatenate([r + 256 * k for k, (r, _) in enumerate(near)])
            right = np.concatenate([c for _, c in near])
            measured = 1.0
            break
        beam *= 2
    exact = np.concatenate([np.einsum("ij,ij->i", q[left[k : k + 65536]], graph.points[right[k : k + 65536]]) for k in range(0, len(left), 65536)] or [np.zeros(0)])
    good = exact >= cosine
    return left[good], right[good], (min(beam, n), measured)


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes with their checksum; null where a row can have no link."""
    for batch in batches:
        widths, units, keys = [], [], []
        for ident, label, vector in zip(*(batch.column(k).to_pylist() for k in range(3))):
            unit = None
            if ident is not None and label is not None and vector and None not in vector:
                x = np.array(vector, np.float64)
                largest = np.abs(x).max()
                if np.isfinite(largest) and largest > 0:  # scaled first, so that no square overflows or vanishes
                    x = x / largest
                    unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
            widths.append(len(vector) if unit is not None else None)
            units.append(unit)
            keys.append(hashlib.sha256(unit).hexdigest() if unit is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(widths, pa.int32()), pa.array(units, pa.binary()), pa.array(keys, pa.string()), batch.column(3)], ["vec_id", "label", "width", "unit", "key", "__id"])


def _build(table: pa.Table) -> pa.Table:
    """One shard: its vectors packed, with their graph."""
    points = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(table.num_rows, -1)
    order = np.argsort(table.column("point").to_numpy(), kind="stable")
    ids, weight = table.column("point").to_numpy()[order], table.column("weight").to_numpy()[order]
    return pa.table({"label": table.column("label").slice(0, 1), "width": table.column("width").slice(0, 1), "shard": table.column("shard").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "weights": pa.array([weight.tobytes()], pa.binary()), "graph": pa.array([Graph(points[order]).save()], pa.binary())})


def _block(table: pa.Table) -> pa.Table:
    return pa.table({"label": table.column("label").slice(0, 1), "width": table.column("width").slice(0, 1), "ids": pa.array([table.column("point").to_numpy().tobytes()], pa.binary()), "units": pa.array([b"".join(table.column("unit").to_pylist())], pa.binary())})


def _ask(cosine: float, recall: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["units"], np.float64).reshape(len(own), -1)
                theirs, weight = np.frombuffer(row["their_ids"], np.int64), np.frombuffer(row["weights"], np.int64)
                left, right, (_, measured) = links_of(Graph.load(row["graph"]), q, cosine, recall=recall)
                other = own[left] != theirs[right]
                left, right = left[other], right[other]
                count = np.bincount(left, weights=weight[right], minlength=len(own)).astype(np.int64)
                a, b = spanning(own[left], theirs[right])
                none = np.full(len(own), -1, np.int64)
                columns = [np.concatenate([own, a]), np.concatenate([none, b]), np.concatenate([count, np.zeros(len(a), np.int64)]), np.full(len(own) + len(a), measured)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["point", "other", "n", "recall"])

    return run


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, shard: int = SHARD, queries: int = QUERIES, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall (the least recall measured among the shards that the vector
    queried; null for vectors that have no query) of every row of vectors."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").alias("__id"))
    shape = f"vec_id long, label string, width int, unit binary, key string, __id {vectors.schema['vec_id'].dataType.simpleString()}"
    rows = written(kept.mapInArrow(_units, shape), "vectors")
    points = rows.filter("unit is not null").groupBy("label", "key").agg(F.min("vec_id").alias("point"), F.count("*").alias("weight"))
    once = rows.join(points, ["label", "key"]).filter("vec_id = point").dropDuplicates(["label", "key"])
    flat = once.select("label", "width", "point", "weight", "unit")
    flat = written(flat, "points")
    sizes = flat.groupBy("label", "width").agg(F.count("*").alias("n"))
    parts = lambda most: F.pmod(F.xxhash64("point"), F.ceil(F.col("n") / most))
    dealt = flat.join(sizes, ["label", "width"]).select("label", "width", "point", "weight", "unit", parts(shard).alias("shard"), parts(queries).alias("block"))
    graphs = written(dealt.select("label", "width", "point", "weight", "unit", "shard").groupBy("label", "width", "shard").applyInArrow(_build, "label string, width int, shard long, ids binary, weights binary, graph binary"), "graphs")
    blocks = dealt.select("label", "width", "point", "unit", "block").groupBy("label", "width", "block").applyInArrow(_block, "label string, width int, ids binary, units binary")
    tasks = blocks.join(graphs.select("label", "width", F.col("ids").alias("their_ids"), "weights", "graph", "shard").hint("merge"), ["label", "width"])
    asked = written(tasks.repartition(F.xxhash64("ids"), "shard").select("ids", "units", "their_ids", "weights", "graph").mapInArrow(_ask(cosine, recall), "point long, other long, n long, recall double"), "answers")
    counts = asked.filter("other = -1").groupBy("point").agg(F.sum("n").alias("n"), F.min("recall").alias("audit_recall"))
    comp = components(asked.filter("other <> -1").select(F.col("point").alias("a"), F.col("other").alias("b")))
    per_point = points.join(counts, "point", "left").join(comp.withColumnRenamed("node", "point"), "point", "left")
    per_point = per_point.select("label", "key", "point", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"), "audit_recall")
    out = rows.join(per_point, ["label", "key"], "left")
    mine = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(F.col("__id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(mine == F.col("vec_id"), F.lit(False)).alias("kept"), "audit_recall")
