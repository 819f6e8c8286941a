"""Hard negatives: a distributed nearest-neighbour join over Voronoi cells.

Inner products become distances: a candidate x gets one more component, sqrt(M - |x|^2), an anchor q gets 0, where M is the
largest squared norm; then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest candidates are those of highest score. Candidates and
anchors go to the nearest of at most `PIVOTS` pivots. The anchors of a cell form groups of at most `BLOCK`; of a group the
driver knows its pivot, its radius, and the range of distances in which something can still serve one of its anchors. Each
join runs twice: first every candidate goes to the groups of its own cell, which gives every anchor a bound; then a candidate
goes to another cell's groups only if the triangle inequality and the plane between the two pivots allow it inside their range.
A group's candidates are dealt over slices of about `SLICE`, joined exactly, and each slice gives a few rows an anchor.

The join for positives takes an anchor's label alone (labels share the groups by `BUCKETS` hashes), that for negatives all
other labels, between the scores that the positives allow. Equal vectors of one label are one candidate with its smallest
vec_ids, as many as can matter, and equal anchors are joined once: copies cost one row, whatever their number.

Defined results: rows without vec_id, label or vector, and those with null or non-finite components (or a floor beyond
`_vectors.LARGEST`, whose scores need not fit a long) take no part; shorter vectors are continued by zeros; a row that is
repeated whole counts once, rows of one vec_id that differ are different rows; an anchor without positives, or a positive
without negatives in range, has no rows (a positive of a score below 0 never has any); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._spark import written
from docloom.llm._vectors import floors, usable, width

#: Pivots: one for each CELL anchors, so that a candidate's copies do not grow with the anchors while few groups hold all.
PIVOTS = 256
CELL = 512
BLOCK = 2048
SLICE = 65536
BUCKETS = 16
FACTOR = 256
_SALTS = 32
# Candidates and anchors whose scores are held at once.
_CHUNK = 4096
_ROWS = 128
_OWN = "key binary, label long, vec binary, norm long, ids array<long>"


def _combined(rows: DataFrame, length: int, most: int) -> DataFrame:
    """One row for each vector and label of a batch: its smallest vec_ids and whether an anchor is among all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            vectors = floors(batch.column(2), FACTOR, length)
            anchor = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            whole = np.ascontiguousarray(np.column_stack([labels, vectors]))
            _, first, group = np.unique(whole.view([("", np.void, whole.shape[1] * 8)]).ravel(), return_index=True, return_inverse=True)
            group = group.ravel()
            order = np.lexsort((ids, group))
            new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])])
            order = order[new]
            start = np.searchsorted(group[order], np.arange(len(first)))
            rank = np.arange(len(order)) - start[group[order]]
            order = order[rank < most]
            ends = np.searchsorted(group[order], np.arange(len(first)), "right")
            held = vectors[first].astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.md5(whole[k].tobytes()).digest() for k in first], pa.binary()), pa.array(labels[first]), pa.array([v.tobytes() for v in held], pa.binary()),
                    pa.array((vectors[first] ** 2).sum(1)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids[order])),
                    pa.array(np.bincount(group, anchor, len(first)) > 0), pa.array(np.full(len(first), number % _SALTS), pa.int32()),
                ],
                names=["key", "label", "vec", "norm", "ids", "anchor", "salt"],
            )

    return rows.select("vec_id", "label", "embedding", "anchor").mapInArrow(run, f"{_OWN}, anchor boolean, salt int")


def _classes(rows: DataFrame, length: int, most: int) -> DataFrame:
    """key, label, vec, norm, ids and anchor of every distinct vector and label."""
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    each = [*(F.first(c).alias(c) for c in ("label", "vec", "norm")), smallest, F.max("anchor").alias("anchor")]
    salted = F.pmod(F.spark_partition_id() + F.col("salt"), F.lit(_SALTS)).alias("salt")
    return _combined(rows, length, most).select("key", "label", "vec", "norm", "ids", "anchor", salted).groupBy("key", "salt").agg(*each).groupBy("key").agg(*each)


@dataclass
class Space:
    """Pivots among the candidates, in the space of one more component."""

    pivots: np.ndarray
    norms: np.ndarray
    most: float
    length: int

    def distances(self, vectors: np.ndarray, norms: np.ndarray, anchors: bool) -> np.ndarray:
        """From each vector (an anchor has 0 for the last component) to each pivot."""
        product = vectors.astype(np.float64) @ self.pivots.T.astype(np.float64)
        if anchors:
            square = norms[:, None].astype(np.float64) + self.most - 2 * product
        else:
            product += np.sqrt(np.maximum(self.most - norms.astype(np.float64), 0))[:, None] * np.sqrt(np.maximum(self.most - self.norms, 0))
            square = 2 * (self.most - product)
        return np.sqrt(np.maximum(square, 0))

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-6 * math.sqrt(self.most) + 1e-9


@dataclass
class Groups:
    """The groups of anchors: cell, bucket, radius, range of distances, first block, blocks and slices of each."""

    cell: np.ndarray
    bucket: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    buckets: int
    slices: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.size // BLOCK)

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks


def _vectors_of(column: pa.Array, length: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<i4").reshape(len(column), length).astype(np.int64)


def _hash_of(keys: pa.Array) -> np.ndarray:
    """63 bits of each key."""
    return np.frombuffer(b"".join(k[:8] for k in keys.to_pylist()), "<i8") & (2**63 - 1)


def _celled(anchors: DataFrame, space: Space) -> DataFrame:
    """Anchors with their cell and the distance to its pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.distances(_vectors_of(batch.column(2), space.length), batch.column(3).to_numpy(), True)
            cell = far.argmin(1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], names=["key", "label", "vec", "norm", "cell", "dist"])

    return anchors.select("key", "label", "vec", "norm").mapInArrow(run, "key binary, label long, vec binary, norm long, cell int, dist double")


def _grouped(anchors: DataFrame, space: Space, buckets: int) -> Groups:
    """Groups of anchors (with columns least and most: the scores between which something can serve them). At most PIVOTS
    times `buckets` rows come to the driver."""
    away = lambda score: F.sqrt(F.greatest(F.col("norm") + F.lit(space.most) - 2 * F.col(score), F.lit(0.0)))
    rows = (
        anchors.groupBy("cell", F.pmod("label", F.lit(buckets)).alias("bucket"))
        .agg(F.max("dist"), F.min(F.when(F.col("most").isNull(), F.lit(0.0)).otherwise(away("most"))), F.max(F.when(F.col("least").isNull(), F.lit(math.inf)).otherwise(away("least"))), F.count("*"))
        .orderBy("cell", "bucket")
        .collect()
    )
    column = lambda k, kind: np.array([r[k] for r in rows], kind)
    return Groups(column(0, np.int64), column(1, np.int64), column(2, float), column(3, float), column(4, float), column(5, np.int64), buckets, np.ones(len(rows), np.int64))


def _pairs(batch: pa.RecordBatch, space: Space, groups: Groups, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and group of every candidate of a batch and group that it might serve: in its own cell, or in the others."""
    far = space.distances(_vectors_of(batch.column(2), space.length), batch.column(3).to_numpy(), False)
    own = far.argmin(1)
    bucket = np.mod(batch.column(1).to_numpy(), groups.buckets)
    between = space.distances(space.pivots, space.norms, False)
    rows, found = [], []
    for b in range(groups.buckets):
        some, held = np.flatnonzero(bucket == b), np.flatnonzero(groups.bucket == b)
        if not len(some) or not len(held):
            continue
        cell, at_home = groups.cell[held], groups.cell[held][None, :] == own[some][:, None]
        if home:
            row, group = np.nonzero(at_home)
        else:
            to, mine = far[np.ix_(some, cell)], far[some, own[some]][:, None]
            apart = between[np.ix_(own[some], cell)]
            plane = np.where(apart > 1e-3 * math.sqrt(space.most), (to**2 - mine**2) / np.maximum(2 * apart, 1e-300), 0)
            nearest, farthest = np.maximum(to - groups.radius[held], plane) - space.slack, to + groups.radius[held] + space.slack
            row, group = np.nonzero(~at_home & (nearest <= groups.high[held]) & (farthest >= groups.low[held]))
        rows.append(some[row])
        found.append(held[group])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def _counted(candidates: DataFrame, space: Space, groups: Groups, home: bool) -> np.ndarray:
    """How many candidates each group gets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups.cell), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_pairs(batch, space, groups, home)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    out = np.zeros(len(groups.cell), np.int64)
    for g, n in candidates.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n")).collect():  # one row a group
        out[g] = n
    return out


def _served(candidates: DataFrame, space: Space, groups: Groups, home: bool) -> DataFrame:
    """Candidates with the blocks of anchors that they might serve, and a slice of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, group = _pairs(batch, space, groups, home)
            blocks = groups.blocks[group]
            row, group = np.repeat(row, blocks), np.repeat(group, blocks)
            block = groups.first[group] + np.arange(len(group)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            piece = _hash_of(batch.column(0))[row] % groups.slices[group]
            for at in range(0, len(row), 8192):
                some = slice(at, at + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(block[some]), pa.array(piece[some]), *batch.take(pa.array(row[some])).columns], names=["block", "slice", "key", "label", "vec", "norm", "ids"])

    return candidates.mapInArrow(run, f"block long, slice long, {_OWN}")


def _blocked(anchors: DataFrame, groups: Groups) -> DataFrame:
    """Anchors with their block, once for each of its slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, bucket = batch.column(4).to_numpy().astype(np.int64), np.mod(batch.column(1).to_numpy(), groups.buckets)
            group = np.searchsorted(groups.cell * groups.buckets + groups.bucket, cell * groups.buckets + bucket)
            block = groups.first[group] + _hash_of(batch.column(0)) % groups.blocks[group] if len(group) else np.zeros(0, np.int64)
            slices = groups.slices[group]
            row = np.repeat(np.arange(len(group)), slices)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(slices) - slices, slices)
            held = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(block[row]), pa.array(piece), *(held.column(k) for k in (0, 1, 2, 5))], names=["block", "slice", "key", "label", "vec", "targets"])

    return anchors.select("key", "label", "vec", "norm", "cell", "targets").mapInArrow(run, "block long, slice long, key binary, label long, vec binary, targets array<long>")


def nearest(anchors: np.ndarray, labels: np.ndarray, targets: list[list[int] | None], vectors: np.ndarray, own: np.ndarray, ids: list[list[int]], most: int, lowest: Callable[[int], int]) -> tuple[np.ndarray, ...]:
    """Anchor, target, score and candidate's place and vec_id of the first `most` (by falling score, then vec_id) for each
    anchor and target: candidates of other labels that score from lowest(target) to target; without targets, those of the
    anchor's label."""
    safe = float(np.sqrt((anchors.astype(float) ** 2).sum(1)).max(initial=0)) * float(np.sqrt((vectors.astype(float) ** 2).sum(1)).max(initial=0)) < 2.0**52
    kind, nothing = (np.float64, -np.inf) if safe else (np.int64, np.iinfo(np.int64).min)
    same = targets[0] is None
    query = np.repeat(np.arange(len(anchors)), [1 if same else len(t) for t in targets])
    high = np.zeros(len(query), np.int64) if same else np.array([t for ts in targets for t in ts], np.int64)
    low = high if same else np.array([lowest(int(t)) for t in high], np.int64)
    best = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, score, place, vec_id
    worst = np.full(len(query), nothing, kind)
    count, flat = np.array([len(x) for x in ids], np.int64), np.array([v for x in ids for v in x], np.int64)
    begin = np.cumsum(count) - count
    a = anchors.astype(kind)
    for at in range(0, len(vectors), _CHUNK):
        x = vectors[at : at + _CHUNK].astype(kind)
        scores = (a @ x.T)[query]
        equal = labels[query][:, None] == own[at : at + _CHUNK][None, :]
        held = np.where(equal if same else ~equal & (scores <= high[:, None]) & (scores >= low[:, None]), scores, nothing)
        floor = worst
        if held.shape[1] > most:
            floor = np.maximum(floor, np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most])
        row, place = np.nonzero((held >= floor[:, None]) & (held != nothing))
        score, place = held[row, place].astype(np.int64), place + at
        n = count[place]
        each = np.repeat(begin[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        joint = [np.concatenate(p) for p in zip(best, (np.repeat(row, n), np.repeat(score, n), np.repeat(place, n), flat[each]), strict=True)]
        order = np.lexsort((joint[3], -joint[1], joint[0]))
        rows = joint[0][order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order = order[rank < most]
        best = tuple(p[order] for p in joint)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(query)) >= most)
        worst[full] = best[1][np.searchsorted(best[0], full, "right") - 1]
    return query[best[0]], high[best[0]], best[1], best[2], best[3]


def _joined(anchors: DataFrame, candidates: DataFrame, space: Space, groups: Groups, total: int, home: bool, most: int, lowest: Callable[[int], int]) -> DataFrame:
    """key (the anchor's), target, score, id and of (the candidate's key): what each block's slices found."""
    if total > SLICE:
        groups = replace(groups, slices=np.maximum(-(-_counted(candidates, space, groups, home) // SLICE), 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([("key", pa.binary()), ("target", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("of", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        a, x = (_vectors_of(t["vec"].combine_chunks(), space.length) for t in (left, right))
        labels, targets, own, held = left["label"].to_numpy(), left["targets"].to_pylist(), right["label"].to_numpy(), right["ids"].to_pylist()
        found = []
        for at in range(0, len(a), _ROWS):
            some = slice(at, at + _ROWS)
            who, *rest = nearest(a[some], labels[some], targets[some], x, own, held, most, lowest)
            found.append((who + at, *rest))
        who, target, score, place, ids = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_arrays([left["key"].combine_chunks().take(pa.array(who)), pa.array(target), pa.array(score), pa.array(ids), right["key"].combine_chunks().take(pa.array(place))], schema=names)

    return _blocked(anchors, groups).groupBy("block", "slice").cogroup(_served(candidates, space, groups, home).groupBy("block", "slice")).applyInArrow(run, "key binary, target long, score long, id long, of binary")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` for each anchor and target, over all slices."""
    order = Window.partitionBy("key", "target").orderBy(F.desc("score"), "id", "of")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, label, embedding,
    anchor): for each anchor and each of its first `positives` rows of its label, the first `negatives` rows of other labels
    that score from `low` to `high` hundredths of the positive's score (`high` is 100)."""
    if high != 100:
        raise ValueError("high is 100: a negative scores at most what the positive does")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"), FACTOR))
    length = max(width(rows, "embedding"), 1)
    lowest = lambda p: -(-low * p // 100)
    most = positives + 1  # the anchor itself may be among them
    classes = written(_classes(rows, length, max(most, negatives)), "vector-classes")
    total, anchors, largest = classes.agg(F.count("*"), F.count_if("anchor"), F.max("norm")).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        return rows.sparkSession.createDataFrame([], shape)
    pivots = classes.orderBy("key").limit(min(-(-anchors // CELL), PIVOTS)).select("vec", "norm").collect()
    space = Space(np.stack([np.frombuffer(r["vec"], "<i4") for r in pivots]).astype(np.int64), np.array([r["norm"] for r in pivots], float), float(largest), length)
    candidates = classes.drop("anchor")

    def join(side: DataFrame, buckets: int, k: int) -> DataFrame:
        """side: anchors with targets, least and most. In their own cells first, then where what was found leaves room."""
        near = written(_joined(side, candidates, space, _grouped(side, space, buckets), total, True, k, lowest), "mined-home")
        full = _first(near, k).filter(F.col("rank") == k).groupBy("key").agg(F.count("*").alias("full"), F.min("score").alias("last"))
        # scores below that of the last place of every target serve no more
        tight = F.when(F.col("full") == F.when(F.col("targets").isNull(), 1).otherwise(F.size("targets")), F.col("last")).otherwise(F.col("least"))
        bounded = written(side.join(full, "key", "left").withColumn("least", tight).drop("full", "last"), "mined-bounds")
        return _first(near.unionByName(_joined(bounded, candidates, space, _grouped(bounded, space, buckets), total, False, k, lowest)), k)

    nothing = F.lit(None)
    celled = written(_celled(classes.filter("anchor"), space), "anchors")
    found = written(join(celled.withColumns({"targets": nothing.cast("array<long>"), "least": nothing.cast("long"), "most": nothing.cast("long")}), BUCKETS, most), "positives")
    lists = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "of"))).alias("found"))  # at most `most`
    scores = F.array_distinct(F.filter(F.transform("found", lambda f: f["score"]), lambda s: s >= 0))
    asked = celled.join(lists, "key").withColumn("targets", scores).filter(F.size("targets") > 0)
    floor = (F.floor(F.array_min("targets") * low / 100) - 1).alias("least")  # or one less: the division is not exact
    ranged = written(asked.select("key", "label", "vec", "norm", "cell", "dist", "targets", floor, F.array_max("targets").alias("most")), "anchors-asked")
    last = join(ranged, 1, negatives)
    by_target = last.groupBy("key", "target").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("negatives"))  # at most `negatives`
    sought = found.select("key", F.col("rank").alias("place"), F.col("score").alias("target"), "id", "of").join(by_target, ["key", "target"], "left")
    packs = sought.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "id", "of", "target", "negatives"))).alias("positives"))
    own = _combined(rows.filter("anchor"), length, 1 << 30).select("key", F.explode("ids").alias("anchor_id")).distinct()
    others = F.slice(F.filter("positives", lambda p: (p["id"] != F.col("anchor_id")) | (p["of"] != F.col("key"))), 1, positives)
    each = own.join(packs, "key").select("anchor_id", F.explode(others).alias("p")).select("anchor_id", "p.id", "p.target", F.explode("p.negatives").alias("n"))
    return each.select("anchor_id", F.col("id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("target").alias("positive_score"), F.col("n.score").alias("negative_score"))
