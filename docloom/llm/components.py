"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group minimum and a join, so a node with very many links costs a skewed join that the engine splits,
never one task's memory. Each round is written to the shared folder; the driver sees counts alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._spark import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or not larger (small star) neighbours to its least one."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        tied = down.join(least, down["a"] == least["n"])
        moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its least reachable node, itself included) of every node that has a link; edges are (a, b)."""
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seal = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    sign = seal(current)
    for _ in range(most_rounds):
        current = written(_star(_star(current, True), False), "links")
        now = seal(current)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to the least point of each component of these links: one for every other point."""
    if not len(a):
        return a, b
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new[root] == root).all():
            break
        root = new[root]
    far = np.flatnonzero(root != np.arange(len(names)))
    return names[far], names[root[far]]
