"""Duplicate state by content hash: unique, dup or keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashes_to_recompute(docs: DataFrame) -> DataFrame:
    """Hashes of two rows or more, and those with a state other than unique."""
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.count_if(F.col("dup") != "unique").alias("odd")).filter("n >= 2 or odd > 0").select("hash")


def recomputed(docs: DataFrame) -> DataFrame:
    """A lone row is unique; in a group unique becomes dup and keep stays. Counts are summed before they are dealt by hash,
    and joined back, so that a hash of very many rows is not sorted in one task."""
    many = docs.groupBy("hash").agg(F.count("*").alias("__n")).filter("__n > 1").withColumnRenamed("hash", "__hash")
    joined = docs.join(many, F.col("hash").eqNullSafe(F.col("__hash")) & F.col("__n").isNotNull(), "left")
    state = F.when(F.col("__n").isNull(), "unique").when(F.col("dup") == "unique", "dup").otherwise(F.col("dup"))
    return joined.withColumn("dup", state).select(*docs.columns)


def siblings(docs: DataFrame) -> DataFrame:
    """doc_id, and the paths of its dup and keep siblings, of rows that have one: a list for each hash, less the row itself."""
    state = recomputed(docs).select("id", "hash", "path", "dup")
    group = state.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("path", "id", "dup"))).alias("__all")).filter(F.size("__all") > 1)
    joined = state.join(group, "hash")
    join = lambda kind: F.array_join(F.transform(F.filter("__all", lambda x: (x["dup"] == kind) & (x["id"] != F.col("id"))), lambda x: x["path"]), ";")
    return joined.select(F.col("id").alias("doc_id"), join("dup").alias("dup_paths"), join("keep").alias("keep_paths"))


def set_state(docs: DataFrame, doc_id: int, state: str, inbox: str = "Inbox") -> DataFrame:
    """The state goes to the document and its siblings outside the inbox; the hash is recomputed then."""
    target = docs.filter(F.col("id") == doc_id).select(F.col("hash").alias("h")).limit(1)
    marked = docs.join(F.broadcast(target), docs["hash"] == F.col("h"), "left")
    change = F.col("h").isNotNull() & ((F.col("id") == doc_id) | ~F.col("path").startswith(inbox + "/"))
    return recomputed(marked.withColumn("dup", F.when(change, state).otherwise(F.col("dup"))).drop("h"))
