"""The filing queue: listing, collapsing directory collections, and the changes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.dups import recomputed

INBOX = "Inbox"


def in_inbox(path: Column, inbox: str = INBOX) -> Column:
    return path.ilike(f"{inbox}/%")


def raw_entries(docs: DataFrame, triage: DataFrame, inbox: str | None = INBOX) -> DataFrame:
    """Queued documents and, for duplicates that are not queued, synthetic entries."""
    state = recomputed(docs).select("id", "path", "digested", "dup")
    scoped = state.filter(in_inbox(F.col("path"), inbox)) if inbox else state
    queued = scoped.join(triage, scoped["id"] == triage["doc_id"]).select(F.col("id").alias("doc_id"), "path", "enqueued_at", "reason")
    spare = scoped.filter("dup = 'dup'").join(triage, scoped["id"] == triage["doc_id"], "left_anti")
    made = spare.select(F.col("id").alias("doc_id"), "path", F.col("digested").alias("enqueued_at"), F.lit("duplicate").alias("reason"))
    return queued.unionByName(made)


def ancestors(path: Column) -> Column:
    """Every directory above a path, the topmost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scopes(entries: DataFrame, dirs: DataFrame, inbox: str = INBOX) -> DataFrame:
    """doc_id and scope of entries under a collection: in the inbox the directory right below it, from any source;
    else the shallowest one a user has set."""
    marks = dirs.filter("mode = 'collection'").select(F.col("path").alias("dir"), "source")
    above = entries.select("doc_id", "path", F.explode(ancestors(F.col("path"))).alias("dir")).filter(F.col("dir") != F.col("path"))
    found = above.join(marks, "dir")
    top = F.col("dir").rlike(f"^{inbox}/[^/]+$") & F.col("path").startswith(f"{inbox}/")
    return found.groupBy("doc_id").agg(F.coalesce(F.min(F.when(top, F.col("dir"))), F.min(F.when(F.col("source") == "user", F.col("dir")))).alias("scope")).filter("scope is not null")


def listed(docs: DataFrame, triage: DataFrame, dirs: DataFrame, inbox: str | None = INBOX) -> DataFrame:
    """Collapsed queue: a row for each collection (its first member's) or single document, in queue order."""
    entries = raw_entries(docs, triage, inbox)
    scoped = entries.join(scopes(entries, dirs), "doc_id", "left")
    keyed = scoped.withColumn("scope_path", F.coalesce("scope", "path")).withColumn("scope_kind", F.when(F.col("scope").isNotNull(), "collection").otherwise("doc"))
    order = Window.partitionBy("scope_kind", "scope_path").orderBy(F.coalesce("enqueued_at", F.lit("")), "doc_id")
    ranked = keyed.withColumn("rn", F.row_number().over(order)).withColumn("member_count", F.count("*").over(Window.partitionBy("scope_kind", "scope_path")))
    return ranked.filter("rn = 1").select("doc_id", "path", "enqueued_at", "reason", "scope_path", "scope_kind", F.col("member_count").cast("long").alias("member_count"))


def first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.coalesce("enqueued_at", F.lit("")), "doc_id").limit(1)


def enqueued(triage: DataFrame, new: DataFrame) -> DataFrame:
    """Latest wins by doc_id."""
    return triage.join(new, "doc_id", "left_anti").unionByName(new.select(*triage.columns))


def rebuilt(docs: DataFrame, triage: DataFrame, now: str, inbox: str = INBOX) -> DataFrame:
    """The queue with every inbox document that lacks an entry."""
    lacking = docs.filter(in_inbox(F.col("path"), inbox)).join(triage, docs["id"] == triage["doc_id"], "left_anti")
    return triage.unionByName(lacking.select(F.col("id").alias("doc_id"), F.lit(now).alias("enqueued_at"), F.lit("rebuild").alias("reason")))


def cleared(docs: DataFrame, triage: DataFrame, inbox: str | None = INBOX) -> DataFrame:
    """What is left after clearing the inbox's entries (or all)."""
    if inbox is None:
        return triage.limit(0)
    gone = docs.filter(in_inbox(F.col("path"), inbox))
    return triage.join(gone, triage["doc_id"] == gone["id"], "left_anti")


def done(docs: DataFrame, triage: DataFrame, dirs: DataFrame, path: str) -> DataFrame:
    """The queue without a document, or without all under it if it is a collection."""
    is_collection = dirs.filter((F.col("path") == path) & (F.col("mode") == "collection")).select(F.lit(True).alias("whole"))
    marked = docs.select("id", "path").crossJoin(F.broadcast(is_collection.limit(1).agg(F.count("*").alias("whole"))))
    gone = marked.filter((F.col("path") == path) | ((F.col("whole") > 0) & F.lower("path").startswith(path.lower() + "/")))
    return triage.join(gone, triage["doc_id"] == gone["id"], "left_anti")
