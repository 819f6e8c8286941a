"""Proposals and the event journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def superseded(proposals: DataFrame) -> DataFrame:
    """Of pending proposals on one subject and kind only the last stays pending."""
    pending = F.col("status") == "pending"
    last = F.max(F.when(pending, F.col("id"))).over(Window.partitionBy("subject", "kind"))
    return proposals.withColumn("status", F.when(pending & (F.col("id") != last), "superseded").otherwise(F.col("status")))


def pending(proposals: DataFrame, kind: str | None = None, subject: str | None = None, limit: int | None = None) -> DataFrame:
    out = superseded(proposals).filter("status = 'pending'")
    out = out.filter(F.col("kind") == kind) if kind else out
    out = out.filter(F.col("subject") == subject) if subject else out
    out = out.orderBy("id")
    return out.limit(limit) if limit else out


def decided(proposals: DataFrame, ids: list[int], status: str) -> DataFrame:
    """Pending ones of these ids accepted or rejected."""
    return proposals.withColumn("status", F.when(F.col("id").isin(*ids) & (F.col("status") == "pending"), status).otherwise(F.col("status")))


def subject(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


def subject_key(c: Column, kind: str) -> Column:
    return F.when(c.startswith(kind + ":"), F.substring(c, len(kind) + 2, 1 << 30))


def applied_types(asr: DataFrame, proposals: DataFrame) -> DataFrame:
    """asr with the recording type of the last accepted proposal on each document."""
    key = F.try_to_number(subject_key(F.col("subject"), "doc"), F.lit("999999999999")).cast("long")
    won = proposals.filter("status = 'accepted' and kind = 'recording_type'").groupBy(key.alias("p_doc")).agg(F.max_by("value", "id").alias("value"))
    return asr.join(won, asr["doc_id"] == won["p_doc"], "left").withColumn("recording_type", F.coalesce("value", "recording_type")).select(*asr.columns)


def since(events: DataFrame, after: int, limit: int = 500) -> DataFrame:
    return events.filter(F.col("id") > after).orderBy("id").limit(limit)


def appended(events: DataFrame, kind: str, payload: DataFrame) -> DataFrame:
    """events with one row for each row of payload, its columns as compact JSON, numbered on.

    Numbers come from counts over ranges of the payloads' hashes, so that no task sees all rows."""
    top = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = payload.select(F.to_json(F.struct("*")).alias("payload")).withColumn("__cell", F.pmod(F.xxhash64("payload"), F.lit(4096)))
    sizes = rows.groupBy("__cell").agg(F.count("*").alias("__c"))
    before = sizes.select("__cell", (F.sum("__c").over(Window.orderBy("__cell")) - F.col("__c")).alias("__before"))  # 4,096 rows at most
    placed = rows.withColumn("__own", F.row_number().over(Window.partitionBy("__cell").orderBy("payload"))).join(F.broadcast(before), "__cell").crossJoin(F.broadcast(top))
    numbered = placed.select((F.col("top") + F.col("__before") + F.col("__own")).alias("id"), F.lit(kind).alias("kind"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), "payload")
    return events.unionByName(numbered)


def _field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def spelled(payload: Column) -> Column:
    """A flat JSON object as the notifier spells it: single quotes, None, True and False."""
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(payload, r":\s*null\b", ": None"), r":\s*true\b", ": True"), r":\s*false\b", ": False")
    return F.translate(words, '"', "'")


def toasts(events: DataFrame, app: str = "Documents") -> DataFrame:
    """id, title and body of events that people are told of: finished runs with something ready, else failures, errors,
    the older `processed` events, and any other kind with its payload; starts and ends of scans are silent."""
    ready, failed = F.coalesce(_field("ready_count").try_cast("int"), F.lit(0)), F.coalesce(_field("failed").try_cast("int"), F.lit(0))
    kind = F.col("kind")
    ended = kind == "digest_finished"
    said = lambda n: F.coalesce(_field(n), F.lit("?"))
    count = F.concat(ready.cast("string"), F.when(ready == 1, " file").otherwise(" files"), F.lit(" ready for triage"))
    silent = kind.isin("scan_finished", "digest_started", "scan_started") | (ended & (ready <= 0) & (failed <= 0))
    title = F.when(silent, None).when((ended & (ready <= 0)) | (kind == "error"), "Error").otherwise(app)
    filed = F.concat(said("file"), F.lit(" → "), said("category"), F.coalesce(F.concat(F.lit(" ("), F.nullif(_field("target"), F.lit("")), F.lit(")")), F.lit("")))
    name = F.coalesce(F.nullif(_field("file"), F.lit("")), F.lit("?"))
    body = (
        F.when(ended & (ready > 0), count).when(ended, F.concat(F.lit("failed to digest "), name)).when(kind == "error", F.concat(said("file"), F.lit(": "), said("error")))
        .when(kind == "processed", filed).otherwise(F.concat(kind, F.lit(": "), spelled(F.col("payload"))))
    )
    return events.select("id", title.alias("title"), body.alias("body")).filter("title is not null")


def run_state(events: DataFrame) -> DataFrame:
    """What runs after the last event: a label, or null if the last start has ended."""
    label = F.when(F.col("kind") == "digest_started", F.when(_field("scope") == "tree", F.coalesce(F.concat(F.lit("Digesting "), _field("count"), F.lit(" files…")), F.lit("Digesting…"))).otherwise(F.concat(F.lit("Digesting "), F.coalesce(_field("file"), F.lit("…"))))).when(F.col("kind") == "scan_started", "Scanning…")
    states = events.filter(F.col("kind").isin("digest_started", "digest_finished", "scan_started", "scan_finished")).select("id", label.alias("label"))
    return states.agg(F.max("id").alias("id"), F.max_by("label", "id").alias("label"))


def debounced(events: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Notifications: the first event opens a window of fixed length, its end sends one with the count and the last event.

    There is one window at a time for events of all kinds. A window cannot outlast a pause of its own length, so events
    are parted at such pauses, and each stretch is worked through whole, with those of its hour. Pauses are found within
    hours, and at the hours' ends from one row an hour."""
    import pandas as pd

    hour = F.date_trunc("hour", "ts")
    order = Window.partitionBy("__hour").orderBy("ts", "id")
    rows = events.select("id", "ts", hour.alias("__hour")).filter("ts is not null")
    ends = rows.groupBy("__hour").agg(F.max("ts").alias("__end"))
    earlier = ends.select("__hour", F.lag("__end").over(Window.orderBy("__hour")).alias("__earlier"))
    gap = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) >= int(seconds * 1_000_000)
    marked = rows.join(earlier, "__hour").withColumn("__last", F.coalesce(F.lag("ts").over(order), F.col("__earlier")))
    opens = marked.withColumn("__open", F.when(F.col("__last").isNull() | gap(F.col("__last"), F.col("ts")), F.col("ts")))
    tops = opens.groupBy("__hour").agg(F.max("__open").alias("__top"))
    carried = tops.select("__hour", F.max("__top").over(Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    stretch = F.coalesce(F.max("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("__carried"))
    parted = opens.join(carried, "__hour").withColumn("stretch", stretch).select("stretch", "id", "ts")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        told, opened, count, last = [], None, 0, None
        for at, what in frame.sort_values(["ts", "id"])[["ts", "id"]].itertuples(index=False):
            if opened is not None and (at - opened).total_seconds() >= seconds:
                told.append((opened, count, last))
                opened = None
            if opened is None:
                opened, count = at, 0
            count, last = count + 1, what
        if opened is not None:
            told.append((opened, count, last))
        return pd.DataFrame(told, columns=["opened", "n", "last_id"])

    return parted.groupBy(F.date_trunc("hour", "stretch")).applyInPandas(fold, "opened timestamp_ntz, n long, last_id long")


def notice(n: Column, title: Column, body: Column, app: str = "Documents") -> Column:
    """What a window sends: a lone notification as it is, else the count and the last one's title."""
    many = F.struct(F.lit(app).alias("title"), F.concat(F.lit("Processed "), n.cast("string"), F.lit(" files; latest: "), title).alias("body"))
    return F.when(n > 1, many).otherwise(F.struct(title.alias("title"), body.alias("body")))
