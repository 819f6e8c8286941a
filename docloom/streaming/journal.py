"""Streams over the event journal and the inbox folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.journal import toasts
from docloom.store import EVENTS, Store


def events(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """The journal's appended files as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def notify(journal: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, muted: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Every batch's notifications to a sink; a muted batch moves the cursor all the same."""

    def each(batch: DataFrame, number: int) -> None:
        if not muted():
            sink(toasts(batch), number)

    return journal.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """New and changed files of a folder; dot files and half-written ones are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.startswith(".") & ~F.lower(name).rlike(r"\.(tmp|part|crdownload)$")).select("path", "modificationTime", "length")


def once_each(files: DataFrame, within: str = "10 minutes") -> DataFrame:
    """One row for a burst of events on one path."""
    return files.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["path"])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change, length and modificationTime between two listings: created, modified or deleted, which file streams cannot see."""
    both = before.select("path", F.col("length").alias("l0"), F.col("modificationTime").alias("m0")).join(after.select("path", F.col("length").alias("l1"), F.col("modificationTime").alias("m1")), "path", "full_outer")
    change = F.when(F.col("l0").isNull(), "created").when(F.col("l1").isNull(), "deleted").when((F.col("l0") != F.col("l1")) | (F.col("m0") != F.col("m1")), "modified")
    return both.select("path", change.alias("change"), F.coalesce("l1", "l0").alias("length"), F.coalesce("m1", "m0").alias("modificationTime")).filter("change is not null")


class Settled(StatefulProcessor):
    """Emits a path once two looks in a row give the same size over zero; gives up after `most` looks."""

    most = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "length long, looks int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        length, looks = self.last.get() if self.last.exists() else (-1, 0)
        out = []
        for frame in rows:
            for now in frame.sort_values("seen")["length"]:
                if looks < self.most and now == length and now > 0:
                    out.append((key[0], int(now)))
                    looks, length = 0, -1
                    continue
                length, looks = int(now), looks + 1
        self.last.update((length, looks))
        yield pd.DataFrame(out, columns=["path", "length"])

    def close(self) -> None:
        pass


def settled(looks: DataFrame) -> DataFrame:
    """Paths that have stopped growing, of a stream of looks (path, length, seen)."""
    return looks.groupBy("path").transformWithStateInPandas(Settled(), "path string, length long", "Append", "None")


class Debounced(StatefulProcessor):
    """The first event opens a window of `seconds`; a timer set then ends it, sends one notice with the count and the last
    event, and drops the state. The clock is the events' own (`EventTime`: timers follow the watermark) or the machine's."""

    def __init__(self, seconds: float, event_time: bool):
        self.length, self.event_time = int(seconds * 1000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n long, last_id long, title string, body string")

    def _sent(self, key) -> pd.DataFrame:
        opened, n, last, title, body = self.window.get()
        self.window.clear()
        return pd.DataFrame([(key[0], pd.Timestamp(opened, unit="ms"), n, last, title, body)], columns=["channel", "opened", "n", "last_id", "title", "body"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "id"])
        for at, last, title, body in frame[["ts", "id", "title", "body"]].itertuples(index=False):
            now = int(at.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if self.window.exists() and now >= self.window.get()[0] + self.length:
                self.handle.deleteTimer(self.window.get()[0] + self.length)
                yield self._sent(key)
            if not self.window.exists():
                self.handle.registerTimer(now + self.length)
                self.window.update((now, 1, int(last), title, body))
            else:
                opened, n, *_ = self.window.get()
                self.window.update((opened, n + 1, int(last), title, body))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists():
            yield self._sent(key)

    def close(self) -> None:
        pass


def debounced(told: DataFrame, seconds: float = 5.0, event_time: bool = False) -> DataFrame:
    """One row for each window of a stream of notifications (channel, id, ts, title, body; one window at a time in a
    channel): channel, opened, n, last_id, title and body as `operators.journal.notice` words them. With event_time, ts
    needs a watermark."""
    from docloom.operators.journal import notice

    rows = told.select("channel", "id", "ts", "title", "body")
    out = rows.groupBy("channel").transformWithStateInPandas(Debounced(seconds, event_time), f"{told.select('channel').schema['channel'].simpleString().replace(':', ' ')}, opened timestamp, n long, last_id long, title string, body string", "Append", "EventTime" if event_time else "ProcessingTime")
    said = notice(F.col("n"), F.col("title"), F.col("body"))
    return out.select("channel", "opened", "n", "last_id", said["title"].alias("title"), said["body"].alias("body"))


def moves(changed: DataFrame) -> DataFrame:
    """path, target and change of changes between listings (path, change, length, modificationTime): what is deleted in one
    place and created in another with the same size and time has moved, the k-th such path to the k-th."""
    side = F.when(F.col("change").isin("created", "deleted"), F.col("change"))
    own = changed.withColumn("side", side)
    place = F.row_number().over(Window.partitionBy("length", "modificationTime", "side").orderBy("path"))
    gone, new = (own.filter(F.col("side") == s).withColumn("k", place) for s in ("deleted", "created"))
    keys = ["length", "modificationTime", "k"]
    met = gone.select("path", *keys).join(new.select(F.col("path").alias("target"), *keys), keys, "full_outer")
    paired = met.select(F.coalesce("path", "target").alias("path"), F.when(F.col("path").isNotNull(), F.col("target")).alias("target"), F.when(F.col("path").isNull(), "created").when(F.col("target").isNull(), "deleted").otherwise("moved").alias("change"))
    return paired.unionByName(own.filter("change = 'modified'").select("path", F.lit(None).cast("string").alias("target"), "change"))


def listings(ticks: DataFrame, store: Store, listing: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, table: str = "listing", **trigger) -> StreamingQuery:
    """A listing at each tick against the one before, kept as a table of a store: what was created, modified, deleted or moved
    goes to the sink with the batch's number (path, target, change). A listing is committed with its batch's number before
    the sink is called; a batch that is done again after a failure finds the two listings of its first try and gives the
    sink the same changes. The first listing is the base and tells nothing."""

    def each(batch: DataFrame, number: int) -> None:
        mark = f"{table} of batch"
        known = {s[mark]["batch"]: (s[table]["entry"], s[mark]["before"]) for s in map(store.log.entry, store.log.numbers()[-64:]) if mark in s}
        if number not in known:
            base = lambda seen: seen.number if seen.exists(table) else None
            now = lambda seen: {table: listing().select("path", "length", "modificationTime")}
            entry = store.transact(now, note=lambda seen: {mark: {"batch": number, "before": base(seen)}})
            known[number] = entry, store.log.entry(entry)[mark]["before"]
        at, earlier = known[number]
        if earlier is not None:
            sink(moves(changes(store.snapshot(earlier).read(table), store.snapshot(at).read(table))), number)

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(files: DataFrame, docs: Callable[[], DataFrame], dirs: Callable[[], DataFrame], digest: Callable[[DataFrame], DataFrame | None], failed: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Settled files (rel, size, mtime, hash) reconciled batch by batch: what is new or changed goes to `digest` as (rel,
    action), files in opaque directories to nobody. `digest` returns rel and error of the files that it could not take, or
    None; those go to `failed`, and the others are digested all the same. An error of the whole batch ends the query before
    its checkpoint moves on, so that a restart takes the batch again."""
    from docloom.operators.directories import opaque_ancestors
    from docloom.operators.lifecycle import routed
    from docloom.operators.reconcile import outcomes

    def each(batch: DataFrame, number: int) -> None:
        named = batch.select(F.col("rel").alias("id"), F.col("rel").alias("path"))
        seen = batch.join(opaque_ancestors(named, dirs()).select(F.col("id").alias("rel")), "rel", "left_anti")
        errors = digest(routed(outcomes(seen, docs())).filter("action <> 'ignore'"))
        if errors is not None:
            failed(errors.select("rel", "error"))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(docs: DataFrame, deleted: DataFrame, dirs: DataFrame) -> DataFrame:
    """docs without the rows of deleted paths (path), but those in opaque directories stay."""
    from docloom.operators.directories import opaque_ancestors

    gone = docs.join(deleted.select("path").distinct(), "path", "left_semi").select("id", "path")
    hidden = opaque_ancestors(gone, dirs).select("id")
    return docs.join(gone.join(hidden, "id", "left_anti").select("id"), "id", "left_anti")
