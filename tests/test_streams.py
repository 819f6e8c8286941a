"""The journal as a data source, debounce with timers, listings as a stream, errors by row."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import journal
from docloom.sources import journal_source
from docloom.sources.journal_source import NAME, Journal, JournalSource
from docloom.store import Store
from docloom.streaming import journal as streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


@pytest.fixture
def source(spark):
    spark.dataSource.register(JournalSource)


def events(spark, *names):
    return spark.createDataFrame([("error", json.dumps({"file": n})) for n in names], "kind string, payload string")


def drained(spark, folder, out, check, **options):
    """ids that one run of a stream has told, in order."""
    got = []
    reader = spark.readStream.format(NAME)
    for k, v in options.items():
        reader = reader.option(k, v)
    reader.load(str(folder)).writeStream.foreachBatch(lambda df, n: got.extend(r["id"] for r in df.orderBy("id").collect())).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
    out += got
    return got


def test_appends_are_numbered_on(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(journal_source, "RANGE", 4)
    j = Journal(spark, str(tmp_path))
    assert journal_source.last_id(str(tmp_path)) == 0
    assert j.append(events(spark, *map(str, range(10)))) == (1, 10) and j.append(events(spark)) == (11, 10) and j.append(events(spark, "x", "y")) == (11, 12)
    read = lambda **o: spark.read.format(NAME).options(**o).load(str(tmp_path))
    assert [r["id"] for r in read().orderBy("id").collect()] == list(range(1, 13))
    assert [r["id"] for r in read(after=9).orderBy("id").collect()] == [10, 11, 12] and read(after=12).count() == 0
    assert [(s.after, s.last) for s in journal_source.stretches(str(tmp_path), 2, 12)] == [(2, 6), (6, 10), (10, 12)]
    assert sorted(json.loads(r["payload"])["file"] for r in read(after=10).collect()) == ["x", "y"]


def test_a_stream_tells_each_event_once(spark, source, tmp_path):
    folder, told, check = tmp_path / "j", [], tmp_path / "c"
    j = Journal(spark, str(folder))
    j.append(events(spark, "a", "b"))
    assert drained(spark, folder, told, check, start="0") == [1, 2]
    j.append(events(spark, "c"))
    j.append(events(spark, "d"))
    (folder / "_log" / "000000000099.json.tmp").write_text("half an entry")
    assert drained(spark, folder, told, check, start="0") == [3, 4] and drained(spark, folder, told, check, start="0") == []
    assert told == [1, 2, 3, 4]

    def fails(df, n):
        raise RuntimeError("sink is down")

    j.append(events(spark, "e"))
    query = spark.readStream.format(NAME).load(str(folder)).writeStream.foreachBatch(fails).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="sink is down"):
        query.awaitTermination()
    assert drained(spark, folder, told, check) == [5]


def test_cursors(spark, source, tmp_path):
    folder, file = tmp_path / "j", tmp_path / "cursor"
    j = Journal(spark, str(folder))
    j.append(events(spark, "a", "b", "c"))
    assert drained(spark, folder, [], tmp_path / "c1", cursor=str(file)) == []  # none: after the last
    file.write_text("1\n")
    assert drained(spark, folder, [], tmp_path / "c2", cursor=str(file)) == [2, 3]
    j.append(events(spark, "d"))
    drained(spark, folder, [], tmp_path / "c2", cursor=str(file))
    assert 3 <= int(file.read_text()) <= 4  # moved behind the batch
    file.write_text("not a number")
    assert drained(spark, folder, [], tmp_path / "c3", cursor=str(file)) == [1, 2, 3, 4]
    assert not list(tmp_path.glob("cursor.*")) and journal_source.cursor(str(tmp_path / "nowhere")) is None


def test_payloads_that_are_no_objects(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "[1]"), (3, "broken"), (4, None), (5, "")], "id long, payload string")
    assert {r["id"]: r["payload"] for r in journal_source.plain(rows).collect()} == {1: '{"a": 1}', 2: "{}", 3: "{}", 4: "{}", 5: "{}"}


def test_debounce_has_the_windows_of_the_batch_query(spark, rocks, tmp_path):
    begin = datetime(2024, 1, 1, 0, 0, 0)
    seconds = [0, 1, 4.9, 5, 6, 20, 24, 25.5, 40, 45, 50.2, 90]
    rows = [(k + 1, begin + timedelta(seconds=s)) for k, s in enumerate(seconds)]
    folder, got = tmp_path / "in", []
    for k, part in enumerate((rows[:4], rows[4:9], rows[9:11], rows[11:], [(99, begin + timedelta(days=1))], [(100, begin + timedelta(days=2))])):
        spark.createDataFrame(part, "id long, ts timestamp").coalesce(1).write.mode("append").json(str(folder))
        time.sleep(1.1)
    told = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "0 seconds")
    told = told.select(F.lit("all").alias("channel"), "id", "ts", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("b").alias("body"))
    out = streams.debounced(told, 5.0, event_time=True)
    out.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame(rows, "id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = sorted((r["n"], r["last_id"]) for r in journal.debounced(batch, 5.0).collect())
    assert sorted((r["n"], r["last_id"]) for r in got if r["last_id"] < 99) == want and len(want) == 8
    assert {r["last_id"]: (r["title"], r["body"]) for r in got}[4 - 1] == ("Documents", "Processed 3 files; latest: t3")


def test_a_timer_of_the_clock_ends_a_window(spark, rocks, tmp_path):
    folder, got = tmp_path / "in", []
    spark.createDataFrame([(1, datetime(2024, 1, 1), "one"), (2, datetime(2024, 1, 1), "two")], "id long, ts timestamp, title string").coalesce(1).write.json(str(folder))
    told = spark.readStream.schema("id long, ts timestamp, title string").json(str(folder)).select(F.lit(0).alias("channel"), "id", "ts", "title", F.lit("b").alias("body"))
    query = streams.debounced(told, 0.5).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert [(r["n"], r["body"]) for r in got] == [(2, "Processed 2 files; latest: two")]


def test_listings_see_what_goes_and_moves(spark, tmp_path):
    folder, got = tmp_path / "inbox", []
    (folder / "sub").mkdir(parents=True)
    for k, name in enumerate(("a", "b", "sub/c")):  # of different sizes, as files of one size and time are dealt by name
        (folder / name).write_text(name * (k + 3))
    store, ticks = Store(spark, f"file://{tmp_path}/db"), tmp_path / "ticks"
    listing = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).select("path", "length", "modificationTime")
    down = []

    def sink(df, number):
        rows = sorted((r["path"].split("inbox/")[1], r["target"] and r["target"].split("inbox/")[1], r["change"]) for r in df.collect())
        if down:
            raise RuntimeError(down.pop())
        got.append(rows)

    def tick():
        spark.range(1).write.mode("append").json(str(ticks))
        stream = spark.readStream.schema("id long").json(str(ticks))
        streams.listings(stream, store, listing, sink, str(tmp_path / "c")).awaitTermination()

    tick()
    assert got == []
    (folder / "a").unlink()
    (folder / "b").rename(folder / "sub" / "b2")
    (folder / "new").write_text("fresh text")
    down.append("sink is down")
    with pytest.raises(Exception, match="sink is down"):
        tick()
    (folder / "later").write_text("after the failed try")  # belongs to the next batch, not to the one that is done again
    tick()
    want = [("a", None, "deleted"), ("b", "sub/b2", "moved"), ("new", None, "created")]
    assert got[0] == want
    (folder / "sub" / "c").write_text("changed text")
    tick()
    assert [x for rows in got[1:] for x in rows] == [("later", None, "created"), ("sub/c", None, "modified")]


def test_one_bad_file_does_not_take_its_batch_along(spark, tmp_path):
    shape = "rel string, size long, mtime string, hash string"
    spark.createDataFrame([("Inbox/good", 1, "t", "h1"), ("Inbox/bad", 2, "t", "h2")], shape).coalesce(1).write.json(str(tmp_path / "in"))
    docs = spark.createDataFrame([], "id long, path string, hash string, size long, modified string")
    dirs = spark.createDataFrame([], "path string, mode string, source string")
    good, bad = [], []

    def digest(rows):
        good.extend(r["rel"] for r in rows.filter("rel not like '%bad'").collect())
        return rows.filter("rel like '%bad'").withColumn("error", F.lit("ValueError: no text"))

    files = spark.readStream.schema(shape).json(str(tmp_path / "in"))
    streams.watch(files, lambda: docs, lambda: dirs, digest, lambda e: bad.extend(map(tuple, e.collect())), str(tmp_path / "c")).awaitTermination()
    assert good == ["Inbox/good"] and bad == [("Inbox/bad", "ValueError: no text")]
