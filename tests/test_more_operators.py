"""Settings, the stored search index, the watch stream, the store's pointer, and cases that set a rule apart from its like."""

import pytest
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T
from docloom.operators import documents, journal, lifecycle, reconcile, search
from docloom.store import bootstrap
from docloom.streaming import journal as streams


def test_settings_layers():
    text = '{ // a comment\n "docs": "/d//x", /* more */ "ocr": {"min_text_chars": "7", "langs": "eng", "odd": 1,}, "watch": {"settle": 3},}'
    made = config.settings(text, {"DOCLOOM_OCR_LANGS": "fra", "DOCLOOM_WATCH_POLLING": "0.5"})
    assert (made.docs, made.ocr.min_text_chars, made.ocr.langs, made.watch.settle, made.watch.polling, made.inbox) == ("/d//x", 7, "fra", 3.0, 0.5, "Inbox")
    assert config.settings("", {}) == config.Settings()
    assert config.coerced("a, b", ("x",)) == ("a", "b") and config.coerced("no", True) is False
    with pytest.raises(ValueError):
        config.settings('{"ocr": {"min_text_chars": "many"}}', {})


def test_scope_prefixes():
    assert reconcile.scope_prefix(None) == "" and reconcile.scope_prefix("a/../b") == "b/"
    for bad in ("/a", "../a", "a/../../b", "c:/x"):
        with pytest.raises(ValueError):
            reconcile.scope_prefix(bad)
    with pytest.raises(FileNotFoundError):
        reconcile.scope_prefix("x", {"y"})


def test_search_trees_with_prefixes_and_fields():
    assert search.parse("ab*") == ("term", None, ("ab",), True)
    assert search.parse("{title tags} : x y")[1] == ("term", ("title", "tags"), ("x",))
    assert search.parse("-title : x") == ("term", ("summary", "notes", "tags", "parties"), ("x",))


def test_stored_index_follows_changes(spark, tmp_path):
    shape = "id long, title string, summary string, notes string, tags string, parties string"
    docs = spark.createDataFrame([(1, "red car", "", "", "", ""), (2, "blue car", "", "", "", ""), (3, "boat", "", "", "", "")], shape)
    index = search.Index(spark, f"file://{tmp_path}/index")
    index.rebuild(docs)
    found = lambda d, q: sorted(r["doc_id"] for r in search.search(d, q, index=index.postings()).collect())
    assert found(docs, "car") == [1, 2]
    after = spark.createDataFrame([(2, "blue boat", "", "", "", ""), (4, "carpet", "", "", "", "")], shape)
    index.update(after, spark.createDataFrame([(3,)], "doc_id long"))
    now = docs.filter("id = 1").union(after)
    assert found(now, "car") == [1] and found(now, "car*") == [1, 4] and found(now, "boat") == [2]


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, tmp_path):
    store = bootstrap(spark, f"file://{tmp_path}/db")
    rows = spark.createDataFrame([("a", "collection", "user")], "path string, mode string, source string")
    store.append("dirs", rows)
    (tmp_path / "db/dirs/half-written").mkdir()
    assert store.read("dirs").count() == 1 and store.version("dirs") is not None
    numbers = [n for n, _ in store.history("dirs")]
    assert numbers == sorted(set(numbers)) and len(numbers) == 2


def test_pass_two_takes_freshly_read_files_only(spark):
    shape = "id long, path string, size long, modified string, hash string"
    docs = spark.createDataFrame([(1, "gone", 5, "t", "h"), (2, "kept", 9, "t", "h"), (3, "away", 4, "t", "k")], shape)
    files = spark.createDataFrame([("kept", 9, "t", "h"), ("new", 7, "t", "k")], "rel string, size long, mtime string, hash string")
    one, two, orphans = reconcile.renames(files, docs)
    assert one.count() == 0
    assert [tuple(r) for r in two.collect()] == [(3, "away", "new", "rename")]
    assert [r["id"] for r in orphans.collect()] == [1]  # its like at `kept` is as its row says, so it was not read


def test_trusted_rows_are_not_changed(spark):
    shape = "id long, path string, size long, modified string, hash string, category string, summary string, title string, tags string"
    docs = spark.createDataFrame([(1, "a", 5, "t", "old", "C", "s", "t", ";x;"), (2, "b", 5, "t", None, "C", "s", "t", ";x;")], shape)
    files = spark.createDataFrame([("a", 5, "t", "new"), ("b", 6, "t", "h")], "rel string, size long, mtime string, hash string")
    none = spark.createDataFrame([], "doc_id long, decision string, done string, engine string, engine_ver string, langs string")
    rows = lambda **k: sorted((r["rel"], r["reason"]) for r in reconcile.worklist(files, docs, none, none, **k).collect())
    assert rows() == [("b", "content_changed")]
    assert rows(rehash=True) == [("a", "content_changed"), ("b", "content_changed")]
    assert rows(force=True) == [("a", "force"), ("b", "force")]


def test_names_and_parties(spark):
    say = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    nul = F.lit(None).cast("string")
    assert say(T.smart_name(nul, nul, F.lit("  "), F.lit("s"), F.lit(".pdf"))) == "untitled.pdf"
    assert say(T.smart_name(F.lit("2024"), nul, nul, nul, F.lit(".a"))) == "2024 - untitled.a"
    assert say(T.slug(F.lit("x" * 119 + " yy"))) == "x" * 119 + " "
    assert say(T.parties(F.lit("A and B/C & D"))) == ["A", "B", "C", "D"] and say(T.parties(F.lit("Sandy&Co"))) == ["Sandy&Co"]
    assert T.like_below("a_b%") == "a\\_b\\%/%"


def test_debounce_has_one_window_for_all_kinds(spark):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1, 0, 59, 58)
    rows = [(k, "error" if k % 2 else "processed", at + timedelta(seconds=s)) for k, s in enumerate([0, 3, 4, 6, 30, 3700])]
    got = journal.debounced(spark.createDataFrame(rows, "id long, kind string, ts timestamp_ntz")).collect()
    assert sorted((r["n"], r["last_id"]) for r in got) == [(1, 3), (1, 4), (1, 5), (3, 2)]


def test_migrations_keep_what_is_there(spark):
    docs = spark.createDataFrame([(1, "a", "keep")], "id long, path string, dup string")
    dirs = spark.createDataFrame([("d", "opaque", "user", "f")], "path string, mode string, source string, fingerprint string")
    db = documents.migrate({"docs": docs, "dirs": dirs}, 3)
    assert db["docs"].first()["dup"] == "keep" and db["dirs"].first()["fingerprint"] is None and db["dirs"].first()["mode"] == "opaque"
    assert set(db) == {"docs", "dirs", "asr", "proposals"}
    with pytest.raises(ValueError):
        documents.migrate(db, 2)


def test_watch_stream_routes_and_survives(spark, tmp_path):
    shape = "rel string, size long, mtime string, hash string"
    rows = [("Inbox/a", 1, "t", "h1"), ("Inbox/b", 1, "t", "h2"), ("Legal/x", 1, "t", "h3")]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    docs = spark.createDataFrame([(1, "Inbox/b", "h2")], "id long, path string, hash string")
    dirs = spark.createDataFrame([("Legal", "opaque")], "path string, mode string")
    seen, errors = [], []
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    streams.watch(stream, lambda: docs, lambda: dirs, lambda df: seen.extend(map(tuple, df.collect())), errors.append, f"{tmp_path}/c").awaitTermination()
    assert seen == [("Inbox/a", "digest")] and not errors
    left = streams.dropped(docs.union(spark.createDataFrame([(2, "Legal/x", "h3")], docs.schema)), spark.createDataFrame([("Legal/x",), ("Inbox/b",)], "path string"), dirs)
    assert [r["id"] for r in left.collect()] == [2]


def test_tolerant_rows(spark):
    old = spark.createDataFrame([(1, "a", "extra")], "id long, path string, odd string")
    assert lifecycle.tolerant(old, "id long, path string, dup string").first().asDict() == {"id": 1, "path": "a", "dup": None}
