"""Small cases of the operators that SQL alone does not cover."""

import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import dups, enrich, journal, queue, recognition, search, transcripts
from docloom.sources import extract, markdown, transcript_files
from docloom.store import bootstrap
from docloom.streaming import journal as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def model_trim(text, most):
    if len(text) <= most:
        return text
    cut = text[:most]
    at = max(cut.rfind(c) for c in " \n\t")
    return cut[:at].rstrip() if at >= 0 and at >= most - 50 else cut.rstrip()


def test_trim_agrees_with_a_model(spark):
    import random

    r = random.Random(1)
    texts = ["".join(r.choice("ab \n\t漢") for _ in range(r.randint(0, 140))) for _ in range(300)] + ["x" * 200, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.trim_to_word(F.col("t"), 80).alias("x")).collect()
    assert [r["x"] for r in got] == [model_trim(r["t"], 80) for r in got]


def test_semilists(spark):
    assert one(spark, T.semilist(F.array().cast("array<string>"))) == ""
    assert one(spark, T.semilist(F.array(F.lit("b"), F.lit("a"), F.lit("a")))) == ";a;b;"
    assert one(spark, T.semilist(F.array(F.lit("a;b"), F.lit("c")))) == ";ab;c;"
    assert one(spark, F.array_contains(T.from_semilist(F.lit(";business;tax-2025;")), "tax")) is False


def test_dup_states(spark):
    docs = spark.createDataFrame([(1, "a", "h", "unique"), (2, "b", "h", "unique"), (3, "c", "k", "keep"), (4, "d", "m", "keep"), (5, "e", "m", "unique")], "id long, path string, hash string, dup string")
    assert {r["id"]: r["dup"] for r in dups.recomputed(docs).collect()} == {1: "dup", 2: "dup", 3: "unique", 4: "keep", 5: "dup"}
    group = spark.createDataFrame([(1, "Filed/a", "h", "dup"), (2, "Filed/b", "h", "dup"), (3, "Inbox/c", "h", "dup")], docs.schema)
    assert {r["id"]: r["dup"] for r in dups.set_state(group, 1, "keep").collect()} == {1: "keep", 2: "keep", 3: "dup"}


def test_queue_collapses_a_collection(spark):
    docs = spark.createDataFrame([(1, "Inbox/Case/a.txt", "x", "unique", None), (2, "Inbox/Case/nested/b.txt", "y", "unique", None)], "id long, path string, hash string, dup string, digested string")
    triage = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "digested"), (2, "2024-01-02T00:00:00Z", "digested")], "doc_id long, enqueued_at string, reason string")
    dirs = spark.createDataFrame([("Inbox/Case", "collection", "heuristic")], "path string, mode string, source string")
    (row,) = queue.listed(docs, triage, dirs).collect()
    assert (row["scope_path"], row["member_count"], row["path"]) == ("Inbox/Case", 2, "Inbox/Case/a.txt")
    assert queue.done(docs, triage, dirs, "Inbox/Case").count() == 0


def test_page_decisions(spark):
    def decide(sizes):
        pages = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(sizes)], "doc_id long, page long, page_text string")
        return recognition.ocr_decision(pages).first()["decision"]

    assert decide([1000] * 3) == "no_ocr"
    assert decide([1000] * 2 + [0] + [1000] * 7) == "ocr_pages"
    assert decide([0] * 4 + [1000] * 2) == "ocr_full/majority_sparse"
    assert decide([1, 2]) == "ocr_full/no_text_layer"
    pages = spark.createDataFrame([(1, p) for p in (5, 0, 2, 3, 0)], "doc_id long, page long")
    assert sorted((r["first"], r["last"]) for r in recognition.page_ranges(pages).collect()) == [(1, 1), (3, 4), (6, 6)]


def test_answers(spark):
    raws = ['{"title":"T","summary":"s","correspondent":["X","Y"]}', '{"title":"N","summary":"said "hi" to me.","tags":["x"],"category":"P"}', "garbage", '{"title": "cut off", "summ']
    frame = spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string")
    got = {r["doc_id"]: r for r in recognition.parsed(frame).collect()}
    assert [got[k]["tier"] for k in range(4)] == ["strict", "repair", "placeholder", "pattern"]
    assert got[1]["answer"]["summary"] == 'said "hi" to me.'
    assert recognition.to_document(recognition.parsed(frame)).filter("doc_id = 0").first()["parties"] == ";X;Y;"
    docs = spark.createDataFrame([(1, "some words here", "en", None), (2, None, None, "s")], "doc_id long, text string, lang string, source string")

    def broken():
        def call(prompt):
            raise OSError("no model")

        return call

    assert enrich.enriched(docs).filter("doc_id = 1").first()["title"].startswith("{")
    assert {r["confidence"] for r in enrich.enriched(docs, broken).collect()} == {"low"}


def test_search_query_trees():
    assert search.parse("a b") == ("and", ("term", None, ("a",)), ("term", None, ("b",)))
    assert search.parse('tags:"tax-2025" AND x')[1] == ("term", "tags", ("tax", "2025"))
    with pytest.raises(ValueError):
        search.parse("nofield:x")


def office(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


CORE = '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Report</dc:title></p>'


def test_extraction_by_type_and_by_content(spark):
    docx = office({"word/document.xml": '<d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p></d>', "docProps/core.xml": CORE})
    xlsx = office({"xl/sharedStrings.xml": "<s><si><t>cell</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'})
    pptx = office({"ppt/slides/slide1.xml": '<d xmlns:a="a"><a:p><a:t>Slide</a:t></a:p></d>'})
    epub = office({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title><item id="a" href="a.html"/><itemref idref="a"/></package>', "o/a.html": "<p>Chapter</p>"})
    page = b'<html lang="en"><head><title>T</title><meta name="k" content="v"></head><body><script>no</script><p>yes</p></body></html>'
    rows = [("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.epub", epub), ("e.html", page), ("wrong.docx", page), ("bad.docx", b"PK\x03\x04zzz"), ("t.txt", "plain é".encode()), ("z.bin", b"\x00\x01")]
    got = {r["path"]: r for r in extract.extracted(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got["a.docx"]["sections"] == ["Hello"] and got["a.docx"]["metadata"]["title"] == "Report"
    assert got["b.xlsx"]["sections"] == ["cell\t7"]
    assert got["c.pptx"]["sections"] == ["Slide"]
    assert got["d.epub"]["sections"] == ["Chapter"] and got["d.epub"]["metadata"]["title"] == "Book"
    assert got["e.html"]["sections"] == ["yes"] and got["e.html"]["metadata"] == {"lang": "en", "title": "T", "k": "v"}
    assert got["wrong.docx"]["sections"] == ["yes"]
    assert got["bad.docx"]["error"].startswith("extract_failed")
    assert got["t.txt"]["sections"] == ["plain é"]
    assert got["z.bin"]["error"] is not None


def test_markdown_round_trip(spark):
    row = (1, 'A "title": x', "Legal", "2024-01-02", "high", "keep", ";a;b;", "", ";en;", "Short.\nTwo lines", "mine")
    docs = spark.createDataFrame([row], "id long, title string, category string, date string, confidence string, dup string, tags string, parties string, langs string, summary string, notes string")
    back = markdown.parse(markdown.render(docs)).first()
    assert all(back[c] == docs.first()[c] for c in docs.columns)


def test_transcript_files(spark):
    rows = [(1, 0, 0.0, 1.5, "A", "one"), (1, 1, 1.5, 2.0, "B", ""), (1, 2, 2.0, 3.0004, "B", "two")]
    segments = spark.createDataFrame(rows, "doc_id long, turn long, seg_start double, seg_end double, speaker string, text string")
    assert transcript_files.from_twins(transcript_files.twins(segments)).count() == 3
    assert transcript_files.from_twins(spark.createDataFrame([(1, "{bad")], "doc_id long, json string")).count() == 0
    srt = transcript_files.subtitles(segments).first()["srt"]
    assert srt == "1\n00:00:00,000 --> 00:00:01,500\n[A] one\n\n2\n00:00:02,000 --> 00:00:03,000\n[B] two\n"
    assert one(spark, transcript_files.sidecar(F.lit("a.b/c.mp3"))) == "a.b/c.srt"
    assert transcripts.runs(segments).count() == 2


def test_store_keeps_the_old_snapshot_until_the_swap(spark, tmp_path):
    store = bootstrap(spark, f"file://{tmp_path}/db")
    rows = spark.createDataFrame([("a", "collection", "user")], "path string, mode string, source string")
    store.append("dirs", rows)
    before = store.read("dirs")
    store.upsert("dirs", rows.withColumn("mode", F.lit("opaque")), ["path"])
    assert before.first()["mode"] == "collection"
    assert [r["mode"] for r in store.read("dirs").collect()] == ["opaque"]
    assert bootstrap(spark, store.root).read("dirs").count() == 1


def test_journal_stream_resumes_where_it_stopped(spark, tmp_path):
    from docloom.store import EVENTS

    def put(first, n):
        rows = [(k, datetime(2024, 1, 1), "error", '{"file": "f"}') for k in range(first, first + n)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")

    seen = []

    def run(muted=False):
        q = streams.notify(streams.events(spark, f"{tmp_path}/events"), lambda df, _: seen.extend(r["id"] for r in df.collect()), f"{tmp_path}/cursor", lambda: muted)
        q.awaitTermination()

    put(1, 3)
    run()
    assert sorted(seen) == [1, 2, 3]
    put(4, 2)
    run(muted=True)
    put(6, 1)
    run()
    assert sorted(seen) == [1, 2, 3, 6]


def test_debounce_windows_are_not_prolonged(spark):
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, "error", at + timedelta(seconds=s)) for k, s in enumerate([0, 3, 4.9, 5, 11])], "id long, kind string, ts timestamp_ntz")
    assert sorted((r["n"], r["last_id"]) for r in journal.debounced(events).collect()) == [(1, 3), (1, 4), (3, 2)]


def test_snapshot_changes(spark):
    shape = "path string, length long, modificationTime timestamp"
    at = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", 1, at), ("b", 1, at), ("c", 1, at)], shape)
    new = spark.createDataFrame([("b", 2, at), ("c", 1, at), ("d", 1, at)], shape)
    assert {r["path"]: r["change"] for r in streams.changes(old, new).collect()} == {"a": "deleted", "b": "modified", "d": "created"}
