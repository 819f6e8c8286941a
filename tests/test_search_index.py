"""The stored index against a search that splits all documents, what an update writes, and what a search reads."""

import random

import pytest

from docloom.operators import search

SHAPE = "id long, title string, summary string, notes string, tags string, parties string"
QUERIES = ["w3 OR w7", '"w1 w2"', "w1 NOT w2", "w4*", "-notes : w1", "- w1", "w9 OR (w8 NOT w1)", "absent OR Ẁ1"]


def texts(rng, ids):
    words = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    return [(k, words(3), None, words(rng.choice([0, 5, 50, 200])), ";a;", "") for k in ids]


def agree(spark, index, rows, queries=QUERIES, limit=10):
    docs = spark.createDataFrame(rows, SHAPE).cache()
    for q in queries:
        want = [tuple(r) for r in search.search(docs, q, limit).collect()]
        assert [tuple(r) for r in index.search(q, limit).collect()] == want, q


def files(path):
    return {p for p in path.rglob("*.parquet")}


def counted(spark, paths):
    return sum(spark.read.parquet(f"file://{p}").count() for p in paths)


def test_search_and_updates(spark, tmp_path):
    rng = random.Random(1)
    rows = {r[0]: r for r in texts(rng, range(-20, 300))}
    index = search.Index(spark, f"file://{tmp_path}/ix")
    assert index.search("w1").collect() == []
    index.rebuild(spark.createDataFrame(list(rows.values()), SHAPE))
    agree(spark, index, list(rows.values()))
    for turn in range(2):
        new = {r[0]: r for r in texts(rng, [5, 6, 200 + turn, 1000 + turn])}
        gone = [10 + turn, 77777]
        before = files(tmp_path)
        index.update(spark.createDataFrame(list(new.values()), SHAPE), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        made = files(tmp_path) - before
        assert counted(spark, made) < 600 and len(made) < 12  # four documents' blocks and rows, not three hundred's
        rows = {k: r for k, r in (rows | new).items() if k not in gone}
        agree(spark, index, list(rows.values()), ["w2 OR w3", '"w1 w2"'])


def test_merges_keep_what_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search.Index, "FAN", 2)
    rng, rows = random.Random(2), {}
    index = search.Index(spark, f"file://{tmp_path}/ix")
    for turn in range(3):
        new = {r[0]: r for r in texts(rng, range(turn * 3, turn * 3 + 6))}
        index.update(spark.createDataFrame(list(new.values()), SHAPE), spark.createDataFrame([(turn * 2,)], "doc_id long"))
        rows = {k: r for k, r in {**rows, **new}.items()}
        rows.pop(turn * 2) if turn * 2 in rows and turn * 2 not in new else None
    state = index.log.latest()[1]
    assert len(state["segments"]) <= 2 and index._facts(state)[0] == len(rows)
    agree(spark, index, list(rows.values()), ["w1 OR w2"])
    index.update(spark.createDataFrame([], SHAPE), spark.createDataFrame([(k,) for k in rows], "doc_id long"))
    assert index.search("w1").collect() == [] and index._facts(index.log.latest()[1])[0] == 0


def test_most_ranges_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search.Index, "RANGE", 4)
    monkeypatch.setattr(search.Index, "FIRST", 8)
    rng = random.Random(3)
    rows = [(k, "", "", " ".join(["rare"] * (k % 97 == 0) * rng.randrange(1, 9) + ["common"] * max(0, rng.randrange(-5, 4)) + ["x"] * rng.randrange(5, 60)), "", "") for k in range(4000)]
    index = search.Index(spark, f"file://{tmp_path}/ix")
    index.rebuild(spark.createDataFrame(rows, SHAPE))
    for q, most in (("common", 200), ("rare OR common", 200)):
        agree(spark, index, rows, [q], limit=5)
        assert sum(index.looked) <= most, (q, index.looked)  # of 1,000 ranges


def test_interleaved_updates_lose_nothing(spark, tmp_path):
    rows = texts(random.Random(4), range(6))
    index, other = (search.Index(spark, f"file://{tmp_path}/ix") for _ in range(2))
    index.rebuild(spark.createDataFrame(rows[:2], SHAPE))
    add, tries = index.log.add, []

    def late(number, state):
        if not tries:
            tries.append(1)
            other.update(spark.createDataFrame(rows[2:4], SHAPE))
        add(number, state)

    index.log.add = late
    index.update(spark.createDataFrame(rows[4:], SHAPE))
    agree(spark, index, rows, ["w1", "w2 OR w1"])


@pytest.mark.parametrize("text, term", [("ÀÉÎÕÜ", "aeiou"), ("ŁĀĂĄĐŐŰ", "łaaađou"), ("ǍǢǨȀȘȞ", "aækash"), ("ḀẞẠỆỮỹ", "aßaeuy"), ("ΆΈΉΊΌΎΏΐΰ ὅς", "αεηιουωιυ"), ("éą", "ea"), ("ЙЁ", "ие"), ("İ", "i")])
def test_marks_are_taken_off(spark, text, term):
    from pyspark.sql import functions as F

    got = spark.range(1).select(search.tokens(F.lit(text))).first()[0]
    assert got[0] == term == search.fold(text).split()[0]


def shuffled(spark):
    """Rows that all stages have written to shuffles so far."""
    gateway, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_words_are_not_shuffled(spark, tmp_path):
    rows = [(k, "", None, " ".join(f"w{(k * 7 + j) % 900}" for j in range(400)), "", "") for k in range(200)]
    index = search.Index(spark, f"file://{tmp_path}/ix")
    docs, before = spark.createDataFrame(rows, SHAPE), shuffled(spark)
    index.rebuild(docs)
    index.update(docs.filter("id < 20"), docs.filter("id = 30").selectExpr("id doc_id"))
    assert 0 < shuffled(spark) - before < 2000  # some rows a document, not one a word (80,000) or one a document and word
    agree(spark, index, [r for r in rows if r[0] != 30], ["w3 OR w7"])


def sorted_mb(spark, since):
    """The most memory that the tasks of a later stage took to sort and sum, in MB a task, and the number of all stages."""
    gateway, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    new = [s for s in map(stages.apply, range(stages.size())) if s.stageId() >= since]
    return max((s.peakExecutionMemory() / s.numTasks() / 1e6 for s in new), default=0), 1 + max((s.stageId() for s in new), default=since - 1)


def test_blocks_are_not_sorted_as_rows(spark, tmp_path, monkeypatch):
    """What a task sorts is texts, and a bounded number of words, however few partitions the session has."""
    monkeypatch.setattr(search.Index, "WORDS", 100_000, raising=False)
    rows = spark.range(2000).selectExpr("id", "'' title", "'' summary", "array_join(transform(sequence(0, 199), j -> concat('w', pmod(id * 7 + j * 13, 5000))), ' ') notes", "'' tags", "'' parties")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        _, since = sorted_mb(spark, 0)
        index = search.Index(spark, f"file://{tmp_path}/ix")
        index.rebuild(rows)
        took, _ = sorted_mb(spark, since)
        index.update(rows.filter("id < 9"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [p for p in tmp_path.rglob("blocks/*.parquet")]
    assert took < 50 and len(files) >= 4  # 34 for 400,000 words; 69 as rows of blocks
    docs = index.postings().groupBy("doc_id").count()
    assert docs.count() == 2000 and {r["count"] for r in docs.collect()} == {200}


def test_bounds_hold_and_ids_come_back(spark, tmp_path):
    last = (1 << 63) - 1
    ids = [-last - 1, -129, -128, -1, 0, 127, 128, 1 << 54, (1 << 54) + 77, last - 1, last]
    rows = [(k, "b", None, " ".join(["a"] * (j + 1) + ["c"] * 9 * j), ";ß;", "") for j, k in enumerate(ids)]
    index = search.Index(spark, f"file://{tmp_path}/ix")
    index.rebuild(spark.createDataFrame(rows, SHAPE))
    agree(spark, index, rows, ["a", "a OR c", "b"])
    mean = index._facts(index.log.latest()[1])[1]
    for r in index._each(index.log.latest()[1], "blocks").collect():
        scores = [len(d["at"]) * (search.K1 + 1) / (len(d["at"]) + search.K1 * (1 - search.B + search.B * d["len"] / mean)) for d in r["docs"]]
        assert r["n"] == len(scores) and max(scores) <= r["bound"] * r["factor"] <= max(scores) + 1e-3
    assert {(r["doc_id"], r["term"]) for r in index.postings().select("doc_id", "term").distinct().collect()} >= {(k, "a") for k in ids}


def test_texts_without_words_and_repeated_ids(spark, tmp_path):
    rows = [(-1, None, None, None, None, None), (3, "", "", " - ", "", ""), (300, "a b", "a", "", ";c;", "a")]
    index = search.Index(spark, f"file://{tmp_path}/ix")
    index.rebuild(spark.createDataFrame(rows, SHAPE))
    agree(spark, index, rows, ["a", '"a b"', "tags:c", "notes:a"])
    assert {tuple(r) for r in index.postings().collect()} == {(300, "title", 0, "a"), (300, "title", 1, "b"), (300, "summary", 0, "a"), (300, "tags", 0, "c"), (300, "parties", 0, "a")}
    twice = search.Index(spark, f"file://{tmp_path}/two")
    twice.rebuild(spark.createDataFrame([(7, "b", "", "a", "", ""), (7, "a", "", "b a", "", "")], SHAPE))
    found = {r["term"]: r["docs"] for r in twice._each(twice.log.latest()[1], "blocks").collect()}
    assert {t: [(d["doc_id"], d["at"]) for d in docs] for t, docs in found.items()} == {"a": [(7, [0, 2 << 40, (2 << 40) + 1])], "b": [(7, [0, 2 << 40])]}
