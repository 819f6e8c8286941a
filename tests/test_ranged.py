"""A table by path: which files a change below a directory writes anew, and what is in them."""

from docloom.functions import text as T
from docloom.operators import documents
from docloom.ranged import Ranged


def table(spark, tmp_path, files=10):
    rows = [(k, f"{'ABCDEFGHIJ'[k % 10]}/dir{k % 3}/f{k:03d}", k * 2) for k in range(300)] + [(900, None, 0), (901, "c/dir1/lower", 0), (902, "C", 1), (903, "Cx/other", 1)]
    frame = spark.createDataFrame(rows, "id long, path string, size long")
    own = Ranged(spark, f"file://{tmp_path}/t")
    own.create(frame, files)
    return own, frame


def ordered(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_a_move_rewrites_the_files_it_meets(spark, tmp_path):
    own, frame = table(spark, tmp_path)
    before = {f["file"] for f in own.files()}
    met, rows = own.move("C/dir1", "Z/dir9")
    after = {f["file"] for f in own.files()}
    assert ordered(own.read()) == ordered(documents.relocated(frame, "C/dir1", "Z/dir9"))
    assert met <= 3 and len(before & after) == len(before) - met and rows < 110
    assert ordered(own.read("Z")) == ordered(documents.relocated(frame, "C/dir1", "Z/dir9").filter(T.under(T.F.col("path"), "Z")))
    assert own.move("nowhere", "Z") == (0, 0) and {f["file"] for f in own.files()} == after


def test_drop_and_prefixes_in_either_case(spark, tmp_path):
    own, frame = table(spark, tmp_path)
    assert ordered(own.read("c")) == ordered(frame.filter(T.under(T.F.col("path"), "c")))
    own.drop("C")
    assert ordered(own.read()) == ordered(documents.without_prefix(frame.filter("path is not null"), "C").unionByName(frame.filter("path is null")))


def test_two_writers(spark, tmp_path):
    own, frame = table(spark, tmp_path, 4)
    other, add, tries = Ranged(spark, own.folder), own.log.add, []

    def late(number, state):
        if not tries:
            tries.append(other.move("A", "Q"))
        add(number, state)

    own.log.add = late
    own.move("J", "R")
    assert ordered(own.read()) == ordered(documents.relocated(documents.relocated(frame, "A", "Q"), "J", "R"))


def test_no_rows(spark, tmp_path):
    own = Ranged(spark, f"file://{tmp_path}/t")
    own.create(spark.createDataFrame([], "id long, path string"))
    assert own.read().count() == 0 and own.move("a", "b") == (0, 0)
