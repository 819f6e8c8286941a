"""Rename plans applied to the tables, and moves done one after another."""

import random

from docloom.operators import reconcile

DOCS = "id long, path string, hash string, size long, modified string, digested string, category string, parties string, langs string, tags string, date string, title string, confidence string, dup string, summary string, notes string, extra string"


def doc(k, path, hash, size=5, modified="t", **more):
    row = dict.fromkeys(("digested", "category", "parties", "langs", "tags", "date", "title", "confidence", "summary", "notes", "extra")) | {"dup": "unique"} | more
    return (k, path, hash, size, modified, *(row[c] for c in ("digested", "category", "parties", "langs", "tags", "date", "title", "confidence", "dup", "summary", "notes", "extra")))


def test_each_kind_of_plan(spark):
    docs = spark.createDataFrame(
        [
            doc(1, "gone", "h1"), doc(2, "old", "h2", dup="dup", title="T", tags=";a;"), doc(3, "twin", "h2", dup="dup", tags=";b;", summary="S"), doc(4, "left", "h4"), doc(5, "busy", "h5"),
            doc(6, "lost", "h6"), doc(7, "same", "h7", modified="earlier"), doc(8, "quiet", "h8"),
        ],
        DOCS,
    )
    files = spark.createDataFrame([("new", 5, "now", "h1"), ("twin", 5, "t", "h2"), ("busy", 5, "now", "h4"), ("same", 6, "now", "h7"), ("quiet", 5, "t", "h8")], "rel string, size long, mtime string, hash string")
    ocr = spark.createDataFrame([(2, "ocr_full"), (8, "no_ocr")], "doc_id long, decision string")
    after, children, orphans = reconcile.applied(files, docs, {"ocr": ocr})
    got = {r["id"]: r for r in after.collect()}
    assert {k: r["path"] for k, r in got.items()} == {1: "new", 3: "twin", 4: "left", 5: "busy", 6: "lost", 7: "same", 8: "quiet"} or {k: r["path"] for k, r in got.items()} == {1: "new", 2: "twin", 4: "left", 5: "busy", 6: "lost", 7: "same", 8: "quiet"}
    stays = got.get(2) or got[3]
    assert (stays["title"], stays["summary"], stays["tags"], stays["dup"]) == ("T", "S", ";a;b;", "unique")  # its twin is gone
    assert got[1]["modified"] == "now" and (got[7]["size"], got[7]["modified"]) == (6, "now") and got[5]["modified"] == "t"
    assert sorted((r["id"], r["reason"]) for r in orphans.collect()) == [(4, "path_conflict_different_hash"), (6, "unresolved")]
    assert sorted(map(tuple, children["ocr"].collect())) == sorted([(stays["id"], "ocr_full"), (8, "no_ocr")])


def in_turn(moves):
    """Path of whatever stood on a path, by doing the moves one by one; None for what was moved over."""
    at = {p: p for _, s, t in moves for p in (s, t)}
    first = {s for _, s, _ in moves}
    place = {}
    for p in at:
        place[p] = p
    stood = {p: p for p in at}  # path -> what stands there, by its first path
    for _, s, t in sorted(moves):
        what = stood.pop(s, None)
        if what is not None:
            stood[t] = what
    return {w: p for p, w in stood.items() if p != w and w in first}


def test_chains_and_swaps(spark):
    shape = "seq long, source string, target string"
    composed = lambda rows: {r["source"]: r["target"] for r in reconcile.composed(spark.createDataFrame(rows, shape)).collect()}
    assert composed([(1, "a", "b"), (2, "b", "c"), (3, "c", "d")]) == {"a": "d"}
    assert composed([(1, "a", "t"), (2, "b", "a"), (3, "t", "b")]) == {"a": "b", "b": "a"}  # a swap
    assert composed([(1, "a", "b"), (2, "b", "a")]) == {}
    assert composed([(1, "b", "c"), (2, "a", "b")]) == {"b": "c", "a": "b"}
    assert composed([(1, "a", "x"), (2, "b", "x"), (3, "x", "y")]) == {"a": None, "b": "y"}
    chain = [(k, f"p{k}", f"p{k + 1}") for k in range(37)]
    assert composed(chain) == {"p0": "p37"} == in_turn(chain)
    rng, rows, free = random.Random(5), [], [f"q{k}" for k in range(40)]
    held = [f"p{k}" for k in range(20)]
    for seq in range(60):  # moves onto free paths only
        s, t = rng.choice(held), rng.choice(free)
        held[held.index(s)], free[free.index(t)] = t, s
        rows.append((seq, s, t))
    got = composed(rows)
    assert got == {s: t for s, t in in_turn(rows).items() if s.startswith("p")}


def test_moves_and_what_stands_in_their_way(spark):
    docs = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h3"), (4, "d", "h3"), (5, "e", "h5"), (6, "f", "h6")], "id long, path string, hash string")
    moves = spark.createDataFrame([(1, "a", "t"), (2, "b", "a"), (3, "t", "b"), (4, "c", "d"), (5, "e", "f")], "seq long, source string, target string")
    after, conflicts = reconcile.moved_along(docs, moves)
    assert sorted((r["id"], r["path"]) for r in after.collect()) == [(1, "b"), (2, "a"), (3, "d"), (5, "e"), (6, "f")]
    assert [tuple(r) for r in conflicts.collect()] == [(5, "e", "f")]
