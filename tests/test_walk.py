"""The directory walk: what is listed, what is found, and in which order."""

from docloom.sources import walk


def test_closed_directories_are_never_listed(spark, tmp_path):
    root, seen = tmp_path / "node_modules", tmp_path / "seen"  # the root is walked whatever its name
    seen.mkdir()
    for name in ("b.txt", "A.txt", ".hidden", "Zeta/z1", "alpha/x", "alpha/Beta/y", "alpha/.git/config", ".venv/lib/deep/f", "alpha/node_modules/p/q", "locked/in/f", "locked2/f", "alpha/beta2/Node_Modules/f", "empty/none/.keep"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    log = str(seen)

    def counting(where, rel):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(rel)
        return walk.listed(where, rel)

    dirs = spark.createDataFrame([("locked", "opaque"), ("alpha", "collection")], "path string, mode string")
    files = walk.walk(spark, str(root), dirs, counting)
    got = [r["rel"] for r in walk.in_order(files).collect()]
    assert got == ["A.txt", "b.txt", "alpha/x", "alpha/Beta/y", "locked2/f", "Zeta/z1"]
    listed = sorted(p.read_text() for p in seen.iterdir())
    assert listed == ["", "Zeta", "alpha", "alpha/Beta", "alpha/beta2", "empty", "empty/none", "locked2"]
    assert {r["rel"]: r["size"] for r in files.collect()}["alpha/x"] == 7


def test_nothing_there(spark, tmp_path):
    assert walk.walk(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "only").mkdir()
    assert walk.walk(spark, f"file://{tmp_path}").count() == 0
