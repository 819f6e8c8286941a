"""The document table: joined view, lookups, validation, upserts, moves, copies, removals, filing and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

LEVELS = ("low", "medium", "high", "confirmed")
STATES = ("unique", "dup", "keep")
MODES = ("collection", "bundle", "opaque", "unknown")


def full(docs: DataFrame, ocr: DataFrame, asr: DataFrame) -> DataFrame:
    """docs with the prefixed columns of its recognition rows."""
    named = lambda df, p: df.select(F.col("doc_id").alias(f"{p}_doc_id"), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "doc_id"))
    o, a = named(ocr, "ocr"), named(asr, "asr")
    return docs.join(o, docs["id"] == o["ocr_doc_id"], "left").join(a, docs["id"] == a["asr_doc_id"], "left").drop("ocr_doc_id", "asr_doc_id")


def missing_metadata(docs: DataFrame) -> DataFrame:
    """Rows that lack something, with the names of what they lack."""
    lack = F.array_compact(F.array(
        F.when(F.col("category").isin("", "Unknown"), "category"), F.when(F.coalesce("summary", F.lit("")) == "", "summary"),
        F.when(F.coalesce("tags", F.lit("")) == "", "tags"), F.when(F.col("title").isNull(), "title"), F.when(F.col("date").isNull(), "date"),
    ))
    return docs.withColumn("missing", F.array_join(lack, ",")).filter(F.size(lack) > 0)


def checked(docs: DataFrame) -> DataFrame:
    """Values outside their lists coerced as on write."""
    return docs.withColumns({
        "confidence": F.when(F.col("confidence").isin(*LEVELS), F.col("confidence")).otherwise("low"),
        "dup": F.when(F.col("dup").isin(*STATES), F.col("dup")).otherwise("unique"),
        "category": F.when(F.coalesce("category", F.lit("")) == "", "Unknown").otherwise(F.col("category")),
        "original": F.when(F.coalesce("original", F.lit("")) == "", T.name_of(F.col("path"))).otherwise(F.col("original")),
    })


def violations(docs: DataFrame, ocr: DataFrame, triage: DataFrame, dirs: DataFrame) -> DataFrame:
    """check and n: rows against each constraint."""
    tally = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
    orphan = lambda df: df.join(docs, df["doc_id"] == docs["id"], "left_anti")
    parts = [
        tally(docs.groupBy("path").count().filter("count > 1"), "docs.path unique"),
        tally(docs.filter(~F.col("confidence").isin(*LEVELS)), "docs.confidence"),
        tally(docs.filter(~F.col("dup").isin(*STATES)), "docs.dup"),
        tally(dirs.filter(~F.col("mode").isin(*MODES)), "dirs.mode"),
        tally(orphan(ocr), "ocr.doc_id"),
        tally(orphan(triage), "triage.doc_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(rows: DataFrame, top: DataFrame, key: str = "path") -> DataFrame:
    """rows with ids after `top` (one row, `top`). They follow the first three digits of the key's SHA-256, then the key: each
    of these 4,096 ranges is numbered by itself and begins where the counts of those before it end, so no task sees all rows."""
    cells = rows.withColumn("__cell", F.substring(F.sha2(F.col(key), 256), 1, 3))
    sizes = cells.groupBy("__cell").agg(F.count("*").alias("__n"))
    begins = sizes.select("__cell", (F.sum("__n").over(Window.orderBy("__cell")) - F.col("__n")).alias("__begin"))  # at most 4,096 rows
    own = F.row_number().over(Window.partitionBy("__cell").orderBy(key))
    placed = cells.withColumn("__own", own).join(F.broadcast(begins), "__cell").crossJoin(F.broadcast(top))
    return placed.withColumn("id", F.col("top") + F.col("__begin") + F.col("__own")).select(*dict.fromkeys([*rows.columns, "id"]))


def upserted(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of the same path, whose id they keep; the others get ids after the largest (see numbered)."""
    old = docs.select(F.col("path").alias("__path"), F.col("id").alias("__old"))
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    matched = new.join(old, new["path"] == old["__path"], "left")
    again = matched.filter("__old is not null").withColumn("id", F.col("__old")).select(*docs.columns)
    fresh = numbered(matched.filter("__old is null").drop("__old", "__path"), top).select(*docs.columns)
    return docs.join(new, "path", "left_anti").select(*docs.columns).unionByName(again).unionByName(fresh)


def upserted_children(child: DataFrame, new: DataFrame, docs: DataFrame) -> DataFrame:
    """child (by doc_id) with the rows of new (by path) in place of those of the same documents; docs has their ids. Columns
    that new lacks are null; rows whose path no document has are left out."""
    rows = new.join(docs.select(F.col("id").alias("doc_id"), "path"), "path").drop("path")
    return child.join(rows, "doc_id", "left_anti").unionByName(rows.select(*(c for c in child.columns if c in rows.columns)), allowMissingColumns=True)


def without_prefix(docs: DataFrame, top: str) -> DataFrame:
    return docs.filter(~T.under(F.col("path"), top))


def cascade(child: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose document is still there."""
    return child.join(docs, child["doc_id"] == docs["id"], "left_semi")


def relocated(frame: DataFrame, source: str, target: str) -> DataFrame:
    """A file or a directory moved: paths at or below source go to target."""
    return frame.withColumn("path", T.moved(F.col("path"), source, target))


def copied(docs: DataFrame, source: str, target: str) -> DataFrame:
    """docs with the row of source again at target, under a new id, hash and state as they are."""
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    twin = docs.filter(F.col("path") == source).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1).withColumn("path", F.lit(target))
    return docs.unionByName(twin.select(*docs.columns))


def marked_digested(docs: DataFrame, paths: list[str], now: str) -> DataFrame:
    return docs.withColumn("digested", F.when(F.col("path").isin(*paths), now).otherwise(F.col("digested")))


def filing_target(category: Column, date: Column, sender: Column, title: Column, summary: Column, path: Column) -> Column:
    return F.concat_ws("/", F.when(F.coalesce(category, F.lit("")) == "", "Unknown").otherwise(category), T.smart_name(date, sender, title, summary, T.suffix_of(path)))


def filing_plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, target and status: noop (already there), same (same content is there), collision, or move."""
    sender = F.get(T.from_semilist(F.col("parties")), F.lit(0))
    aim = docs.select("id", "path", "hash", filing_target(F.col("category"), F.col("date"), sender, F.col("title"), F.col("summary"), F.col("path")).alias("target"))
    there = docs.select(F.col("path").alias("target"), F.col("hash").alias("their_hash"))
    first = F.row_number().over(Window.partitionBy("target").orderBy("id"))
    joined = aim.withColumn("turn", first).join(there, "target", "left")
    status = F.when(F.col("path") == F.col("target"), "noop").when(F.col("their_hash") == F.col("hash"), "same").when(F.col("their_hash").isNotNull() | (F.col("turn") > 1), "collision").otherwise("move")
    return joined.select(F.col("id").alias("doc_id"), F.col("path").alias("source"), "target", status.alias("status"))


def purged_orphans(docs: DataFrame, files: DataFrame, dirs: DataFrame, inbox: str = "Inbox") -> DataFrame:
    """docs without inbox rows whose file is gone or lies in an opaque directory."""
    mine = docs.filter(F.col("path").startswith(inbox + "/"))
    opaque = dirs.filter("mode = 'opaque'").select(F.col("path").alias("dir"))
    above = mine.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("dir"))
    hidden = above.join(opaque, "dir", "left_semi").select("id")
    gone = mine.join(files, mine["path"] == files["rel"], "left_anti").select("id")
    return docs.join(gone.union(hidden).distinct(), "id", "left_anti")


# --- migrations: each takes and returns the tables by name ------------------------------------------------------------


def _add(table: str, **columns: tuple[str, object]):
    """Columns that the table lacks, with their defaults."""

    def step(db: dict[str, DataFrame]) -> dict[str, DataFrame]:
        frame = db[table]
        for name, (kind, value) in columns.items():
            if name not in frame.columns:
                frame = frame.withColumn(name, F.lit(value).cast(kind))
        return {**db, table: frame}

    return step


def _rename(old: str, new: str):
    """The table under its new name, unless there is one of that name."""

    def step(db: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {**{k: v for k, v in db.items() if k != old}, new: db[old]} if old in db and new not in db else db

    return step


def _create(table: str, shape: str):
    """An empty table, unless there is one."""

    def step(db: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return db if table in db else {**db, table: next(iter(db.values())).sparkSession.createDataFrame([], shape)}

    return step


def _clear(table: str, column: str):
    def step(db: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if column not in db[table].columns:
            return db
        return {**db, table: db[table].withColumn(column, F.lit(None).cast(db[table].schema[column].dataType))}

    return step


def _shape(table: str, shape: str):
    """The table rebuilt with these columns in this order; those that it lacks are null."""

    def step(db: dict[str, DataFrame]) -> dict[str, DataFrame]:
        empty = db[table].sparkSession.createDataFrame([], shape)
        return {**db, table: empty.unionByName(db[table].select(*(c for c in db[table].columns if c in empty.columns)), allowMissingColumns=True)}

    return step


_TRIAGE = "doc_id long, enqueued_at string, reason string"
_DIRS = "path string, mode string, source string, fingerprint string, listing_id string, summary string, decided_at string, confidence double"
_ASR = "doc_id long, decision string, done string, engine string, engine_ver string, model string, langs string, detected_lang string, duration_ms long, audio_seconds double"
_PROPOSALS = "id long, subject string, kind string, value string, source string, rationale string, created_at string, status string"
#: Steps from each schema version to the next known one; a table that is there stays.
MIGRATIONS = {
    1: (3, [_add("docs", dup=("string", "unique")), _rename("triage_queue", "triage"), _create("triage", _TRIAGE)]),
    3: (4, [_create("dirs", _DIRS)]),
    4: (5, [_clear("dirs", "fingerprint")]),
    5: (6, [_create("asr", _ASR)]),
    6: (7, [_add("asr", diarized=("long", 0), channels=("long", None), speakers=("string", ""), srt_path=("string", None), json_path=("string", None), lang_prob=("double", None), recording_type=("string", "unknown"))]),
    7: (8, [_create("proposals", _PROPOSALS), _shape("dirs", _DIRS)]),
}
CURRENT = 8


def migrate(db: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version brought to the current one; an unknown version is an error."""
    while version != CURRENT:
        if version not in MIGRATIONS:
            raise ValueError(f"unknown schema version {version}")
        version, steps = MIGRATIONS[version]
        for step in steps:
            db = step(db)
    return db
