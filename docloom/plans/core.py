"""Queries over documents, the queue, duplicates, files and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import directories, documents, dups, lifecycle, queue, reconcile
from docloom.plans.registry import query
from docloom.ranged import Ranged
from docloom.session import scratch

L = "BIGINT"
_STATE = "st AS (SELECT id, path, hash, digested, CASE WHEN count(*) OVER (PARTITION BY hash) = 1 THEN 'unique' WHEN dup = 'unique' THEN 'dup' ELSE dup END AS dup FROM fx_docs)"


def _queue_sql(scope: str) -> str:
    return f"""WITH {_STATE},
s AS (SELECT * FROM st WHERE {scope}),
e AS (SELECT s.id AS doc_id, s.path, t.enqueued_at, t.reason FROM s JOIN fx_triage t ON t.doc_id = s.id
      UNION ALL SELECT id, path, digested, 'duplicate' FROM s WHERE dup = 'dup' AND NOT EXISTS (SELECT 1 FROM fx_triage t WHERE t.doc_id = s.id)),
up AS (SELECT e.doc_id, d.path AS dir, d.source, e.path FROM e JOIN fx_dirs d ON d.mode = 'collection' AND starts_with(e.path, d.path || '/')),
sc AS (SELECT doc_id, coalesce(min(CASE WHEN starts_with(path, 'Inbox/') AND regexp_matches(dir, '^Inbox/[^/]+$') THEN dir END), min(CASE WHEN source = 'user' THEN dir END)) AS scope FROM up GROUP BY doc_id),
k AS (SELECT e.*, coalesce(sc.scope, e.path) AS scope_path, CASE WHEN sc.scope IS NOT NULL THEN 'collection' ELSE 'doc' END AS scope_kind FROM e LEFT JOIN sc ON sc.doc_id = e.doc_id AND sc.scope IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_path ORDER BY coalesce(enqueued_at, ''), doc_id) AS rn, count(*) OVER (PARTITION BY scope_kind, scope_path) AS mc FROM k)
"""


_INBOX = "path ILIKE 'Inbox/%'"
_VIEWS = ("fx_docs", "fx_triage", "fx_dirs")
_LISTED = "doc_id, path, enqueued_at, reason, scope_path, scope_kind, CAST(mc AS BIGINT) AS member_count FROM r WHERE rn = 1"


@query("SELECT d.*, o.decision AS ocr_decision, o.done AS ocr_done, o.engine AS ocr_engine, o.engine_ver AS ocr_engine_ver, o.langs AS ocr_langs, a.decision AS asr_decision, a.done AS asr_done, a.engine AS asr_engine, a.engine_ver AS asr_engine_ver, a.langs AS asr_langs, a.audio_seconds AS asr_audio_seconds, a.channels AS asr_channels, a.recording_type AS asr_recording_type FROM fx_docs d LEFT JOIN fx_ocr o ON o.doc_id = d.id LEFT JOIN fx_asr a ON a.doc_id = d.id", "fx_docs", "fx_ocr", "fx_asr")
def docs_full(i):
    return documents.full(i.fx_docs, i.fx_ocr, i.fx_asr)


@query("SELECT * FROM fx_docs WHERE path = 'Inbox/doc_000004.mp3'", "fx_docs")
def docs_by_path(i):
    return i.fx_docs.filter("path = 'Inbox/doc_000004.mp3'")


@query("SELECT id, path, hash FROM fx_docs WHERE hash IN (SELECT min(hash) FROM (SELECT hash FROM fx_docs GROUP BY hash HAVING count(*) > 1))", "fx_docs")
def docs_by_hash(i):
    docs = i.fx_docs
    first = docs.groupBy("hash").count().filter("count > 1").agg(F.min("hash").alias("h"))
    return docs.join(F.broadcast(first), F.col("hash") == F.col("h"), "left_semi").select("id", "path", "hash")


@query("SELECT id, path FROM fx_docs ORDER BY path", "fx_docs")
def docs_ordered(i):
    return i.fx_docs.select("id", "path").orderBy("path")


@query("SELECT p.rel AS path, EXISTS (SELECT 1 FROM fx_docs d WHERE d.path = p.rel) AS has_metadata FROM fx_fs p", "fx_docs", "fx_fs")
def docs_has_metadata(i):
    known = i.fx_docs.select(F.col("path").alias("rel"), F.lit(True).alias("k")).distinct()
    return i.fx_fs.join(known, "rel", "left").select(F.col("rel").alias("path"), F.coalesce("k", F.lit(False)).alias("has_metadata"))


@query("SELECT id, path, concat_ws(',', CASE WHEN category IN ('', 'Unknown') THEN 'category' END, CASE WHEN coalesce(summary, '') = '' THEN 'summary' END, CASE WHEN coalesce(tags, '') = '' THEN 'tags' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN date IS NULL THEN 'date' END) AS missing FROM fx_docs WHERE category IN ('', 'Unknown') OR coalesce(summary, '') = '' OR coalesce(tags, '') = '' OR title IS NULL OR date IS NULL", "fx_docs")
def docs_missing_meta(i):
    return documents.missing_metadata(i.fx_docs).select("id", "path", "missing")


@query("SELECT id, CASE WHEN category = '' THEN 'Unknown' ELSE category END AS category, CASE WHEN c IN ('low','medium','high','confirmed') THEN c ELSE 'low' END AS confidence, original FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 'bogus' ELSE confidence END AS c FROM fx_docs)", "fx_docs")
def docs_coerced(i):
    bad = i.fx_docs.withColumn("confidence", F.when(F.col("id") % 7 == 0, "bogus").otherwise(F.col("confidence"))).withColumn("original", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("original")))
    return documents.checked(bad).select("id", "category", "confidence", "original")


@query("""SELECT 'docs.path unique' AS "check", CAST(count(*) AS BIGINT) AS n FROM (SELECT path FROM fx_docs GROUP BY path HAVING count(*) > 1)
UNION ALL SELECT 'docs.confidence', count(*) FROM fx_docs WHERE confidence NOT IN ('low','medium','high','confirmed') UNION ALL SELECT 'docs.dup', count(*) FROM fx_docs WHERE dup NOT IN ('unique','dup','keep')
UNION ALL SELECT 'dirs.mode', count(*) FROM fx_dirs WHERE mode NOT IN ('collection','bundle','opaque','unknown') UNION ALL SELECT 'ocr.doc_id', count(*) FROM fx_ocr WHERE doc_id NOT IN (SELECT id FROM fx_docs)
UNION ALL SELECT 'triage.doc_id', count(*) FROM fx_triage WHERE doc_id NOT IN (SELECT id FROM fx_docs)""", "fx_docs", "fx_ocr", "fx_triage", "fx_dirs")
def docs_violations(i):
    return documents.violations(i.fx_docs, i.fx_ocr, i.fx_triage, i.fx_dirs)


@query(_queue_sql(_INBOX) + "SELECT " + _LISTED, *_VIEWS)
def triage_queue(i):
    return queue.listed(i.fx_docs, i.fx_triage, i.fx_dirs)


@query(_queue_sql("TRUE") + "SELECT " + _LISTED, *_VIEWS)
def triage_queue_all(i):
    return queue.listed(i.fx_docs, i.fx_triage, i.fx_dirs, None)


@query(_queue_sql(_INBOX) + "SELECT " + _LISTED + " ORDER BY coalesce(enqueued_at, ''), doc_id LIMIT 1", *_VIEWS)
def triage_next(i):
    return queue.first(queue.listed(i.fx_docs, i.fx_triage, i.fx_dirs))


@query(_queue_sql(_INBOX) + "SELECT CAST(count(*) AS BIGINT) AS n FROM r WHERE rn = 1", *_VIEWS)
def triage_count(i):
    return queue.listed(i.fx_docs, i.fx_triage, i.fx_dirs).agg(F.count("*").alias("n"))


@query(_queue_sql("TRUE") + "SELECT r.doc_id, r.scope_path AS scope, CAST(mc AS VARCHAR) AS members, d.title, r.reason, d.hash, d.notes FROM r JOIN fx_docs d ON d.id = r.doc_id WHERE rn = 1", *_VIEWS)
def triage_entries_json(i):
    return lifecycle.entries_json(queue.listed(i.fx_docs, i.fx_triage, i.fx_dirs, None), i.fx_docs).select("doc_id", *(F.get_json_object("json", f"$.{k}").alias(n) for n, k in (("scope", "scope_path"), ("members", "member_count"), ("title", "title"), ("reason", "reason"), ("hash", "doc.hash"), ("notes", "doc.notes"))))


@query("SELECT * FROM fx_triage UNION ALL SELECT id, '2024-04-01T00:00:00Z', 'rebuild' FROM fx_docs d WHERE path ILIKE 'Inbox/%' AND NOT EXISTS (SELECT 1 FROM fx_triage t WHERE t.doc_id = d.id)", "fx_docs", "fx_triage")
def triage_rebuild(i):
    return queue.rebuilt(i.fx_docs, i.fx_triage, "2024-04-01T00:00:00Z")


@query("SELECT * FROM fx_triage WHERE doc_id NOT IN (SELECT id FROM fx_docs WHERE path ILIKE 'Inbox/%')", "fx_docs", "fx_triage")
def triage_clear(i):
    return queue.cleared(i.fx_docs, i.fx_triage)


@query("SELECT * FROM fx_triage WHERE doc_id NOT IN (SELECT id FROM fx_docs WHERE path = 'Inbox/src1' OR path ILIKE 'Inbox/src1/%')", "fx_docs", "fx_triage", "fx_dirs")
def triage_done_collection(i):
    return queue.done(i.fx_docs, i.fx_triage, i.fx_dirs, "Inbox/src1")


@query("SELECT * FROM fx_triage WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, '2024-05-01T00:00:00Z', 'digested' FROM fx_triage WHERE doc_id % 6 = 0", "fx_triage")
def triage_enqueue(i):
    new = i.fx_triage.filter("doc_id % 6 = 0").select("doc_id", F.lit("2024-05-01T00:00:00Z").alias("enqueued_at"), F.lit("digested").alias("reason"))
    return queue.enqueued(i.fx_triage, new)


@query("SELECT hash FROM fx_docs GROUP BY hash HAVING count(*) >= 2 UNION SELECT hash FROM fx_docs WHERE dup <> 'unique'", "fx_docs")
def dup_hashes(i):
    return dups.hashes_to_recompute(i.fx_docs)


@query(f"WITH {_STATE} SELECT id, path, dup FROM st", "fx_docs")
def dup_recompute(i):
    return dups.recomputed(i.fx_docs).select("id", "path", "dup")


@query(f"WITH {_STATE} SELECT a.id AS doc_id, coalesce(string_agg(CASE WHEN b.dup = 'dup' THEN b.path END, ';' ORDER BY b.path), '') AS dup_paths, coalesce(string_agg(CASE WHEN b.dup = 'keep' THEN b.path END, ';' ORDER BY b.path), '') AS keep_paths FROM st a JOIN st b ON a.hash = b.hash AND a.id <> b.id GROUP BY a.id", "fx_docs")
def dup_siblings(i):
    return dups.siblings(i.fx_docs)


@query("WITH t AS (SELECT hash FROM fx_docs WHERE id = 17), m AS (SELECT id, path, hash, CASE WHEN hash IN (SELECT hash FROM t) AND (id = 17 OR NOT starts_with(path, 'Inbox/')) THEN 'keep' ELSE dup END AS dup FROM fx_docs) SELECT id, CASE WHEN count(*) OVER (PARTITION BY hash) = 1 THEN 'unique' WHEN dup = 'unique' THEN 'dup' ELSE dup END AS dup FROM m", "fx_docs")
def dup_set_keep(i):
    return dups.set_state(i.fx_docs, 17, "keep").select("id", "dup")


# --- files against the table ------------------------------------------------------------------------------------------

_SUFFIX = r"lower(regexp_extract(rel, '[^/](\.[^./]*)$', 1))"


@query(f"SELECT f.rel, CASE WHEN {_SUFFIX} = '.png' THEN 'image' WHEN {_SUFFIX} = '.mp3' THEN 'audio' WHEN {_SUFFIX} = '.mkv' THEN 'video' WHEN {_SUFFIX} IN ('.pdf','.txt','.html') THEN 'text' ELSE 'unprocessable' END AS kind, d.path IS NOT NULL AS has_row, CAST(f.size AS BIGINT) AS size FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel", "fx_docs", "fx_fs")
def scan_inventory(i):
    return reconcile.inventory(i.fx_fs, i.fx_docs)


@query("SELECT coalesce(rel, path) AS rel, CASE WHEN path IS NULL THEN 'fs_only' WHEN rel IS NULL THEN 'db_only' ELSE 'both' END AS side FROM fx_fs FULL JOIN fx_docs ON rel = path", "fx_docs", "fx_fs")
def scan_set_join(i):
    return reconcile.set_join(i.fx_fs, i.fx_docs)


_MATCH = """WITH mi AS (SELECT id, path AS old_path, size, hash FROM fx_docs d WHERE NOT EXISTS (SELECT 1 FROM fx_fs f WHERE f.rel = d.path)),
kn AS (SELECT f.rel, f.size, CASE WHEN d.path IS NOT NULL AND f.size IS NOT DISTINCT FROM d.size AND f.mtime IS NOT DISTINCT FROM d.modified THEN d.hash ELSE f.hash END AS hash,
  NOT (d.path IS NOT NULL AND f.size IS NOT DISTINCT FROM d.size AND f.mtime IS NOT DISTINCT FROM d.modified) AS fresh FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel),
p1 AS (SELECT a.id, a.old_path, b.rel AS new_path FROM (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY old_path) AS rn FROM mi) a
  JOIN (SELECT rel, size, hash, row_number() OVER (PARTITION BY size, hash ORDER BY rel) AS rn FROM kn) b ON a.size = b.size AND a.hash = b.hash AND a.rn = b.rn),
p2 AS (SELECT a.id, a.old_path, b.rel AS new_path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY old_path) AS rn FROM mi WHERE id NOT IN (SELECT id FROM p1)) a
  JOIN (SELECT rel, hash, row_number() OVER (PARTITION BY hash ORDER BY rel) AS rn FROM kn WHERE fresh AND rel NOT IN (SELECT new_path FROM p1)) b ON a.hash = b.hash AND a.rn = b.rn)
"""
_KIND = "CASE WHEN new_path IN (SELECT path FROM fx_docs) THEN 'merge' ELSE 'rename' END AS kind"


@query(_MATCH + f"SELECT id, old_path, new_path, {_KIND} FROM p1", "fx_docs", "fx_fs")
def scan_renames_pass1(i):
    return reconcile.renames(i.fx_fs, i.fx_docs)[0]


@query(_MATCH + f"SELECT id, old_path, new_path, {_KIND} FROM p2", "fx_docs", "fx_fs")
def scan_renames_pass2(i):
    return reconcile.renames(i.fx_fs, i.fx_docs)[1]


@query(_MATCH + "SELECT id, old_path AS path FROM mi WHERE id NOT IN (SELECT id FROM p1) AND id NOT IN (SELECT id FROM p2)", "fx_docs", "fx_fs")
def scan_orphans(i):
    return reconcile.renames(i.fx_fs, i.fx_docs)[2]


_RICH = "CASE dup WHEN 'keep' THEN 2 WHEN 'dup' THEN 1 ELSE 0 END DESC, CASE confidence WHEN 'confirmed' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, len(list_filter(string_split(coalesce(tags, ''), ';'), lambda x: x <> '')) + (coalesce(title, '') <> '')::INT + (coalesce(summary, '') <> '')::INT DESC, coalesce(digested, '') DESC, path"
_MEET = _MATCH + f""", pl AS (SELECT id, new_path AS target FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) WHERE new_path IN (SELECT path FROM fx_docs)),
ro AS (SELECT id, target FROM pl UNION ALL SELECT d.id, d.path FROM fx_docs d WHERE d.path IN (SELECT target FROM pl)),
be AS (SELECT ro.target, d.*, row_number() OVER (PARTITION BY ro.target ORDER BY {_RICH}) AS place FROM ro JOIN fx_docs d ON d.id = ro.id)
"""


def _first_full(c: str) -> str:
    return f"(list({c} ORDER BY place) FILTER (coalesce({c}, '') <> ''))[1] AS {c}"


def _united(c: str) -> str:
    return f"(SELECT CASE WHEN count(*) = 0 THEN '' ELSE ';' || string_agg(v, ';' ORDER BY v) || ';' END FROM (SELECT DISTINCT unnest(string_split(x, ';')) AS v) WHERE v <> '')"


@query(_MEET + f"SELECT target, winner, n_rows, category, date, title, summary, notes, extra, {_united('t').replace('x,', 'tags,')} AS tags, {_united('p').replace('x,', 'parties,')} AS parties, {_united('l').replace('x,', 'langs,')} AS langs FROM (SELECT target, min(id) FILTER (place = 1) AS winner, CAST(count(*) AS BIGINT) AS n_rows, {', '.join(map(_first_full, ('category', 'date', 'title', 'summary', 'notes', 'extra')))}, string_agg(tags, ';') AS tags, string_agg(parties, ';') AS parties, string_agg(langs, ';') AS langs FROM be GROUP BY target)", "fx_docs", "fx_fs")
def scan_merged_values(i):
    return reconcile.merged(i.fx_fs, i.fx_docs)


_CLASH = "fs2 AS (SELECT f.rel, coalesce(o.size, f.size) AS size, f.mtime, coalesce(o.hash, f.hash) AS hash FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel AND d.id % 22 = 1 LEFT JOIN fx_docs o ON o.id = d.id - 1)"
_AFTER = _MATCH.replace("WITH mi", f"WITH {_CLASH}, mi").replace("fx_fs", "fs2").replace("FROM fs2 f LEFT JOIN fx_docs d ON d.path = f.rel AND", "FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel AND") + f""", pa AS (SELECT p.id, p.old_path, p.new_path, o.id AS own, o.hash IS NOT DISTINCT FROM d.hash AS same FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) p JOIN fx_docs d ON d.id = p.id LEFT JOIN fx_docs o ON o.path = p.new_path),
ro AS (SELECT unnest([id, own]) AS id, new_path AS target FROM pa WHERE own IS NOT NULL AND same),
be AS (SELECT ro.target, d.*, row_number() OVER (PARTITION BY ro.target ORDER BY {_RICH}) AS place FROM ro JOIN fx_docs d ON d.id = ro.id),
mv AS (SELECT target, winner, category, date, title, summary, notes, extra, {_united('t').replace('x,', 'tags,')} AS tags, {_united('p').replace('x,', 'parties,')} AS parties, {_united('l').replace('x,', 'langs,')} AS langs FROM (SELECT target, min(id) FILTER (place = 1) AS winner, {', '.join(map(_first_full, ('category', 'date', 'title', 'summary', 'notes', 'extra')))}, string_agg(tags, ';') AS tags, string_agg(parties, ';') AS parties, string_agg(langs, ';') AS langs FROM be GROUP BY target)),
ls AS (SELECT b.id, w.winner FROM be b JOIN mv w ON w.target = b.target WHERE b.place = 2),
rn AS (SELECT id, new_path FROM pa WHERE own IS NULL),
af AS (SELECT d.id, coalesce(rn.new_path, mv.target, d.path) AS path, d.hash, {', '.join(f"CASE WHEN rn.id IS NOT NULL OR mv.winner IS NOT NULL OR k.hash = d.hash THEN f.{b} ELSE d.{a} END AS {a}" for a, b in (('size', 'size'), ('modified', 'mtime')))}, {', '.join(f"CASE WHEN mv.winner IS NOT NULL THEN mv.{c} ELSE d.{c} END AS {c}" for c in ('category', 'title', 'tags', 'notes'))}, d.dup
  FROM fx_docs d LEFT JOIN rn ON rn.id = d.id LEFT JOIN mv ON mv.winner = d.id LEFT JOIN fs2 f ON f.rel = coalesce(rn.new_path, mv.target, d.path) LEFT JOIN kn k ON k.rel = coalesce(rn.new_path, mv.target, d.path) WHERE d.id NOT IN (SELECT id FROM ls))
"""


def _clashing(i):
    docs, files = i.fx_docs, i.fx_fs
    at = docs.filter("id % 22 = 1").select(F.col("path").alias("rel"), (F.col("id") - 1).alias("of"))
    other = at.join(docs.select(F.col("id").alias("of"), F.col("size").alias("o_size"), F.col("hash").alias("o_hash")), "of").drop("of")
    return files.join(other, "rel", "left").select("rel", F.coalesce("o_size", "size").alias("size"), "mtime", F.coalesce("o_hash", "hash").alias("hash"))


@query(_AFTER + "SELECT id, path, hash, size, modified, category, title, tags, notes, CASE WHEN hash NOT IN (SELECT d.hash FROM ls JOIN fx_docs d ON d.id = ls.id) THEN dup WHEN count(*) OVER (PARTITION BY hash) = 1 THEN 'unique' WHEN dup = 'unique' THEN 'dup' ELSE dup END AS dup FROM af", "fx_docs", "fx_fs")
def scan_applied(i):
    return reconcile.applied(_clashing(i), i.fx_docs)[0].select("id", "path", "hash", "size", "modified", "category", "title", "tags", "notes", "dup")


@query(_AFTER + "SELECT * FROM fx_ocr WHERE doc_id NOT IN (SELECT id FROM ls) UNION ALL SELECT ls.winner, o.decision, o.done, o.engine, o.engine_ver, o.langs FROM fx_ocr o JOIN ls ON ls.id = o.doc_id WHERE ls.winner NOT IN (SELECT doc_id FROM fx_ocr)", "fx_docs", "fx_fs", "fx_ocr")
def scan_applied_children(i):
    return reconcile.applied(_clashing(i), i.fx_docs, {"ocr": i.fx_ocr})[1]["ocr"]


@query(_AFTER + "SELECT id, old_path AS path, 'path_conflict_different_hash' AS reason FROM pa WHERE own IS NOT NULL AND NOT same UNION ALL SELECT id, old_path, 'unresolved' FROM mi WHERE id NOT IN (SELECT id FROM pa)", "fx_docs", "fx_fs")
def scan_applied_orphans(i):
    return reconcile.applied(_clashing(i), i.fx_docs)[2]


_DRIFT_O = "coalesce(done, '') <> '' AND (coalesce(engine_ver, '') <> '' OR coalesce(langs, '') <> '') AND (coalesce(engine_ver, '') <> 'tesseract 5.5.0' OR list_sort(list_distinct(list_filter(string_split(langs, ';'), lambda x: x <> ''))) <> ['eng','heb'])"
_DRIFT_A = "coalesce(done, '') <> '' AND coalesce(engine, '') <> 'subtitle' AND (coalesce(engine_ver, '') <> '' OR coalesce(langs, '') <> '') AND (coalesce(engine_ver, '') <> 'engine 1.1 model=b' OR list_sort(list_distinct(list_filter(string_split(langs, ';'), lambda x: x <> ''))) <> ['en','he'])"
_WORK = f"""WITH bo AS (SELECT f.rel, f.mtime, f.hash AS fh, NOT (f.size IS NOT DISTINCT FROM d.size AND f.mtime IS NOT DISTINCT FROM d.modified) AS fresh, d.* FROM fx_fs f JOIN fx_docs d ON d.path = f.rel),
sa AS (SELECT * FROM bo WHERE NOT (fresh AND fh IS DISTINCT FROM hash)),
w AS (SELECT rel, 'new_files' AS bucket, 'no_record' AS reason, 1 AS k, hash AS file_hash, '' AS details FROM fx_fs WHERE rel NOT IN (SELECT path FROM fx_docs)
UNION ALL SELECT rel, 'changed_files', 'content_changed', 2, fh, '' FROM bo WHERE fresh AND fh IS DISTINCT FROM hash
UNION ALL SELECT rel, 'partial_metadata', 'partial_metadata', 3, hash, 'missing_fields=' || concat_ws(',', CASE WHEN coalesce(category, '') IN ('', 'Unknown') THEN 'category' END, CASE WHEN coalesce(summary, '') = '' AND coalesce(title, '') = '' THEN 'summary' END, CASE WHEN coalesce(tags, '') = '' THEN 'tags' END) FROM sa WHERE coalesce(category, '') IN ('', 'Unknown') OR (coalesce(summary, '') = '' AND coalesce(title, '') = '') OR coalesce(tags, '') = ''
UNION ALL SELECT rel, 'stale_metadata', 'stale_metadata', 4, hash, 'delta_days=' || CAST(CAST(floor(epoch(mtime::TIMESTAMP - modified::TIMESTAMP) / 86400) AS BIGINT) AS VARCHAR) || ';file_modified=' || mtime || ';metadata_modified=' || modified FROM sa WHERE mtime::TIMESTAMP > modified::TIMESTAMP
UNION ALL SELECT rel, 'ocr_review', 'ocr_drift', 5, sa.hash, 'current_engine=tesseract 5.5.0;current_languages=heb+eng;previous_engine=' || coalesce(o.engine_ver, '') || ';previous_languages=' || coalesce(o.langs, '') FROM sa JOIN (SELECT * FROM fx_ocr WHERE {_DRIFT_O}) o ON o.doc_id = sa.id
UNION ALL SELECT rel, 'asr_review', 'asr_drift', 6, sa.hash, 'current_engine=engine 1.1 model=b;current_languages=he,en;previous_engine=' || coalesce(a.engine_ver, '') || ';previous_languages=' || coalesce(a.langs, '') FROM sa JOIN (SELECT * FROM fx_asr WHERE {_DRIFT_A}) a ON a.doc_id = sa.id)
"""
_WV = ("fx_docs", "fx_fs", "fx_ocr", "fx_asr")


def _work(i):
    return reconcile.worklist(i.fx_fs, i.fx_docs, i.fx_ocr, i.fx_asr)


def _told(details):
    return F.array_join(F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(_WORK + "SELECT rel, bucket, reason, file_hash, details FROM w", *_WV)
def scan_worklist(i):
    return _work(i).select("rel", "bucket", "reason", "file_hash", _told(F.col("details")).alias("details"))


@query("SELECT f.rel, CASE WHEN d.path IS NULL THEN 'no_record' ELSE 'force' END AS reason FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel", *_WV)
def scan_forced(i):
    return reconcile.worklist(i.fx_fs, i.fx_docs, i.fx_ocr, i.fx_asr, force=True).select("rel", "reason")


@query("SELECT f.rel, d.path IS NULL OR f.size IS DISTINCT FROM d.size OR f.mtime IS DISTINCT FROM d.modified AS fresh FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel", "fx_docs", "fx_fs")
def scan_selective_rehash(i):
    return reconcile.known_hashes(i.fx_fs, i.fx_docs).select("rel", "fresh")


@query("SELECT id, path FROM fx_docs WHERE path = 'Inbox/src1' OR starts_with(path, 'Inbox/src1/')", "fx_docs")
def scan_scope(i):
    return reconcile.in_scope(i.fx_docs, reconcile.scope_prefix("Inbox/./src1")).select("id", "path")


@query(_MEET + "SELECT target, id AS winner FROM be WHERE place = 1", "fx_docs", "fx_fs")
def scan_merge_winner(i):
    return reconcile.meeting(i.fx_fs, i.fx_docs).filter("place = 1").select("target", F.col("id").alias("winner"))


_VIEW_OF = "CASE bucket WHEN 'new_files' THEN 'files_needing_metadata' WHEN 'partial_metadata' THEN 'files_with_partial_metadata' WHEN 'stale_metadata' THEN 'files_with_stale_metadata' WHEN 'ocr_review' THEN 'ocr_review_candidates' WHEN 'asr_review' THEN 'asr_review_candidates' ELSE bucket END"


@query(_WORK + f"SELECT view, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_VIEW_OF} AS view FROM w WHERE NOT ends_with(rel, '.xyz') UNION ALL SELECT 'files_needing_ocr' FROM w WHERE k = 1 AND regexp_matches(lower(rel), '\\.(jpe?g|png|gif|bmp|tiff?|webp|hei[cf])$') UNION ALL SELECT 'files_needing_asr' FROM w WHERE k = 1 AND regexp_matches(lower(rel), '\\.(amr|mp3|m4a|wav|ogg|opus|flac|aac|mp4|mkv|mov|avi|webm|wmv|flv|m4v)$')) GROUP BY view", *_WV)
def scan_report(i):
    return lifecycle.report(reconcile.worklist(i.fx_fs, i.fx_docs, i.fx_ocr, i.fx_asr, noted=reconcile.facts(i.fx_fs, i.fx_docs)))


def _pdf(i):
    """What is known of the text layers of moved PDFs: that of their documents; pages that are toxic stand for locked files."""
    moved = i.fx_docs.select(F.col("id").alias("doc_id"), F.concat(F.lit("Archive/"), "original").alias("rel"))
    return moved.join(i.fx_ocr, "doc_id").select("rel", F.when(F.col("decision") == "ocr_pages", "skip_encrypted").otherwise(F.col("decision")).alias("action"), F.when(F.col("decision") == "ocr_full", F.col("engine")).alias("reason"))


_NOTED = f"""no AS (SELECT f.rel, {_SUFFIX} AS sx, d.path IS NOT NULL AS known, p.action, p.why FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel
LEFT JOIN (SELECT 'Archive/' || d.original AS rel, CASE o.decision WHEN 'ocr_pages' THEN 'skip_encrypted' ELSE o.decision END AS action, CASE o.decision WHEN 'ocr_full' THEN o.engine END AS why FROM fx_docs d JOIN fx_ocr o ON o.doc_id = d.id) p USING (rel)),
nt AS (SELECT rel, CASE WHEN sx NOT IN ('.pdf','.txt','.html','.png','.mp3','.mkv') THEN 'skipped' WHEN sx = '.pdf' AND action = 'skip_encrypted' THEN 'unprocessable' ELSE 'candidate' END AS state, sx,
  CASE WHEN NOT known AND sx = '.pdf' AND action IN ('ocr_full', 'ocr_pages') THEN coalesce(why, action) WHEN NOT known AND sx = '.png' THEN 'image_format' END AS ocr_reason,
  CASE WHEN NOT known AND sx = '.mp3' THEN 'audio_format' WHEN NOT known AND sx = '.mkv' THEN 'video_format' END AS asr_reason FROM no)"""


@query(f"WITH {_NOTED} SELECT rel, state, CASE WHEN state = 'unprocessable' THEN 'pdf_encrypted' END AS reason, CASE WHEN state = 'candidate' THEN substr(sx, 2) END AS format, CASE WHEN state = 'candidate' THEN ocr_reason END AS ocr_reason, CASE WHEN state = 'candidate' THEN asr_reason END AS asr_reason FROM nt", "fx_docs", "fx_fs", "fx_ocr")
def scan_facts(i):
    noted = reconcile.facts(i.fx_fs, i.fx_docs, _pdf(i))
    return noted.select("rel", "state", "reason", F.col("details")["format"].alias("format"), F.col("details")["ocr_reason"].alias("ocr_reason"), F.col("details")["asr_reason"].alias("asr_reason"))


@query(f"WITH {_NOTED} SELECT 'files_needing_ocr' AS view, rel, ocr_reason AS why FROM nt WHERE state = 'candidate' AND ocr_reason IS NOT NULL UNION ALL SELECT 'files_needing_asr', rel, asr_reason FROM nt WHERE state = 'candidate' AND asr_reason IS NOT NULL", "fx_docs", "fx_fs", "fx_ocr")
def scan_needs(i):
    work = reconcile.worklist(i.fx_fs, i.fx_docs, i.fx_ocr, i.fx_asr, noted=reconcile.facts(i.fx_fs, i.fx_docs, _pdf(i)))
    kept = lifecycle.report_json(work).filter("view in ('files_needing_ocr', 'files_needing_asr')")
    why = F.coalesce(F.get_json_object("json", "$.details.ocr_reason"), F.get_json_object("json", "$.details.asr_reason"))
    return kept.select("view", "rel", why.alias("why"))


@query(_WORK + "SELECT rel, bucket, reason FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY k) AS rn FROM w) WHERE rn = 1", *_WV)
def scan_candidates(i):
    return reconcile.first_bucket(_work(i)).select("rel", "bucket", "reason")


@query(_WORK + "SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY bucket", *_WV)
def scan_bucket_counts(i):
    return _work(i).groupBy("bucket").agg(F.count("*").alias("n"))


@query(_WORK + "SELECT rel, details FROM w WHERE k = 3", *_WV)
def scan_partial(i):
    return _work(i).filter("bucket = 'partial_metadata'").select("rel", _told(F.col("details")).alias("details"))


@query(_WORK + "SELECT rel, details FROM w WHERE k = 4", *_WV)
def scan_stale(i):
    return _work(i).filter("bucket = 'stale_metadata'").select("rel", _told(F.col("details")).alias("details"))


@query(f"SELECT * FROM fx_ocr WHERE {_DRIFT_O}", "fx_ocr")
def scan_ocr_drift(i):
    return reconcile.ocr_drift(i.fx_ocr)


@query(f"SELECT * FROM fx_asr WHERE {_DRIFT_A}", "fx_asr")
def scan_asr_drift(i):
    return reconcile.asr_drift(i.fx_asr)


@query("WITH lost AS (SELECT hash, min(path) AS was FROM fx_docs d WHERE NOT EXISTS (SELECT 1 FROM fx_fs f WHERE f.rel = d.path) GROUP BY hash), j AS (SELECT f.rel, d.hash AS rh, f.hash AS fh, l.was FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel LEFT JOIN lost l ON l.hash = f.hash), o AS (SELECT rel, was, CASE WHEN rh = fh THEN 'no_change' WHEN rh IS NOT NULL THEN 'content_changed' WHEN was IS NOT NULL THEN 'renamed' ELSE 'new_file' END AS outcome FROM j) SELECT rel, outcome, CASE WHEN outcome = 'renamed' THEN was END AS renamed_from FROM o", "fx_docs", "fx_fs")
def reconcile_single(i):
    return reconcile.outcomes(i.fx_fs, i.fx_docs)


@query("SELECT f.rel, CASE WHEN d.hash IS NOT NULL AND d.size IS NOT DISTINCT FROM f.size AND d.modified IS NOT DISTINCT FROM f.mtime THEN d.hash ELSE f.hash END AS hash, d.hash IS NOT NULL AND d.size IS NOT DISTINCT FROM f.size AND d.modified IS NOT DISTINCT FROM f.mtime AS trusted FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel", "fx_docs", "fx_fs")
def scan_trusted_hash(i):
    return reconcile.trusted_hash(i.fx_fs, i.fx_docs)


# --- directories ------------------------------------------------------------------------------------------------------

_ABOVE = "SELECT id, k AS depth, array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM (SELECT id, path, unnest(range(1, CAST(len(string_split(path, '/')) AS BIGINT))) AS k FROM fx_docs)"


@query(f"SELECT DISTINCT dir AS path, 'collection' AS mode FROM ({_ABOVE})", "fx_docs")
def dirs_observed(i):
    return directories.observed(i.fx_docs)


@query("SELECT * FROM fx_dirs WHERE path = 'Legal' OR path ILIKE 'Legal/%' ORDER BY path", "fx_dirs")
def dirs_under_prefix(i):
    return directories.prefixed(i.fx_dirs, "Legal")


@query(f"SELECT a.id, max_by(a.dir, a.depth) AS nearest, min_by(a.dir, a.depth) AS topmost FROM ({_ABOVE}) a JOIN fx_dirs d ON d.path = a.dir AND d.mode = 'opaque' GROUP BY a.id", "fx_docs", "fx_dirs")
def dirs_opaque_ancestor(i):
    return directories.opaque_ancestors(i.fx_docs, i.fx_dirs)


_FILES = rf"(SELECT regexp_replace(rel, '/[^/]*$', '') AS dir, coalesce(nullif({_SUFFIX}, ''), '<noext>') AS suffix, regexp_extract(rel, '[^/]*$') AS name, size FROM fx_fs)"
_TREE = "(SELECT DISTINCT array_to_string(parts[1:k], '/') AS rel FROM (SELECT string_split(rel, '/') AS parts, unnest(range(1, CAST(len(string_split(rel, '/')) AS BIGINT))) AS k FROM fx_fs))"
_SAMPLE = f"f AS {_FILES}, ki AS (SELECT dir, suffix, min(name) AS lead FROM f GROUP BY ALL), p AS (SELECT f.*, lead, row_number() OVER (PARTITION BY f.dir, f.suffix ORDER BY name) AS k, (SELECT count(*) FROM ki g WHERE g.dir = f.dir) AS kinds FROM f JOIN ki ON ki.dir = f.dir AND ki.suffix = f.suffix), c AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY lead, name) AS a FROM p WHERE k <= greatest(1, 10 // kinds)), sn AS (SELECT dir, suffix, name FROM c WHERE a <= 10)"


@query(f"WITH {_SAMPLE}, own AS (SELECT dir, count(*) AS n, round(sum(size) / 1048576, 2) AS mb, count(DISTINCT suffix) AS s FROM f GROUP BY dir), sd AS (SELECT CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '' END AS dir, count(*) AS n FROM {_TREE} GROUP BY 1), te AS (SELECT dir, bool_or(regexp_matches(name, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{8}}_\\d{{6}}|(?i:IMG_\\d+)|(?i:DSC[N]?_?\\d+)|\\[[^\\]]+\\]_\\d+_\\d{{4}}')) AS t FROM sn GROUP BY dir) SELECT coalesce(own.dir, sd.dir) AS dir, CAST(coalesce(own.n, 0) AS BIGINT) AS n_files, CAST(coalesce(sd.n, 0) AS BIGINT) AS n_dirs, coalesce(mb, 0.0) AS mb, CAST(coalesce(s, 0) AS BIGINT) AS n_suffixes, coalesce(t, FALSE) AS templated FROM own FULL JOIN sd ON own.dir = sd.dir LEFT JOIN te ON te.dir = coalesce(own.dir, sd.dir)", "fx_fs")
def dirs_summary(i):
    return directories.summary(i.fx_fs)


@query(f"SELECT dir, suffix, n, CAST(row_number() OVER (PARTITION BY dir ORDER BY n DESC, suffix) AS BIGINT) AS place FROM (SELECT dir, suffix, CAST(count(*) AS BIGINT) AS n FROM {_FILES} GROUP BY ALL)", "fx_fs")
def dirs_ext_histogram(i):
    return directories.histogram(i.fx_fs)


@query(f"WITH {_SAMPLE} SELECT * FROM sn", "fx_fs")
def dirs_sample_names(i):
    return directories.sample_names(i.fx_fs)


@query("WITH i AS (SELECT DISTINCT split_part(substr(rel, 7), '/', 1) AS name, contains(substr(rel, 7), '/') AS is_dir FROM fx_fs WHERE starts_with(rel, 'Inbox/')) SELECT i.name, i.is_dir, CASE WHEN is_dir THEN CASE d.mode WHEN 'collection' THEN 'col' WHEN 'bundle' THEN 'bun' WHEN 'opaque' THEN 'opq' WHEN 'unknown' THEN 'unk' ELSE '-' END ELSE CASE WHEN o.path IS NOT NULL THEN '*' ELSE ' ' END END AS mark FROM i LEFT JOIN fx_dirs d ON d.path = 'Inbox/' || i.name LEFT JOIN fx_docs o ON o.path = 'Inbox/' || i.name", "fx_docs", "fx_dirs", "fx_fs")
def ls_listing(i):
    return directories.listing(i.fx_fs, i.fx_docs, i.fx_dirs, "Inbox")


@query("WITH n AS (SELECT path, CASE WHEN path LIKE '%0' THEN 'bundle' ELSE 'unknown' END AS mode, 'hardcoded' AS source FROM fx_dirs) SELECT d.path, CASE WHEN d.source = 'user' THEN d.mode ELSE n.mode END AS mode, CASE WHEN d.source = 'user' THEN d.source ELSE n.source END AS source FROM fx_dirs d JOIN n ON n.path = d.path", "fx_dirs")
def dirs_upsert(i):
    new = i.fx_dirs.select("path", F.when(F.col("path").endswith("0"), "bundle").otherwise("unknown").alias("mode"), F.lit("hardcoded").alias("source"))
    return directories.upserted(i.fx_dirs, new)


_ENTRIES = f"e AS (SELECT rel, CAST(size AS BIGINT) AS size FROM fx_fs UNION ALL SELECT rel, NULL FROM {_TREE}), x AS (SELECT t.rel AS dir, substr(e.rel, length(t.rel) + 2) AS inner_path, e.size FROM {_TREE} t JOIN e ON starts_with(e.rel, t.rel || '/'))"


@query(f"""WITH {_ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY len(string_split(inner_path, '/')), list_transform(string_split(inner_path, '/'), lambda p: lower(p)), inner_path) AS rn FROM x)
SELECT dir, sha256('[' || string_agg('["' || inner_path || '",' || coalesce(CAST(size AS VARCHAR), 'null') || ']', ',' ORDER BY rn) || ']') AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM r WHERE rn <= 256 GROUP BY dir""", "fx_fs")
def dirs_fingerprint(i):
    return directories.fingerprint(i.fx_fs)


# --- changes ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM fx_docs WHERE path = 'Financial' OR path ILIKE 'Financial/%'", "fx_docs")
def prefix_count(i):
    return i.fx_docs.filter(T.under(F.col("path"), "Financial")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN path = 'Financial' OR path ILIKE 'Financial/%' THEN 'Money' || substr(path, 10) ELSE path END AS path FROM fx_docs", "fx_docs")
def prefix_rewrite(i):
    return documents.relocated(i.fx_docs, "Financial", "Money").select("id", "path")


@query("SELECT o.* FROM fx_ocr o JOIN fx_docs d ON d.id = o.doc_id WHERE NOT (d.path = 'Legal' OR d.path ILIKE 'Legal/%')", "fx_docs", "fx_ocr")
def prefix_delete_cascade(i):
    return documents.cascade(i.fx_ocr, documents.without_prefix(i.fx_docs, "Legal"))


@query("SELECT id, path, hash, dup FROM fx_docs UNION ALL SELECT (SELECT max(id) FROM fx_docs) + 1, 'Legal/copy.mp3', hash, dup FROM fx_docs WHERE path = 'Inbox/doc_000004.mp3'", "fx_docs")
def docs_copy(i):
    return documents.copied(i.fx_docs, "Inbox/doc_000004.mp3", "Legal/copy.mp3").select("id", "path", "hash", "dup")


@query("SELECT id, CASE WHEN path IN ('Inbox/doc_000004.mp3', 'Inbox/doc_000008.txt') THEN '2024-06-01T00:00:00.000000Z' ELSE digested END AS digested FROM fx_docs", "fx_docs")
def docs_mark_digested(i):
    return documents.marked_digested(i.fx_docs, ["Inbox/doc_000004.mp3", "Inbox/doc_000008.txt"], "2024-06-01T00:00:00.000000Z").select("id", "digested")


_AIM = r"""ai AS (SELECT id, path, hash, CASE WHEN coalesce(category, '') = '' THEN 'Unknown' ELSE category END || '/' || concat_ws(' - ', nullif(coalesce(date, ''), ''),
  nullif(trim(regexp_replace(regexp_replace(coalesce((list_filter(string_split(parties, ';'), lambda x: x <> ''))[1], ''), '[\\\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), ''),
  nullif(substr(trim(regexp_replace(regexp_replace(CASE WHEN coalesce(title, '') <> '' THEN title WHEN coalesce(summary, '') <> '' THEN array_to_string(list_filter(regexp_split_to_array(summary, '\s+'), lambda x: x <> '')[1:6], ' ') ELSE 'untitled' END, '[\\\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), 1, 120), ''))
  || lower(regexp_extract(path, '\.[^./]*$')) AS target FROM fx_docs)""".replace("\\\\/", "\\\\/")


@query(f"WITH {_AIM}, pl AS (SELECT a.*, row_number() OVER (PARTITION BY target ORDER BY a.id) AS turn, d.hash AS there FROM ai a LEFT JOIN fx_docs d ON d.path = a.target) SELECT id AS doc_id, path AS source, target, CASE WHEN path = target THEN 'noop' WHEN there = hash THEN 'same' WHEN there IS NOT NULL OR turn > 1 THEN 'collision' ELSE 'move' END AS status FROM pl", "fx_docs")
def file_into_category(i):
    return documents.filing_plan(i.fx_docs)


@query("WITH n AS (SELECT path, 'Changed' AS category FROM fx_docs WHERE id % 10 = 3 UNION ALL SELECT rel, 'Changed' FROM fx_fs WHERE rel NOT IN (SELECT path FROM fx_docs)) SELECT coalesce(d.id, (SELECT max(id) FROM fx_docs) + row_number() OVER (PARTITION BY d.id IS NULL ORDER BY substr(sha256(n.path), 1, 3), n.path)) AS id, n.path, n.category FROM n LEFT JOIN fx_docs d ON d.path = n.path UNION ALL SELECT id, path, category FROM fx_docs WHERE path NOT IN (SELECT path FROM n)", "fx_docs", "fx_fs")
def upsert_docs(i):
    docs = i.fx_docs.select("id", "path", "category")
    new = docs.filter("id % 10 = 3").select("path").union(i.fx_fs.join(docs, F.col("rel") == docs["path"], "left_anti").select("rel")).withColumn("category", F.lit("Changed"))
    return documents.upserted(docs, new)


@query("SELECT id, path FROM fx_docs d WHERE NOT starts_with(path, 'Inbox/') OR EXISTS (SELECT 1 FROM fx_fs f WHERE f.rel = d.path)", "fx_docs", "fx_fs", "fx_dirs")
def orphan_purge(i):
    return documents.purged_orphans(i.fx_docs, i.fx_fs, i.fx_dirs).select("id", "path")


def _migrated(i):
    old = {"docs": i.fx_docs.select("id", "path"), "triage_queue": i.fx_triage, "asr": i.fx_asr.select("doc_id", "decision"), "dirs": i.fx_dirs.withColumn("fingerprint", F.lit("old"))}
    return documents.migrate(old, 1)


@query("SELECT id, path, 'unique' AS dup FROM fx_docs", "fx_docs")
def migrate_v1_to_v8(i):
    return _migrated(i)["docs"]


@query("SELECT doc_id, decision, CAST(0 AS BIGINT) AS diarized, CAST(NULL AS BIGINT) AS channels, '' AS speakers, CAST(NULL AS VARCHAR) AS srt_path, CAST(NULL AS VARCHAR) AS json_path, CAST(NULL AS DOUBLE) AS lang_prob, 'unknown' AS recording_type FROM fx_asr", "fx_asr")
def migrate_speech(i):
    return _migrated(i)["asr"]


@query("SELECT path, mode, source, CAST(NULL AS VARCHAR) AS fingerprint, CAST(NULL AS VARCHAR) AS listing_id, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS decided_at, CAST(NULL AS DOUBLE) AS confidence FROM fx_dirs", "fx_dirs")
def migrate_dirs(i):
    return _migrated(i)["dirs"]


@query("SELECT 'triage' AS name, CAST(count(*) AS BIGINT) AS n FROM fx_triage UNION ALL SELECT 'proposals', 0", "fx_triage")
def migrate_tables(i):
    db = _migrated(i)
    assert "triage_queue" not in db
    tally = lambda name: db[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return tally("triage").unionByName(tally("proposals"))


@query("SELECT id, CASE WHEN path = 'Legal/de' OR path ILIKE 'Legal/de/%' THEN 'Archive/old' || substr(path, 9) ELSE path END AS path, category FROM fx_docs WHERE NOT (path = 'Inbox/src1' OR path ILIKE 'Inbox/src1/%')", "fx_docs")
def docs_ranged(i):
    """A directory moved and another removed in a table that rewrites the files it must."""
    table = Ranged(i.spark, scratch(i.spark, "ranged"))
    table.create(i.fx_docs.select("id", "path", "category"), 16)
    table.move("Legal/de", "Archive/old")
    table.drop("Inbox/src1")
    return table.read()
