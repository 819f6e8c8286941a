"""Queries over digests, edits, moves, removals, proposals, metadata values and further views."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import documents, dups, journal, lifecycle, recognition, reconcile, transcripts
from docloom.plans.registry import query

_PUT = "new AS (SELECT path, 'Changed' AS category, hash, 'unique' AS dup FROM fx_docs WHERE id % 10 = 3 UNION ALL SELECT rel, 'Changed', hash, 'unique' FROM fx_fs WHERE rel NOT IN (SELECT path FROM fx_docs)), aft AS (SELECT coalesce(d.id, (SELECT max(id) FROM fx_docs) + row_number() OVER (PARTITION BY d.id IS NULL ORDER BY substr(sha256(n.path), 1, 3), n.path)) AS id, n.path, n.category, CASE WHEN d.dup IN ('dup', 'keep') THEN d.dup ELSE n.dup END AS dup, TRUE AS put FROM new n LEFT JOIN fx_docs d ON d.path = n.path UNION ALL SELECT id, path, category, dup, FALSE FROM fx_docs WHERE path NOT IN (SELECT path FROM new))"


def _put(i):
    docs = i.fx_docs
    changed = docs.filter("id % 10 = 3").withColumns({"category": F.lit("Changed"), "dup": F.lit("unique")})
    fresh = i.fx_fs.join(docs, F.col("rel") == docs["path"], "left_anti").select(F.lit(0).cast("long").alias("id"), F.col("rel").alias("path"), "hash", "size", F.col("mtime").alias("modified"), F.lit("unique").alias("dup"), F.lit("Changed").alias("category"), F.lit("low").alias("confidence"))
    return lifecycle.persisted(docs, i.fx_triage, docs.limit(0).unionByName(changed).unionByName(fresh, allowMissingColumns=True), "2024-07-01T00:00:00Z")


@query(f"WITH {_PUT} SELECT id, path, category, dup FROM aft", "fx_docs", "fx_fs", "fx_triage")
def digest_persist(i):
    return _put(i)[0].select("id", "path", "category", "dup")


@query(f"WITH {_PUT} SELECT * FROM fx_triage WHERE doc_id NOT IN (SELECT id FROM aft WHERE put) UNION ALL SELECT id, '2024-07-01T00:00:00Z', 'digested' FROM aft WHERE put", "fx_docs", "fx_fs", "fx_triage")
def digest_enqueue(i):
    return _put(i)[1]


@query(f"WITH {_PUT} SELECT doc_id, decision, engine, langs FROM fx_ocr WHERE doc_id NOT IN (SELECT id FROM aft WHERE put) UNION ALL SELECT id, 'ocr_pages', 'tesseract', NULL FROM aft WHERE put", "fx_docs", "fx_fs", "fx_triage", "fx_ocr")
def digest_children(i):
    after = _put(i)[0]
    seen = after.filter("category = 'Changed'").select("path", F.lit("ocr_pages").alias("decision"), F.lit("tesseract").alias("engine"))
    return documents.upserted_children(i.fx_ocr, seen, after).select("doc_id", "decision", "engine", "langs")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN 'T ' || id ELSE title END AS title, CASE WHEN id % 6 = 2 THEN ';a;b ' || id || ';' WHEN id % 6 = 3 THEN '' ELSE tags END AS tags, CASE WHEN id % 6 = 4 THEN 'Unknown' ELSE category END AS category, CASE WHEN id % 6 = 5 THEN CASE WHEN id % 2 = 0 THEN 'high' ELSE 'low' END ELSE confidence END AS confidence, dup FROM fx_docs", "fx_docs")
def docs_edit(i):
    k, n = F.col("id") % 6, F.col("id").cast("string")
    field = F.when(k <= 1, "title").when(k <= 3, "tags").when(k == 4, "category").otherwise("confidence")
    value = F.when(k == 1, F.concat(F.lit("T "), n)).when(k == 2, F.concat(F.lit(" b "), n, F.lit(", a;"))).when(k == 5, F.when(F.col("id") % 2 == 0, "high").otherwise("bogus")).otherwise("")
    edits = i.fx_docs.select("id", field.alias("field"), value.alias("value"), F.lit(2).alias("turn"))
    earlier = i.fx_docs.select("id", field.alias("field"), F.lit("earlier").alias("value"), F.lit(1).alias("turn"))
    other = i.fx_docs.select("id", F.lit("dup").alias("field"), F.lit("keep").alias("value"), F.lit(3).alias("turn"))
    return lifecycle.edited(i.fx_docs, edits.union(earlier).union(other)).select("id", "title", "tags", "category", "confidence", "dup")


_SPEECH = "SELECT a.*, CASE WHEN a.doc_id % 2 = 0 THEN regexp_replace(d.path, '\\.[^./]*$', '') || '.srt' END AS srt_path, d.path FROM fx_asr a JOIN fx_docs d ON d.id = a.doc_id"


def _speech(i):
    return i.fx_asr.join(i.fx_docs.select(F.col("id").alias("doc_id"), "path"), "doc_id").withColumn("srt_path", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("path", r"\.[^./]*$", F.lit(".srt"))))


@query(f"SELECT doc_id, CASE WHEN path = 'Inbox/doc_000004.mp3' AND srt_path IS NOT NULL THEN 'Legal/moved.srt' ELSE srt_path END AS srt_path FROM ({_SPEECH})", "fx_asr", "fx_docs")
def file_move(i):
    return lifecycle.moved_file(i.fx_docs, _speech(i), "Inbox/doc_000004.mp3", "Legal/moved.mp3")[1].select("doc_id", "srt_path")


@query(f"SELECT doc_id, coalesce(srt_path, regexp_replace(path, '\\.[^./]*$', '') || '.srt') AS transcript FROM ({_SPEECH})", "fx_asr", "fx_docs")
def transcript_paths(i):
    return _speech(i).select("doc_id", lifecycle.transcript_path(F.col("srt_path"), F.col("path")).alias("transcript"))


@query("WITH m AS (SELECT regexp_replace(path, '\\.[^./]*$', '') AS s, 'New/' || id AS t FROM fx_docs), f AS (SELECT regexp_replace(rel, '\\.[^./]*$', '') || '.srt' AS rel FROM fx_fs UNION SELECT 'New/4.srt') SELECT s || '.srt' AS source, t || '.srt' AS target FROM m WHERE s || '.srt' IN (SELECT rel FROM f) AND t || '.srt' NOT IN (SELECT rel FROM f)", "fx_docs", "fx_fs")
def sidecars_follow(i):
    moves = i.fx_docs.select(F.col("path").alias("source"), F.concat(F.lit("New/"), F.col("id").cast("string"), F.lit(".mp3")).alias("target"))
    files = i.fx_fs.select(lifecycle.sidecars(F.col("rel")).alias("rel")).union(i.spark.range(1).select(F.lit("New/4.srt"))).distinct()
    return lifecycle.following(moves, files)


@query("WITH l AS (SELECT * FROM fx_docs WHERE NOT (path = 'Legal' OR path ILIKE 'Legal/%')), g AS (SELECT DISTINCT hash FROM fx_docs WHERE path = 'Legal' OR path ILIKE 'Legal/%') SELECT id, path, CASE WHEN hash NOT IN (SELECT hash FROM g) THEN dup WHEN count(*) OVER (PARTITION BY hash) = 1 THEN 'unique' WHEN dup = 'unique' THEN 'dup' ELSE dup END AS dup FROM l", "fx_docs", "fx_ocr", "fx_triage")
def remove_tree(i):
    return lifecycle.removed(i.fx_docs, {}, "Legal")[0].select("id", "path", "dup")


@query("SELECT t.* FROM fx_triage t JOIN fx_docs d ON d.id = t.doc_id WHERE NOT (d.path = 'Legal' OR d.path ILIKE 'Legal/%')", "fx_docs", "fx_triage")
def remove_tree_queue(i):
    return lifecycle.removed(i.fx_docs, {"triage": i.fx_triage}, "Legal")[1]["triage"]


@query("SELECT d.id, CASE WHEN f.hash = d.hash THEN f.size ELSE d.size END AS size, CASE WHEN f.hash = d.hash THEN f.mtime ELSE d.modified END AS modified FROM fx_docs d LEFT JOIN fx_fs f ON f.rel = d.path", "fx_docs", "fx_fs")
def facts_refresh(i):
    return lifecycle.refreshed(i.fx_docs, i.fx_fs).select("id", "size", "modified")


@query("SELECT id, CASE WHEN id % 7 = 5 THEN regexp_replace(path, 'mkv$', 'mka') ELSE path END AS path, CASE WHEN id % 7 = 5 THEN 'sha256:x' || id ELSE hash END AS hash, CASE WHEN id % 7 = 5 THEN size + 1 ELSE size END AS size, CASE WHEN id % 7 = 5 THEN '2024-08-01T00:00:00Z' ELSE modified END AS modified, category FROM fx_docs", "fx_docs")
def docs_remuxed(i):
    some = i.fx_docs.filter("id % 7 = 5").select("id", F.regexp_replace("path", "mkv$", "mka").alias("path"), F.concat(F.lit("sha256:x"), F.col("id").cast("string")).alias("hash"), (F.col("size") + 1).alias("size"), F.lit("2024-08-01T00:00:00Z").alias("modified"))
    return lifecycle.remuxed(i.fx_docs, some).select("id", "path", "hash", "size", "modified", "category")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ocr_full' ELSE decision END AS decision, CASE WHEN doc_id % 3 = 0 THEN '2024-08-01T00:00:00Z' ELSE done END AS done, CASE WHEN doc_id % 3 = 0 THEN 'tesseract' ELSE engine END AS engine, CASE WHEN doc_id % 3 = 0 THEN 'tesseract 5.5.0' ELSE engine_ver END AS engine_ver, CASE WHEN doc_id % 3 = 0 THEN ';eng;heb;' ELSE langs END AS langs FROM fx_ocr", "fx_ocr")
def ocr_restamp(i):
    accepted = i.fx_ocr.filter("doc_id % 3 = 0").select("doc_id", F.lit("ocr_full").alias("decision"))
    return lifecycle.recognised(i.fx_ocr, accepted, "tesseract", "tesseract 5.5.0", "heb+eng", "2024-08-01T00:00:00Z")


_WORTH = "CASE id % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{\"mode\":\"bundle\"}' WHEN 2 THEN 'not json' WHEN 3 THEN '\"text ' || id || '\"' ELSE CAST(id AS STRING) END"


@query("SELECT id, CASE id % 5 WHEN 0 THEN '{\"_raw\":[1,2]}' WHEN 1 THEN '{\"mode\":\"bundle\"}' WHEN 2 THEN '{}' WHEN 3 THEN '{\"_raw\":\"text ' || id || '\"}' ELSE '{\"_raw\":' || id || '}' END AS value FROM fx_proposals", "fx_proposals")
def proposal_values(i):
    return i.fx_proposals.select("id", lifecycle.proposal_value(F.expr(_WORTH)).alias("value"))


@query("WITH a AS (SELECT path, arg_max(CASE WHEN k % 2 = 0 THEN 'bundle' ELSE 'opaque' END, k) AS m FROM (SELECT path, k FROM fx_dirs, (VALUES (1), (2), (3)) v(k) WHERE path LIKE '%1%' OR k = 2 AND path LIKE '%2%') GROUP BY path) SELECT d.path, coalesce(a.m, d.mode) AS mode, CASE WHEN a.m IS NOT NULL THEN 'proposal' ELSE d.source END AS source FROM fx_dirs d LEFT JOIN a ON a.path = d.path", "fx_dirs")
def proposals_apply_mode(i):
    each = i.fx_dirs.select("path", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("id")).filter("path LIKE '%1%' OR id = 2 AND path LIKE '%2%'")
    value = F.concat(F.lit('{"mode": "'), F.when(F.col("id") % 2 == 0, "bundle").otherwise("opaque"), F.lit('"}'))
    made = each.select("id", F.concat(F.lit("dir:"), "path").alias("subject"), F.lit("dir_mode").alias("kind"), value.alias("value"), F.lit("accepted").alias("status"))
    return lifecycle.applied_modes(i.fx_dirs, made)


@query("WITH n AS (SELECT DISTINCT 'doc:' || doc_id % 50 AS subject, CASE WHEN doc_id % 2 = 0 THEN 'recording_type' ELSE 'speaker_name' END AS kind FROM documents), b AS (SELECT subject, kind, status, id, 'x' AS label FROM fx_proposals WHERE kind <> 'speaker_name') SELECT status, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT kind, CASE WHEN status = 'pending' AND (id < max(CASE WHEN status = 'pending' THEN id END) OVER (PARTITION BY subject, kind) OR (subject, kind) IN (SELECT subject, kind FROM n WHERE kind = 'recording_type')) THEN 'superseded' ELSE status END AS status FROM b UNION ALL SELECT kind, 'pending' FROM n) GROUP BY ALL", "fx_proposals")
def proposals_add(i):
    new = i.documents.select(F.concat(F.lit("doc:"), (F.col("doc_id") % 50).cast("string")).alias("subject"), F.when(F.col("doc_id") % 2 == 0, "recording_type").otherwise("speaker_name").alias("kind")).distinct().withColumn("value", F.lit('{"label": "A"}'))
    out = lifecycle.proposed(new, i.fx_proposals.filter("kind <> 'speaker_name'"), "2024-08-01T00:00:00Z")
    return out.groupBy("status", "kind").agg(F.count("*").alias("n"))


@query("SELECT id, json_extract_string(j, '$.path') AS path, json_extract_string(j, '$.ocr.decision') AS ocr, json_extract_string(j, '$.asr.engine') AS asr, tag FROM (SELECT d.id, json_object('path', d.path, 'ocr', json_object('decision', o.decision), 'asr', json_object('engine', a.engine)) AS j, coalesce((list_filter(string_split(d.tags, ';'), lambda x: x <> ''))[1], '') AS tag FROM fx_docs d LEFT JOIN fx_ocr o ON o.doc_id = d.id LEFT JOIN fx_asr a ON a.doc_id = d.id)", "fx_docs", "fx_ocr", "fx_asr")
def docs_json(i):
    made = lifecycle.as_json(documents.full(i.fx_docs, i.fx_ocr, i.fx_asr), dups.siblings(i.fx_docs))
    get = lambda p: F.get_json_object("json", p)
    return made.select("id", get("$.path").alias("path"), get("$.ocr.decision").alias("ocr"), get("$.asr.engine").alias("asr"), F.coalesce(get("$.tags[0]"), F.lit("")).alias("tag"))


@query("SELECT doc_id, 'folder=' || CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END || ';rec=' || coalesce(nullif(a.recording_type, 'unknown'), '') || ';asr=' || coalesce(a.decision, '') AS hints FROM (SELECT id AS doc_id, path FROM fx_docs) d LEFT JOIN fx_asr a USING (doc_id)", "fx_docs", "fx_asr")
def llm_hints(i):
    get = lambda k: F.coalesce(F.element_at("hints", k), F.lit(""))
    return lifecycle.hints(i.fx_docs, i.fx_asr).select("doc_id", F.concat(F.lit("folder="), get("folder"), F.lit(";rec="), get("recording_type"), F.lit(";asr="), get("asr_decision")).alias("hints"))


_OUT = "WITH lost AS (SELECT hash, min(path) AS was FROM fx_docs d WHERE NOT EXISTS (SELECT 1 FROM fx_fs f WHERE f.rel = d.path) GROUP BY hash), j AS (SELECT f.rel, d.hash AS rh, f.hash AS fh, l.was FROM fx_fs f LEFT JOIN fx_docs d ON d.path = f.rel LEFT JOIN lost l ON l.hash = f.hash) SELECT rel, CASE WHEN rh = fh THEN 'ignore' WHEN rh IS NOT NULL THEN 'digest' WHEN was IS NOT NULL THEN 'rename' ELSE 'digest' END AS action FROM j"


@query(_OUT, "fx_docs", "fx_fs")
def watch_routes(i):
    return lifecycle.routed(reconcile.outcomes(i.fx_fs, i.fx_docs))


@query("SELECT 'u' || user_id % 40 AS name, CASE WHEN arg_max(event_type = 'error', event_id) THEN 'stopped' WHEN epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) <= 15 THEN 'running' ELSE 'idle' END AS status FROM events GROUP BY 1")
def service_health(i):
    beats = i.events.select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("ts"), (F.col("event_type") == "error").alias("stopped"), "event_id")
    last = i.events.agg(F.max("ts").alias("now")).first()["now"]
    return lifecycle.health(beats, F.lit(last))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'skip_encrypted' WHEN chars < 100 THEN 'ocr_full' WHEN sparse = 0 THEN 'no_ocr' WHEN sparse <= greatest(1, floor(n * 0.3)) THEN 'ocr_pages' ELSE 'ocr_full' END AS action, CASE WHEN doc_id % 11 = 0 THEN 'pdf_encrypted' WHEN chars < 100 THEN 'no_text_layer' WHEN sparse = 0 THEN NULL WHEN sparse <= greatest(1, floor(n * 0.3)) THEN 'sparse_pages' ELSE 'majority_sparse' END AS reason, CASE WHEN doc_id % 11 <> 0 AND chars >= 100 AND sparse > 0 AND sparse <= greatest(1, floor(n * 0.3)) THEN ps END AS pages FROM (SELECT doc_id, count(*) AS n, sum(length(t)) AS chars, count(*) FILTER (length(t) < 50) AS sparse, string_agg(CASE WHEN length(t) < 50 THEN page END, ',' ORDER BY page) AS ps FROM (SELECT doc_id, page, regexp_replace(page_text, '^\\s+|\\s+$', '', 'g') AS t FROM fx_pages) GROUP BY doc_id)", "fx_pages")
def ocr_actions(i):
    locked = i.fx_pages.filter("doc_id % 11 = 0").select("doc_id").distinct()
    return recognition.ocr_actions(recognition.ocr_decision(i.fx_pages), i.fx_pages, locked).withColumn("pages", F.array_join("pages", ","))


@query("SELECT doc_id, CASE WHEN length(b) <= 60 THEN b WHEN regexp_matches(substr(b, 11, 50), '[ \\n\\t]') THEN regexp_replace(substr(b, 1, 10) || regexp_extract(substr(b, 11, 50), '(?s)^(.*)[ \\n\\t]', 1), '\\s+$', '') ELSE regexp_replace(substr(b, 1, 60), '\\s+$', '') END AS body FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN text = '' THEN lang ELSE regexp_replace(text || chr(10) || chr(10) || lang, '^\\s+|\\s+$', '', 'g') END AS b FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text END AS text FROM documents))")
def ocr_merge(i):
    layer = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    seen = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return i.documents.select("doc_id", recognition.merged_text(layer, seen, 60).alias("body"))


@query("SELECT doc_id, '[\"a\",' || CASE WHEN length(t) > 200 THEN '\"long\"' ELSE '\"short\"' END || ',2,true]' AS list, CAST(doc_id AS VARCHAR) AS n, CAST(21 AS BIGINT) AS items FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def meta_values(i):
    long = F.when(F.length(T.strip(F.col("text"))) > 200, "long").otherwise("short")
    many = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda x: x.cast("string")), ","), F.lit("]"))
    raw = F.concat(F.lit('{"list": [" a ", null, "", {"x": 1}, "'), long, F.lit('", 2, true], "n": '), F.col("doc_id").cast("string"), F.lit(', "gone": {"y": 1}, "blank": "  ", "none": null, "many": '), many, F.lit("}"))
    made = i.documents.select("doc_id", T.metadata_values(raw).alias("m"))
    return made.select("doc_id", F.element_at("m", "list").alias("list"), F.element_at("m", "n").alias("n"), F.size(F.from_json(F.element_at("m", "many"), "array<string>")).cast("long").alias("items"))


@query("SELECT id, CAST(id // 60 AS VARCHAR) || 'm ' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || 's' AS span, strftime(make_timestamp(id * 86400000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN starts_with(path, 'Inbox/') THEN substr(path, 7) ELSE path END AS below, list_contains(string_split(tags, ';'), 'en') AS english FROM fx_docs", "fx_docs")
def small_values(i):
    n = F.col("id")
    return i.fx_docs.select("id", T.minutes_seconds(n + 0.75).alias("span"), T.iso_seconds(n * 86400 + 0.9).alias("iso"), T.relative(F.col("path"), "Inbox").alias("below"), T.holds(F.col("tags"), "en").alias("english"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a|b c' WHEN 1 THEN lang || '|' || source WHEN 2 THEN source ELSE '' END AS items FROM documents")
def lenient_lists(i):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '["a", "b c"]').when(k == 1, F.concat(F.lit(";"), "lang", F.lit("; "), "source", F.lit(";"))).when(k == 2, F.concat(F.lit(" "), "source", F.lit(" "))).otherwise("")
    return i.documents.select("doc_id", F.array_join(T.lenient_list(raw), "|").alias("items"))


@query(r"SELECT doc_id, CASE WHEN s >= 2 THEN told ELSE plain END AS text FROM (SELECT doc_id, string_agg(t, ' ' ORDER BY turn) AS plain FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM fx_segments) WHERE t <> '' GROUP BY doc_id) JOIN (SELECT doc_id, count(DISTINCT speaker) AS s FROM fx_segments GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY r) AS told FROM (SELECT doc_id, r, '[' || first(speaker) || '] ' || string_agg(t, ' ' ORDER BY turn) AS line FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY turn) AS r FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, CASE WHEN lag(speaker) OVER (PARTITION BY doc_id ORDER BY turn) = speaker THEN 0 ELSE 1 END AS n FROM fx_segments WHERE length(regexp_replace(text, '\s', '', 'g')) > 0)) GROUP BY doc_id, r) GROUP BY doc_id) USING (doc_id)", "fx_segments")
def transcript_texts(i):
    return transcripts.full_texts(i.fx_segments)


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(8235) || 'שלום ' || chr(8234) || lang || ' and ' || source || chr(8236) || chr(8236) ELSE 'plain ' || source END AS line FROM documents")
def bidi_lines(i):
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("שלום "), "lang", F.lit(" and "), "source")).otherwise(F.concat(F.lit("plain "), "source"))
    return i.documents.select("doc_id", transcripts.bidi(line).alias("line"))


@query("SELECT page_id, 'author' AS name, 'A ' || page_id AS content FROM pages UNION ALL SELECT page_id, 'og:title', 'T' || page_id FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'refresh', '5' FROM pages WHERE page_id % 3 = 0")
def html_meta(i):
    from docloom.sources import extract

    n = F.col("page_id").cast("string")
    own = F.concat(F.lit('<META name="author" content="A '), n, F.lit('">'), F.when(F.col("page_id") % 2 == 1, F.concat(F.lit('<meta content="T'), n, F.lit('" property="og:title" />'))).otherwise('<meta name="empty" content="">'), F.when(F.col("page_id") % 3 == 0, '<meta\n http-equiv = "refresh" content="5">').otherwise(""))
    return extract.html_meta(i.pages.select("page_id", F.replace("html", F.lit("</title>"), F.concat(F.lit("</title>"), own)).alias("html")), "page_id", "html")


@query("SELECT id, CASE WHEN f.target IS NOT NULL THEN f.target ELSE d.path END AS path FROM fx_docs d LEFT JOIN (SELECT doc_id, target FROM (SELECT id AS doc_id, 'Filed/' || hash AS target, row_number() OVER (PARTITION BY hash ORDER BY id) AS turn FROM fx_docs WHERE id % 2 = 0) WHERE turn = 1) f ON f.doc_id = d.id", "fx_docs")
def docs_filed(i):
    plan = i.fx_docs.filter("id % 2 = 0").select(F.col("id").alias("doc_id"), F.concat(F.lit("Filed/"), "hash").alias("target"), F.lit("move").alias("status"))
    return lifecycle.filed(i.fx_docs, plan).select("id", "path")


@query("SELECT e.id, kind FROM fx_events e WHERE id > 100 AND id <= 110", "fx_events")
def events_window(i):
    return journal.since(i.fx_events, 100, 10).select("id", "kind")


_GIVEN = "ds AS (SELECT DISTINCT doc_id FROM fx_segments)"


def _named(i):
    """Names given to speakers: Ann to the first channel, then another to Ann in every second document, none that counts to
    the second channel; with speech rows of all documents that have segments."""
    d, n = i.fx_segments.select("doc_id").distinct(), F.col("doc_id").cast("string")
    value = lambda label, name: F.to_json(F.struct(label.alias("label"), name.alias("name")))
    ann, row = F.concat(F.lit("Ann "), (F.col("doc_id") % 5).cast("string")), lambda k, v, status: d.select((F.col("doc_id") * 10 + k).alias("id"), F.concat(F.lit("doc:"), n).alias("subject"), F.lit("speaker_name").alias("kind"), v.alias("value"), F.lit(status).alias("status"))
    given = row(1, value(F.lit("CHANNEL_0"), ann), "accepted").union(row(2, value(ann, F.when(F.col("doc_id") % 2 == 0, F.lit("Bea")).otherwise(F.lit(""))), "accepted")).union(row(3, value(F.lit("CHANNEL_1"), F.lit("Zed")), "rejected"))
    asr = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, ";Old;Ann 1;").alias("speakers"))
    return lifecycle.applied_speakers(asr, i.fx_segments, given)


@query(f"WITH {_GIVEN} SELECT doc_id, ';' || array_to_string(list_sort(list_distinct(list_concat(CASE WHEN doc_id % 3 = 0 THEN ['Old', 'Ann 1'] ELSE [] END, ['Ann ' || doc_id % 5], CASE WHEN doc_id % 2 = 0 THEN ['Bea'] ELSE [] END))), ';') || ';' AS speakers FROM ds", "fx_segments")
def speakers_applied(i):
    return _named(i)[0]


@query("SELECT doc_id, turn, CASE WHEN speaker <> 'CHANNEL_0' THEN speaker WHEN doc_id % 2 = 0 THEN 'Bea' ELSE 'Ann ' || doc_id % 5 END AS speaker, text FROM fx_segments", "fx_segments")
def speakers_in_segments(i):
    return _named(i)[1].select("doc_id", "turn", "speaker", "text")
