"""Queries over the smaller decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import policy, transcripts
from docloom.plans.registry import query

_HIDDEN = "EXISTS (SELECT 1 FROM fx_dirs x WHERE x.mode = 'opaque' AND starts_with(d.path, x.path || '/'))"


@query(f"SELECT d.id, d.path, CASE WHEN f.rel IS NULL THEN 'missing_or_not_file' WHEN {_HIDDEN} THEN 'blocked_opaque_subtree' WHEN f.size IS DISTINCT FROM d.size THEN 'size_changed' WHEN d.modified IS NOT NULL AND f.mtime IS DISTINCT FROM d.modified THEN 'mtime_changed' END AS code FROM fx_docs d LEFT JOIN fx_fs f ON f.rel = d.path", "fx_docs", "fx_fs", "fx_dirs")
def digest_gate(i):
    return policy.digest_gate(i.fx_docs, i.fx_fs, i.fx_dirs)


@query("WITH m AS (SELECT path AS source, CASE id % 4 WHEN 0 THEN path WHEN 1 THEN path || '/x' WHEN 2 THEN 'New/' || id ELSE 'Inbox/doc_000004.mp3' END AS target, id % 8 = 3 AS force FROM fx_docs UNION ALL SELECT 'gone', 'x', FALSE) SELECT source, target, force, CASE WHEN source NOT IN (SELECT path FROM fx_docs) THEN 'missing' WHEN source = target THEN 'same_file' WHEN starts_with(target, source || '/') THEN 'into_itself' WHEN target IN (SELECT path FROM fx_docs) AND NOT force THEN 'target_exists' END AS code FROM m", "fx_docs")
def move_checks(i):
    kind = F.col("id") % 4
    target = F.when(kind == 0, F.col("path")).when(kind == 1, F.concat("path", F.lit("/x"))).when(kind == 2, F.concat(F.lit("New/"), F.col("id").cast("string"))).otherwise("Inbox/doc_000004.mp3")
    moves = i.fx_docs.select(F.col("path").alias("source"), target.alias("target"), (F.col("id") % 8 == 3).alias("force"))
    extra = i.spark.range(1).select(F.lit("gone").alias("source"), F.lit("x").alias("target"), F.lit(False).alias("force"))
    return policy.move_checks(moves.unionByName(extra), i.fx_docs)


@query("SELECT a.n AS docs, b.n AS dirs, a.n + b.n > 1 AS confirm FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM fx_docs WHERE path ILIKE 'Legal/%') a, (SELECT CAST(count(*) AS BIGINT) AS n FROM fx_dirs WHERE path = 'Legal' OR path ILIKE 'Legal/%') b", "fx_docs", "fx_dirs")
def confirm_plan(i):
    return policy.affected(i.fx_docs, i.fx_dirs, "Legal")


@query("SELECT CAST(count(*) FILTER (quality = 1) AS BIGINT) AS succeeded, CAST(count(*) FILTER (quality <> 1) AS BIGINT) AS failed, CAST(count(*) FILTER (quality = 1 AND doc_id % 3 = 0) AS BIGINT) AS ready FROM labels")
def batch_totals(i):
    return policy.batch_totals(i.labels.select((F.col("quality") == 1).alias("ok"), (F.col("doc_id") % 3 == 0).alias("queued")))


@query("SELECT CAST(sum(size - size // 3) AS BIGINT) AS saved, round(100 * sum(size - size // 3) / sum(size), 1) AS percent FROM fx_fs", "fx_fs")
def byte_savings(i):
    return policy.savings(i.fx_fs.select(F.col("size").alias("before"), F.floor(F.col("size") / 3).alias("after")))


@query(r"SELECT DISTINCT rel FROM fx_fs WHERE regexp_matches(rel, '^Inbox/[^/]*\.(pdf|mp3)$') OR regexp_matches(rel, '^Legal/(.*/)?doc_00000[^/]\.[^/]*$') OR regexp_matches(rel, '^Financial/src2/[^/]+$')", "fx_fs")
def expand_paths(i):
    return policy.expanded(i.fx_fs, ["Inbox/*.pdf", "Inbox/*.mp3", "Legal/**/doc_00000?.*", "Financial/src2"])


@query(r"SELECT rel FROM fx_fs WHERE (rel LIKE 'Legal/de/%' OR rel LIKE 'Inbox/%.pdf' AND rel NOT LIKE 'Inbox/%/%') AND rel LIKE '%.pdf' UNION SELECT 'Nowhere/a.pdf'", "fx_fs")
def expand_unresolved(i):
    """Arguments that name nothing are kept, globs that match nothing are not; suffixes hold for both."""
    return policy.expanded(i.fx_fs, ["Inbox/*.pdf", "Legal/de", "Nowhere/a.pdf", "Nowhere/b.txt", "No*.pdf"], recursive=True, kinds=(".pdf",), must_exist=False)


@query("SELECT doc_id, CASE WHEN (doc_id % 10) / 10 >= 0.6 THEN lang END AS language, CASE WHEN doc_id % 2 = 0 THEN lang END AS hint FROM documents")
def language_gate(i):
    langs = F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array("lang", F.lit("x")))
    return i.documents.select("doc_id", policy.language_gate(F.col("lang"), (F.col("doc_id") % 10) / 10).alias("language"), policy.single_language(langs).alias("hint"))


_SPOKEN = "SELECT doc_id, lang = 'en' AS sub, n_chars % 3 = 0 AS ran, n_chars % 5 = 0 AS failed, source LIKE '%1%' AS there, CASE doc_id % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'non_speech' WHEN 2 THEN 'phone_call' ELSE 'unknown' END AS kind FROM documents"


@query(f"SELECT doc_id, CASE WHEN sub THEN 'asr_subtitle' WHEN ran THEN 'asr_full' WHEN failed THEN 'asr_failed' WHEN NOT there THEN 'asr_unavailable' ELSE 'no_asr' END AS outcome, kind IN ('music', 'non_speech') AS skipped FROM ({_SPOKEN})")
def speech_policy(i):
    made = i.documents.selectExpr("doc_id", "lang = 'en' AS sub", "n_chars % 3 = 0 AS ran", "n_chars % 5 = 0 AS failed", "source LIKE '%1%' AS there", "CASE doc_id % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'non_speech' WHEN 2 THEN 'phone_call' ELSE 'unknown' END AS kind")
    return made.select("doc_id", policy.speech_outcome(F.col("sub"), F.col("ran"), F.col("failed"), F.col("there")).alias("outcome"), policy.skips_speech(F.col("kind")).alias("skipped"))


_SPACES = [*policy.NAMESPACES, "urn:x", ""]
_CLARK = "CASE WHEN doc_id % 11 = 10 THEN source ELSE '{' || (" + "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SPACES)) + " END) || '}' || source || lang END"


@query(f"SELECT doc_id, CASE WHEN NOT starts_with(c, '{{') THEN c ELSE coalesce((" + "CASE regexp_extract(c, '^\\{([^}]*)\\}', 1) " + " ".join(f"WHEN '{s}' THEN '{p}:'" for s, p in policy.NAMESPACES.items()) + f" END), 'xmp_') || regexp_replace(c, '^\\{{[^}}]*\\}}', '') END AS name FROM (SELECT doc_id, {_CLARK} AS c FROM documents)")
def xmp_names(i):
    return i.documents.select("doc_id", policy.short_name(F.expr(_CLARK)).alias("name"))


@query("SELECT doc_id, 'a=' || lang || ';b=' || source || ';c=1' AS merged FROM documents")
def metadata_merge(i):
    one, two = F.create_map(F.lit("a"), "lang", F.lit("b"), "source"), F.create_map(F.lit("a"), F.lit("z"), F.lit("c"), F.lit("1"))
    entries = F.transform(F.array_sort(F.map_entries(policy.first_wins(one, two))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return i.documents.select("doc_id", F.array_join(entries, ";").alias("merged"))


_WHO = "regexp_extract(path, '^Financial/([^/]+)/', 1)"


@query(f"SELECT id, 'Me and ' || CASE WHEN {_WHO} <> '' THEN {_WHO} ELSE '{{who}}' END || ' of {{firm}}' AS speakers FROM fx_docs", "fx_docs")
def speaker_names(i):
    return i.fx_docs.select("id", policy.speaker_template("{owner} and {who} of {firm}", "Me", F.col("path"), "^Financial/([^/]+)/", ("who",)).alias("speakers"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Scanning' WHEN doc_id % 4 = 1 THEN '3 waiting' WHEN doc_id % 4 = 2 THEN 'last' ELSE 'Idle' END AS status FROM documents")
def tray_status(i):
    k = F.col("doc_id") % 4
    return i.documents.select("doc_id", policy.tray_status(F.when(k == 0, "Scanning"), F.when(k == 1, 3).otherwise(0), F.when(k == 2, "last")).alias("status"))


_DONE = "CASE n_chars % 3 WHEN 0 THEN 'no_ocr' ELSE 'ocr_pages' END AS ocr, CASE n_chars % 4 WHEN 0 THEN 'asr_full' ELSE 'no_asr' END AS asr, CASE WHEN n_chars % 5 = 0 THEN 'encrypted: ' || source ELSE '' END AS error"


@query(f"SELECT doc_id, source || ' | ocr=' || ocr || CASE WHEN asr <> 'no_asr' THEN ' | asr=' || asr ELSE '' END || ' | tier=strict | category=' || lang || ' | target=db | ' || n_chars || 'ms' || CASE WHEN error <> '' THEN ' | error=' || error ELSE '' END AS line FROM (SELECT *, {_DONE} FROM documents)")
def result_lines(i):
    made = i.documents.selectExpr("*", *_DONE.split(", CASE")[:1], *(f"CASE{x}" for x in _DONE.split(", CASE")[1:]))
    return made.select("doc_id", policy.result_line(F.col("source"), F.col("ocr"), F.col("asr"), F.lit("strict"), F.col("lang"), F.lit("db"), F.col("n_chars"), F.col("error")).alias("line"))


@query("SELECT doc_id, turn, CASE speaker WHEN 'CHANNEL_0' THEN 'Owner' ELSE speaker END AS speaker FROM fx_segments", "fx_segments")
def relabel_speakers(i):
    names = i.fx_segments.filter("speaker = 'CHANNEL_0'").select("doc_id", "speaker", F.lit("Owner").alias("name")).distinct()
    return policy.relabelled(i.fx_segments, names).select("doc_id", "turn", "speaker")


@query("SELECT id, regexp_replace(path, '\\.[^./]+$', '') || '.srt' AS sidecar FROM fx_docs", "fx_docs")
def sidecar_paths(i):
    from docloom.sources.transcript_files import sidecar

    return i.fx_docs.select("id", sidecar(F.col("path")).alias("sidecar"))


@query("SELECT doc_id, string_agg(cue || chr(10) || times || chr(10) || '[' || speaker || '] ' || text || chr(10), chr(10) ORDER BY cue) AS srt FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_start, turn) AS cue, (SELECT format('{:02d}:{:02d}:{:02d},{:03d}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) FROM (SELECT CAST(round_even(seg_start * 1000, 0) AS BIGINT) AS m)) || ' --> ' || (SELECT format('{:02d}:{:02d}:{:02d},{:03d}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) FROM (SELECT CAST(round_even(seg_end * 1000, 0) AS BIGINT) AS m)) AS times, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, speaker FROM fx_segments WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0) GROUP BY doc_id", "fx_segments")
def subtitle_files(i):
    from docloom.sources.transcript_files import subtitles

    return subtitles(i.fx_segments)


@query("SELECT doc_id, turn, seg_start, seg_end, speaker, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_start, turn) - 1 AS turn, seg_start, seg_end, speaker, text FROM fx_segments)", "fx_segments")
def transcript_twins(i):
    from docloom.sources.transcript_files import from_twins, twins

    return from_twins(twins(i.fx_segments)).withColumn("turn", F.col("turn").cast("long"))


@query("SELECT id, title, category, tags, parties, summary FROM (SELECT id, title, category, tags, parties, regexp_replace(summary, '^\\s+|\\s+$', '', 'g') AS summary FROM fx_docs)", "fx_docs")
def markdown_round_trip(i):
    from docloom.sources.markdown import parse, render

    return parse(render(i.fx_docs)).select("id", "title", "category", "tags", "parties", "summary")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'eng' ELSE '' END AS code FROM fx_docs", "fx_docs")
def language_codes(i):
    table = F.create_map(*(F.lit(x) for p in transcripts.CODES.items() for x in p))
    return i.fx_docs.select("id", F.coalesce(F.element_at(table, F.when(F.col("id") % 3 == 0, "en").otherwise("zz")), F.lit("")).alias("code"))


@query("SELECT id, 'doc:' || id AS subject, id AS back FROM fx_docs", "fx_docs")
def proposal_subjects(i):
    from docloom.operators.journal import subject, subject_key

    made = i.fx_docs.select("id", subject("doc", F.col("id")).alias("subject"))
    return made.withColumn("back", subject_key(F.col("subject"), "doc").cast("long"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short FROM documents")
def ellipsis(i):
    return i.documents.select("doc_id", T.ellipsis(F.col("text"), 40).alias("short"))
