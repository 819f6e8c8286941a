"""Queries over proposals, events, texts, transcripts, model answers and the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import journal, recognition, search, transcripts
from docloom.plans.registry import query
from docloom.session import scratch
from docloom.sources import extract

_LAST = "CASE WHEN status = 'pending' AND id <> max(CASE WHEN status = 'pending' THEN id END) OVER (PARTITION BY subject, kind) THEN 'superseded' ELSE status END"


@query(f"SELECT id, subject, kind, {_LAST} AS status FROM fx_proposals", "fx_proposals")
def proposals_latest(i):
    return journal.superseded(i.fx_proposals).select("id", "subject", "kind", "status")


@query(f"SELECT id, subject, value FROM (SELECT *, {_LAST} AS s FROM fx_proposals) WHERE s = 'pending' AND kind = 'dir_mode' ORDER BY id LIMIT 20", "fx_proposals")
def proposals_pending(i):
    return journal.pending(i.fx_proposals, kind="dir_mode", limit=20).select("id", "subject", "value")


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, {_LAST} AS s FROM fx_proposals) WHERE s = 'pending' GROUP BY kind", "fx_proposals")
def proposals_counts(i):
    return journal.pending(i.fx_proposals).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT a.doc_id, coalesce(p.value, a.recording_type) AS recording_type FROM fx_asr a LEFT JOIN (SELECT CAST(substr(subject, 5) AS BIGINT) AS d, max_by(value, id) AS value FROM fx_proposals WHERE status = 'accepted' AND kind = 'recording_type' GROUP BY 1) p ON p.d = a.doc_id", "fx_asr", "fx_proposals")
def proposals_apply_type(i):
    return journal.applied_types(i.fx_asr, i.fx_proposals).select("doc_id", "recording_type")


@query("SELECT id, CASE WHEN id IN (1, 2, 3, 4) AND status = 'pending' THEN 'accepted' ELSE status END AS status FROM fx_proposals", "fx_proposals")
def proposals_accept(i):
    return journal.decided(i.fx_proposals, [1, 2, 3, 4], "accepted").select("id", "status")


@query("SELECT id, kind, payload FROM fx_events WHERE id > 9000 ORDER BY id LIMIT 500", "fx_events")
def events_since(i):
    return journal.since(i.fx_events, 9000).select("id", "kind", "payload")


@query("SELECT coalesce(max(id), 0) AS id FROM fx_events", "fx_events")
def events_latest_id(i):
    return i.fx_events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))


_KINDS = """ev AS (SELECT id, CASE id % 6 WHEN 1 THEN 'processed' WHEN 2 THEN 'paused' ELSE kind END AS kind, CASE id % 6 WHEN 1 THEN '{"file": "f' || id || '.pdf", "category": "Legal"' || CASE WHEN id % 4 = 1 THEN ', "target": "Legal/x"' ELSE '' END || '}' WHEN 2 THEN '{"by": "u' || id || '", "n": ' || id || ', "why": null, "ok": true}' WHEN 3 THEN '{"file": "f' || id || '", "error": "e' || id % 5 || '"}' ELSE payload END AS payload FROM fx_events)"""


@query(f"""WITH {_KINDS}, x AS (SELECT id, kind, payload, coalesce(TRY_CAST(payload::JSON->>'ready_count' AS INT), 0) AS r, coalesce(TRY_CAST(payload::JSON->>'failed' AS INT), 0) AS f, payload::JSON->>'file' AS n, payload::JSON->>'error' AS e, payload::JSON->>'category' AS c, payload::JSON->>'target' AS t FROM ev)
SELECT id, CASE WHEN (kind = 'digest_finished' AND r <= 0) OR kind = 'error' THEN 'Error' ELSE 'Documents' END AS title,
  CASE WHEN kind = 'digest_finished' AND r > 0 THEN r || CASE WHEN r = 1 THEN ' file' ELSE ' files' END || ' ready for triage' WHEN kind = 'digest_finished' THEN 'failed to digest ' || coalesce(nullif(n, ''), '?') WHEN kind = 'error' THEN coalesce(n, '?') || ': ' || coalesce(e, '?')
  WHEN kind = 'processed' THEN coalesce(n, '?') || ' → ' || coalesce(c, '?') || coalesce(' (' || nullif(t, '') || ')', '') ELSE kind || ': ' || replace(replace(replace(payload, ': null', ': None'), ': true', ': True'), '"', chr(39)) END AS body
FROM x WHERE kind NOT IN ('scan_finished', 'scan_started', 'digest_started') AND NOT (kind = 'digest_finished' AND r <= 0 AND f <= 0)""", "fx_events")
def events_toasts(i):
    k, n = F.col("id") % 6, F.col("id").cast("string")
    kind = F.when(k == 1, "processed").when(k == 2, "paused").otherwise(F.col("kind"))
    filed = F.concat(F.lit('{"file": "f'), n, F.lit('.pdf", "category": "Legal"'), F.when(F.col("id") % 4 == 1, ', "target": "Legal/x"').otherwise(""), F.lit("}"))
    other = F.concat(F.lit('{"by": "u'), n, F.lit('", "n": '), n, F.lit(', "why": null, "ok": true}'))
    broken = F.concat(F.lit('{"file": "f'), n, F.lit('", "error": "e'), (F.col("id") % 5).cast("string"), F.lit('"}'))
    payload = F.when(k == 1, filed).when(k == 2, other).when(k == 3, broken).otherwise(F.col("payload"))
    return journal.toasts(i.fx_events.withColumns({"kind": kind, "payload": payload}))


@query("SELECT max(id) AS id, arg_max_null(CASE kind WHEN 'digest_started' THEN 'Digesting ' || (payload::JSON->>'file') WHEN 'scan_started' THEN 'Scanning…' END, id) AS label FROM fx_events WHERE kind IN ('digest_started', 'digest_finished', 'scan_started', 'scan_finished')", "fx_events")
def events_run_state(i):
    return journal.run_state(i.fx_events)


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY ts, id) AS k, id, ts FROM (SELECT event_id + 1 AS id, ts FROM events)),
w AS (SELECT k, id, ts, ts AS opened FROM e WHERE k = 1 UNION ALL SELECT e.k, e.id, e.ts, CASE WHEN e.ts - w.opened >= INTERVAL 5 SECOND THEN e.ts ELSE w.opened END FROM w JOIN e ON e.k = w.k + 1)
SELECT min(ts) AS opened, CAST(count(*) AS BIGINT) AS n, arg_max(id, k) AS last_id FROM (SELECT *, sum(CASE WHEN opened = ts AND k = first_k THEN 1 ELSE 0 END) OVER (ORDER BY k) AS window_no FROM (SELECT *, min(k) OVER (PARTITION BY opened) AS first_k FROM w)) GROUP BY window_no""")
def events_debounced(i):
    return journal.debounced(i.fx_events)


@query("SELECT n, CASE WHEN n > 1 THEN 'Documents' ELSE 't' || n END AS title, CASE WHEN n > 1 THEN 'Processed ' || n || ' files; latest: t' || n ELSE 'b' || n END AS body FROM (SELECT doc_id % 4 AS n FROM documents)")
def notices(i):
    n = F.col("doc_id") % 4
    made = journal.notice(n, F.concat(F.lit("t"), n.cast("string")), F.concat(F.lit("b"), n.cast("string")))
    return i.documents.select(n.alias("n"), made.alias("x")).select("n", "x.title", "x.body")


# --- text -------------------------------------------------------------------------------------------------------------

_TRIM = "CASE WHEN length({c}) <= {n} THEN {c} WHEN regexp_matches(substr({c}, {n} - 49, 50), '[ \\n\\t]') THEN regexp_replace(substr({c}, 1, {n} - 50) || regexp_extract(substr({c}, {n} - 49, 50), '(?s)^(.*)[ \\n\\t]', 1), '\\s+$', '') ELSE regexp_replace(substr({c}, 1, {n}), '\\s+$', '') END"


def _trim(c: str, n: int) -> str:
    return _TRIM.replace("{c}", c).replace("{n}", str(n))


@query(f"SELECT doc_id, {_trim('text', 300)} AS text FROM documents")
def text_trim(i):
    return i.documents.select("doc_id", T.trim_to_word(F.col("text"), 300).alias("text"))


_CAP = f"WITH c AS (SELECT doc_id, page, {_trim('page_text', 300)} AS text FROM fx_pages), k AS (SELECT *, row_number() OVER w AS k, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page)), g AS (SELECT doc_id, page, text FROM k WHERE k <= 5 AND NOT (k > 3 AND b >= 800)) "


@query(_CAP + "SELECT * FROM g", "fx_pages")
def text_page_cap(i):
    return recognition.capped_pages(i.fx_pages, per_page=300, enough=800)


@query(_CAP + ", n AS (SELECT doc_id, count(*) AS n FROM fx_pages GROUP BY doc_id) SELECT g.doc_id, string_agg('--- Page ' || (page + 1) || ' of ' || n || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) || CASE WHEN count(*) < max(n) THEN chr(10) || chr(10) || '--- (showing pages ' || (min(page) + 1) || '-' || (max(page) + 1) || ' of ' || max(n) || ') ---' ELSE '' END AS body FROM g JOIN n ON n.doc_id = g.doc_id GROUP BY g.doc_id", "fx_pages")
def text_sections_rendered(i):
    totals = i.fx_pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return recognition.rendered(recognition.capped_pages(i.fx_pages, per_page=300, enough=800), totals)


_ODD = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'BM' || text WHEN 2 THEN text || repeat(chr(65533), CAST(length(text) // 40 AS BIGINT) + 1) ELSE repeat(chr(2), CAST(length(text) // 10 AS BIGINT) + 1) || text END"


@query(f"SELECT doc_id, starts_with(t, 'BM') OR contains(t, chr(65533)) AND length(regexp_replace(t, '[^\\x{{FFFD}}]', '', 'g')) / length(t) > 0.01 OR length(regexp_replace(t, '[^\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) / greatest(length(t), 1) > 0.05 AS garbled FROM (SELECT doc_id, {_ODD} AS t FROM documents)")
def text_garbled(i):
    kind, n = F.col("doc_id") % 4, F.length("text")
    t = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("BM"), "text")).when(kind == 2, F.concat("text", F.repeat(F.lit("\ufffd"), (F.floor(n / 40) + 1).cast("int")))).otherwise(F.concat(F.repeat(F.lit("\x02"), (F.floor(n / 10) + 1).cast("int")), "text"))
    return i.documents.select("doc_id", T.garbled(F.encode(t, "UTF-8"), t).alias("garbled"))


_STRIPPED = r"regexp_replace(page_text, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, n AS n_pages, chars, sparse, CASE WHEN chars < 100 THEN 'ocr_full/no_text_layer' WHEN sparse = 0 THEN 'no_ocr' WHEN sparse <= greatest(1, floor(n * 0.3)) THEN 'ocr_pages' ELSE 'ocr_full/majority_sparse' END AS decision FROM (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length({_STRIPPED})) AS BIGINT) AS chars, CAST(count(*) FILTER (length({_STRIPPED}) < 50) AS BIGINT) AS sparse FROM fx_pages GROUP BY doc_id)", "fx_pages")
def ocr_decision(i):
    return recognition.ocr_decision(i.fx_pages)


@query(f'SELECT doc_id, CAST(min(page) + 1 AS BIGINT) AS "first", CAST(max(page) + 1 AS BIGINT) AS "last" FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM fx_pages WHERE length({_STRIPPED}) < 50) GROUP BY doc_id, g', "fx_pages")
def ocr_page_ranges(i):
    return recognition.page_ranges(i.fx_pages.filter(F.length(T.strip(F.col("page_text"))) < 50))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'ocr_pages' WHEN toxic = 1 THEN 'ocr_failed' WHEN doc_id % 2 = 0 THEN 'ocr_unavailable' ELSE 'no_ocr' END AS outcome FROM labels")
def ocr_outcome(i):
    return i.labels.select("doc_id", recognition.outcome(1 - F.col("quality"), F.col("toxic") == 1, F.col("doc_id") % 2 != 0).alias("outcome"))


@query("SELECT doc_id, ';' || array_to_string(list_sort(list_distinct([lang, source, 'a'])), ';') || ';' AS list, array_to_string(list_sort(list_distinct([lang, source, 'a'])), ',') AS items FROM documents")
def semilist_roundtrip(i):
    made = i.documents.select("doc_id", T.semilist(F.array(F.concat("source", F.lit(";")), "lang", F.lit(" a "), F.lit(""), "lang")).alias("list"))
    return made.withColumn("items", F.array_join(T.from_semilist(F.col("list")), ","))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, 'eng', 'heb'])), ',') AS langs FROM documents")
def lang_normalize(i):
    return i.documents.select("doc_id", F.array_join(T.languages(F.concat(F.lit("heb+"), "lang", F.lit(", eng;"))), ",").alias("langs"))


@query("SELECT doc_id, 'lang=' || lang || ';text=' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS meta FROM (SELECT doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def meta_clean(i):
    m = T.metadata_clean(F.create_map(F.lit("text"), "text", F.lit("lang"), "lang", F.lit("none"), F.lit("  "), F.lit("nul"), F.lit("a\x00b"), F.lit("xmp"), F.lit("<?xpacket begin")))
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return i.documents.select("doc_id", F.array_join(entries, ";").alias("meta"))


@query("SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 3 <> 0 THEN 'img:' || source || '=' || lang END, CASE WHEN t <> '' THEN 'img:text=' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END END) AS meta FROM (SELECT doc_id, source, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def meta_collect(i):
    """Under a prefix, without the keys that are never kept, whatever their values."""
    key = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*(F.lit(k) for k in T.SKIPPED)), (F.col("doc_id") % len(T.SKIPPED) + 1).cast("int"))).otherwise(F.col("source"))
    m = T.metadata_collect(F.create_map(F.lit("text"), "text", key, "lang"), "img:")
    return i.documents.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


@query(r"SELECT page_id, CASE WHEN p = '.' THEN '' ELSE p END AS path FROM (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(s, '^[A-Za-z]:') THEN lower(s[1]) || s[2:] ELSE s END, '/+$', '') AS p FROM (SELECT page_id, replace(trim(raw), chr(92), '/') AS s FROM fx_raw_paths))", "fx_raw_paths")
def path_normalize(i):
    return i.fx_raw_paths.select("page_id", T.normal_path(F.col("raw")).alias("path"))


_SLUG = r"""substr(trim(regexp_replace(regexp_replace({c}, '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), 1, 120)"""


@query(f"SELECT doc_id, {_SLUG.format(c='text')} AS slug FROM documents")
def slugify(i):
    return i.documents.select("doc_id", T.slug(F.col("text")).alias("slug"))


_TOPIC = r"CASE WHEN coalesce(title, '') <> '' THEN title WHEN coalesce(summary, '') <> '' THEN array_to_string(list_filter(regexp_split_to_array(summary, '\s+'), lambda x: x <> '')[1:6], ' ') ELSE 'untitled' END"
_SENDER = "coalesce((list_filter(string_split(parties, ';'), lambda x: x <> ''))[1], '')"


@query(f"SELECT id, coalesce(nullif(concat_ws(' - ', nullif({_SLUG.format(c=chr(39) * 2 + ' || coalesce(date, ' + chr(39) * 2 + ')')}, ''), nullif({_SLUG.format(c=_SENDER)}, ''), nullif({_SLUG.format(c=_TOPIC)}, '')), ''), 'untitled') || '.' || ltrim(lower(regexp_extract(path, '\\.[^./]*$')), '.') AS name FROM fx_docs", "fx_docs")
def smart_filename(i):
    sender = F.get(T.from_semilist(F.col("parties")), F.lit(0))
    return i.fx_docs.select("id", T.smart_name(F.col("date"), sender, F.col("title"), F.col("summary"), T.suffix_of(F.col("path"))).alias("name"))


_NAMES = "CASE doc_id % 7 WHEN 0 THEN lang || ', ' || source || '; x/y' WHEN 1 THEN lang || ' and ' || source WHEN 2 THEN lang || ' & ' || source WHEN 3 THEN 'Sand & Co.' WHEN 4 THEN ' ; ' WHEN 5 THEN '' ELSE source || '&' || lang || 'and' END"


@query(f"SELECT doc_id, CASE WHEN raw = '' THEN '' WHEN len(p) = 0 THEN trim(raw) ELSE array_to_string(p, '|') END AS parties FROM (SELECT doc_id, raw, list_filter(list_transform(regexp_split_to_array(raw, '[,;/]| and | & '), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT doc_id, {_NAMES} AS raw FROM documents))")
def parties_split(i):
    return i.documents.select("doc_id", F.array_join(T.parties(F.expr(_NAMES)), "|").alias("parties"))


@query("SELECT id, CASE lower(regexp_extract(path, '\\.[^./]*$')) WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' WHEN '.html' THEN 'text/html' WHEN '.png' THEN 'image/png' WHEN '.mp3' THEN 'audio/mpeg' WHEN '.mkv' THEN 'video/x-matroska' ELSE 'application/octet-stream' END AS mime FROM fx_docs", "fx_docs")
def mime_by_ext(i):
    return i.fx_docs.select("id", T.media_type(F.col("path")).alias("mime"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def hash_prefix(i):
    return i.documents.select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT id, CASE WHEN id % 12 > 1 THEN CAST(id % 100 AS VARCHAR) END AS amount FROM fx_docs", "fx_docs")
def json_safe(i):
    return i.fx_docs.select("id", F.element_at(T.json_map(F.col("extra")), "amount").alias("amount"))


@query("SELECT doc_id, 'צה״ל \"' || lang || '\" ש״' AS text FROM documents")
def hebrew_quotes(i):
    return i.documents.select("doc_id", T.gershayim(F.concat(F.lit('צה"ל "'), "lang", F.lit('" ש"'))).alias("text"))


# --- speech -----------------------------------------------------------------------------------------------------------

_SAID = r"length(regexp_replace(text, '\s', '', 'g')) > 0"
_CLEAN = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _time(c: str) -> str:
    return f"(SELECT format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) FROM (SELECT CAST(greatest(round_even({c} * 1000, 0), 0) AS BIGINT) AS m))"


@query("SELECT doc_id, string_agg(speaker, ',' ORDER BY a) AS speakers, CAST(count(*) AS BIGINT) AS n_speakers FROM (SELECT doc_id, speaker, min(turn) AS a FROM fx_segments GROUP BY ALL) GROUP BY doc_id", "fx_segments")
def transcript_speakers(i):
    return transcripts.speakers(i.fx_segments)


@query(f"SELECT doc_id, r AS run, first(speaker) AS speaker, min(seg_start) AS seg_start, max(seg_end) AS seg_end, CASE WHEN coalesce(first(speaker), '') <> '' THEN '[' || first(speaker) || '] ' ELSE '' END || string_agg({_CLEAN}, ' ' ORDER BY turn) AS text FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY turn) AS BIGINT) AS r FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY doc_id ORDER BY turn) = speaker THEN 0 ELSE 1 END AS n FROM fx_segments WHERE {_SAID} AND doc_id IN (SELECT doc_id FROM fx_segments WHERE speaker <> '' GROUP BY doc_id HAVING count(DISTINCT speaker) >= 2))) GROUP BY doc_id, r", "fx_segments")
def transcript_runs(i):
    return transcripts.runs(i.fx_segments)


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_start, turn) AS BIGINT) AS cue, {_time('seg_start')} || ' --> ' || {_time('seg_end')} AS times, '[' || speaker || '] ' || {_CLEAN} AS text FROM fx_segments WHERE {_SAID}", "fx_segments")
def transcript_srt(i):
    return transcripts.cues(i.fx_segments)


@query("SELECT doc_id, turn, speaker, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_start, seg_end, speaker, turn) AS BIGINT) AS place, max(seg_end) OVER (PARTITION BY doc_id) AS duration FROM fx_segments", "fx_segments")
def transcript_channel_merge(i):
    return transcripts.merged_channels(i.fx_segments)


@query("SELECT file_id, idx, language, frames FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY language IN ('', 'he', 'heb', 'en', 'eng') DESC, (NOT forced AND NOT hearing_impaired) DESC, frames DESC, idx) AS rn FROM fx_streams WHERE codec_type = 'subtitle' AND codec_name <> 'hdmv_pgs_subtitle') WHERE rn = 1", "fx_streams")
def subtitle_pick(i):
    return transcripts.chosen_subtitle(i.fx_streams)


@query(rf"SELECT doc_id, turn, regexp_replace({_CLEAN}, '\s*\n\s*', ' ', 'g') AS text FROM fx_segments WHERE {_SAID}", "fx_segments")
def srt_strip(i):
    srt = F.concat(F.lit("1\n00:00:00,000 --> 00:00:02,000\n<i>"), F.col("text"), F.lit("</i>\n"))
    return transcripts.spoken(i.fx_segments).select("doc_id", "turn", T.srt_words(srt).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'music' WHEN doc_id % 5 = 1 THEN 'voice_note' WHEN channels >= 2 THEN 'phone_call' WHEN doc_id % 3 = 1 THEN 'non_speech' ELSE 'unknown' END AS type, doc_id % 5 <> 1 AND (doc_id % 5 = 0 OR channels >= 2 OR doc_id % 3 = 1) AS committed FROM fx_asr", "fx_asr")
def recording_type(i):
    tags = F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("audio_Artist"), F.lit("x"))).otherwise(F.create_map(F.lit("encoder"), F.lit("y")))
    path = F.when(F.col("doc_id") % 5 == 1, "Notes/a.mp3").otherwise("b.mp3")
    kind = transcripts.recording_type(tags, path, F.col("channels"), F.when(F.col("doc_id") % 3 == 1, 0.1).otherwise(0.9), [("^Notes/", "voice_note"), ("^Calls/", "phone_call")])
    return i.fx_asr.select("doc_id", kind.alias("k")).select("doc_id", "k.type", "k.committed")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN CASE WHEN channels >= 2 THEN 'voip:48k' ELSE 'voip:24k' END ELSE CASE WHEN channels >= 2 THEN 'audio:96k' ELSE 'audio:64k' END END AS preset FROM fx_asr", "fx_asr")
def opus_preset(i):
    rate = F.when(F.col("doc_id") % 3 == 1, 8000).when(F.col("doc_id") % 3 == 2, 16000)
    return i.fx_asr.select("doc_id", transcripts.opus_preset(rate, F.col("channels")).alias("preset"))


# --- pages and answers ------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\slang=\x22([^\x22]*)\x22', 1) AS lang FROM pages")
def html_title_lang(i):
    return i.pages.select("page_id", extract.html_title(F.col("html")).alias("title"), extract.html_lang(F.col("html")).alias("lang"))


@query()
def html_text(i):
    return extract.html_pages(i.pages, "page_id", "html")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Doc ' || doc_id WHEN doc_id % 4 = 3 THEN 'P' END AS title FROM fx_llm_raw", "fx_llm_raw")
def llm_strict(i):
    return i.fx_llm_raw.select("doc_id", recognition.strict(F.col("raw"))["title"].alias("title"))


_BROKEN = """(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN raw || ' trailing' WHEN 1 THEN '{"title": "cut ' || source || '", "amount": -4.5, "currency": "usd", "subcategory": "sub ' || lang WHEN 2 THEN '"amount": 12.50, "currency": "USD", "subcategory":"' || lang || '", "review" : false' WHEN 3 THEN 'x "tags": ["a", "' || lang || '"] y' WHEN 4 THEN 'only "date":"2024-03-0' || (1 + doc_id % 9) || '"' ELSE raw END AS raw FROM fx_llm_raw)"""


def _broken(i):
    k = F.col("doc_id") % 6
    joined = i.fx_llm_raw.join(i.documents.select("doc_id", "source", "lang"), "doc_id")
    one = F.concat(F.lit('{"title": "cut '), "source", F.lit('", "amount": -4.5, "currency": "usd", "subcategory": "sub '), "lang")
    two = F.concat(F.lit('"amount": 12.50, "currency": "USD", "subcategory":"'), "lang", F.lit('", "review" : false'))
    raw = F.when(k == 0, F.concat("raw", F.lit(" trailing"))).when(k == 1, one).when(k == 2, two).when(k == 3, F.concat(F.lit('x "tags": ["a", "'), "lang", F.lit('"] y'))).when(k == 4, F.concat(F.lit('only "date":"2024-03-0'), (1 + F.col("doc_id") % 9).cast("string"), F.lit('"'))).otherwise(F.col("raw"))
    return joined.select("doc_id", raw.alias("raw"))


def _field(name: str, inner: str) -> str:
    return f"nullif(regexp_extract(raw, '\"{name}\"\\s*:\\s*{inner}', 1), '') AS {name}"


_LONG, _SHORT = '"((?:[^"\\\\]|\\\\.)*)"', '"([^"]+)"'
_FOUND = ", ".join([*(_field(n, _LONG) for n in ("title", "summary", "reason")), *(_field(n, _SHORT) for n in ("category", "subcategory", "correspondent", "language", "confidence")), _field("date", '"(\\d{4}-\\d{2}-\\d{2})"'), _field("amount", '([0-9]+(?:\\.[0-9]+)?)'), _field("currency", '"([A-Z]{3})"'), _field("review", "(true|false)")])


@query(f"""SELECT doc_id, {_FOUND}, array_to_string(regexp_extract_all(regexp_extract(raw, '"tags"\\s*:\\s*\\[([^\\]]*)\\]', 1), '"([^"]+)"', 1), ',') AS tags FROM {_BROKEN.replace("FROM fx_llm_raw", "FROM fx_llm_raw JOIN documents USING (doc_id)")}""", "fx_llm_raw")
def llm_regex_recover(i):
    return _broken(i).select("doc_id", recognition.recovered(F.col("raw")).alias("x")).select("doc_id", "x.*").withColumn("tags", F.array_join("tags", ","))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN CASE doc_id % 4 WHEN 1 THEN 'repair' WHEN 2 THEN 'placeholder' ELSE 'strict' END WHEN doc_id % 6 = 0 AND doc_id % 4 = 2 THEN 'placeholder' ELSE 'pattern' END AS tier FROM documents""")
def llm_cascade(i):
    return recognition.parsed(_broken(i)).select("doc_id", "tier")


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN CASE doc_id % 4 WHEN 1 THEN 'repair' ELSE 'strict' END WHEN doc_id % 3 = 0 THEN 'retry' WHEN doc_id % 3 = 1 THEN 'pattern' ELSE 'placeholder' END AS tier, CASE WHEN doc_id % 4 <> 2 THEN CASE doc_id % 4 WHEN 0 THEN 'Doc ' || doc_id WHEN 1 THEN 'Note' ELSE 'P' END WHEN doc_id % 3 < 2 THEN 'again ' || doc_id END AS title FROM documents")
def llm_retry(i):
    k = F.col("doc_id") % 3
    said = F.concat(F.lit('{"title":"again '), F.col("doc_id").cast("string"), F.lit('"'))
    retries = i.documents.select("doc_id", F.when(k == 0, F.concat(said, F.lit("}"))).when(k == 1, said).otherwise("nothing").alias("raw"))
    return recognition.parsed(i.fx_llm_raw, retries).select("doc_id", "tier", F.col("answer.title").alias("title"))


@query("SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'Legal' WHEN 1 THEN 'Personal' ELSE 'Unknown' END AS category, CASE d.doc_id % 4 WHEN 0 THEN ';A;B;C;' WHEN 3 THEN ';X;Y;' ELSE '' END AS parties, CASE WHEN d.doc_id % 4 = 0 THEN 'amount=12.5;currency=USD' ELSE '' END AS extra, CASE WHEN d.doc_id % 4 = 0 THEN 12.5 END AS amount, CASE d.doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, d.doc_id % 4 <> 0 AS review FROM documents d")
def llm_to_doc(i):
    return recognition.to_document(recognition.parsed(i.fx_llm_raw)).withColumn("extra", F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")).select("doc_id", "category", "parties", "amount", "confidence", "review", "extra")


# --- search -----------------------------------------------------------------------------------------------------------

_FOLD = "replace(strip_accents(lower(coalesce({c}, ''))), 'ς', 'σ')"
_INDEX = "ix AS (SELECT doc_id, field, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT id AS doc_id, field, list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS field, {_FOLD.format(c=c)} AS t FROM fx_docs" for c in search.COLUMNS) + ")))"
_BM = "sz AS (SELECT doc_id, count(*) AS len FROM ix GROUP BY doc_id), fa AS (SELECT count(*) AS n, avg(coalesce(len, 0)) AS mean FROM fx_docs d LEFT JOIN sz ON sz.doc_id = d.id), te AS (SELECT term, doc_id, count(*) AS tf FROM ix WHERE term IN ({words}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM te GROUP BY term) SELECT te.doc_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM te JOIN hit USING (doc_id) JOIN df ON df.term = te.term JOIN sz ON sz.doc_id = te.doc_id CROSS JOIN fa GROUP BY te.doc_id ORDER BY score, doc_id LIMIT 50"


def _search_sql(hit: str, words: str) -> str:
    return f"WITH {_INDEX}, hit AS ({hit}), " + _BM.replace("{words}", words)


_HAS = "SELECT DISTINCT doc_id FROM ix WHERE term = '{t}'"


@query(_search_sql(_HAS.format(t="fr"), "'fr'"), "fx_docs")
def fts_term(i):
    return search.search(i.fx_docs, "fr")


@query(_search_sql(_HAS.format(t="de") + " INTERSECT " + _HAS.format(t="src3"), "'de', 'src3'"), "fx_docs")
def fts_and(i):
    return search.search(i.fx_docs, "de src3")


@query(_search_sql(f"{_HAS.format(t='src1')} UNION ({_HAS.format(t='src2')} EXCEPT {_HAS.format(t='fr')})", "'src1', 'src2'"), "fx_docs")
def fts_or_not(i):
    return search.search(i.fx_docs, "src1 OR src2 NOT fr")


@query(_search_sql("SELECT DISTINCT a.doc_id FROM ix a JOIN ix b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'party' AND b.term = '3'", "'party', '3'"), "fx_docs")
def fts_phrase(i):
    return search.search(i.fx_docs, '"party 3"')


@query(_search_sql(_HAS.format(t="de") + " AND field = 'tags'", "'de'"), "fx_docs")
def fts_column(i):
    return search.search(i.fx_docs, "tags:de")


@query(_search_sql(_HAS.format(t="la") + " UNION " + _HAS.format(t="the"), "'la', 'the'"), "fx_docs")
def fts_bm25_topk(i):
    return search.search(i.fx_docs, "la OR the")


_PREFIX = _BM.replace("te AS (SELECT term, doc_id, count(*) AS tf FROM ix WHERE term IN ({words}) GROUP BY ALL)", "te AS (SELECT 'src1' AS term, doc_id, count(*) AS tf FROM ix WHERE starts_with(term, 'src1') GROUP BY ALL)")


@query(f"WITH {_INDEX}, hit AS (SELECT DISTINCT doc_id FROM ix WHERE starts_with(term, 'src1')), {_PREFIX}", "fx_docs")
def fts_prefix(i):
    return search.search(i.fx_docs, "src1*")


@query(_search_sql("SELECT DISTINCT doc_id FROM ix WHERE term = 'de' AND field IN ('tags', 'title')", "'de'"), "fx_docs")
def fts_columns(i):
    return search.search(i.fx_docs, "{tags title} : de")


@query(_search_sql("SELECT DISTINCT doc_id FROM ix WHERE term = 'de' AND field <> 'tags'", "'de'"), "fx_docs")
def fts_other_columns(i):
    return search.search(i.fx_docs, "- {tags} : de")


_MARKED = "translate(notes, 'aeiouncszgdlrtyhwxkmpbf', 'ằệΐὃǘñćšžğďļŕťŷḧẘẍḱṃṕḃḟ')"


@query(f"WITH w AS (SELECT unnest(list_filter(regexp_split_to_array({_FOLD.format(c=_MARKED)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM fx_docs) SELECT term, count(*) AS n FROM w GROUP BY term", "fx_docs")
def fts_terms_folded(i):
    marked = F.translate("notes", "aeiouncszgdlrtyhwxkmpbf", "ằệΐὃǘñćšžğďļŕťŷḧẘẍḱṃṕḃḟ")
    return i.fx_docs.select(F.explode(search.tokens(marked)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(_search_sql(_HAS.format(t="mit") + " UNION " + _HAS.format(t="la"), "'mit', 'la'"), "fx_docs")
def fts_index_topk(i):
    index = search.Index(i.spark, scratch(i.spark, "index"))
    index.rebuild(i.fx_docs)
    return index.search("mit OR la")


_NOW = "cur AS (SELECT id, CASE WHEN id % 9 = 4 THEN 'again the party ' || id ELSE title END AS title, summary, CASE WHEN id % 9 = 4 THEN '' ELSE notes END AS notes, tags, parties FROM fx_docs WHERE id % 9 <> 5)"


@query(_search_sql(_HAS.format(t="party") + " INTERSECT " + _HAS.format(t="the"), "'party', 'the'").replace("WITH ", f"WITH {_NOW}, ").replace("FROM fx_docs)", "FROM cur)").replace("FROM fx_docs UNION", "FROM cur UNION").replace("FROM fx_docs d", "FROM cur d"), "fx_docs")
def fts_index_updates(i):
    """A search after documents were changed and removed in two updates."""
    docs, index = i.fx_docs, search.Index(i.spark, scratch(i.spark, "index"))
    index.rebuild(docs)
    changed = docs.filter("id % 9 = 4").withColumns({"title": F.concat(F.lit("again the party "), F.col("id").cast("string")), "notes": F.lit("")})
    index.update(changed.withColumn("title", F.lit("passing")))
    index.update(changed, docs.filter("id % 9 = 5").select(F.col("id").alias("doc_id")))
    return index.search("party the")
