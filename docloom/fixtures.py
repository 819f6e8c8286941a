"""Input views of the queries, as SQL that Spark and DuckDB both read.

`$sha(` stands for the SHA-256 hex function, `$bytes(` for the byte length, and `$seq(n)` for rows 0 to n, which the two
spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("benchmark", "conversations", "documents", "events", "labels", "pages", "supplier")

VIEWS: dict[str, str] = {
    "fx_docs": r"""
SELECT id, top || name AS path, hash, size, modified, digested, name AS original, category, parties, langs, tags,
       date, title, confidence, dup, summary, notes, extra
FROM (
  SELECT doc_id AS id,
    CASE doc_id % 4 WHEN 0 THEN 'Inbox/' WHEN 1 THEN 'Inbox/' || source || '/nested/'
                    WHEN 2 THEN 'Financial/' || source || '/' ELSE 'Legal/' || lang || '/' END AS top,
    'doc_' || lpad(CAST(doc_id AS STRING), 6, '0') || CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt'
       WHEN 2 THEN '.html' WHEN 3 THEN '.png' WHEN 4 THEN '.mp3' WHEN 5 THEN '.mkv' ELSE '.xyz' END AS name,
    'sha256:' || $sha(text) AS hash, CAST($bytes(text) AS BIGINT) AS size,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T00:00:00Z' END AS modified,
    CASE WHEN doc_id % 23 = 0 THEN NULL ELSE '2024-02-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T00:00:00.500000Z' END AS digested,
    CASE WHEN doc_id % 10 = 0 THEN 'Unknown' WHEN doc_id % 3 = 0 THEN 'Financial/' || lang ELSE 'Legal' END AS category,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE ';Party ' || CAST(doc_id % 9 AS STRING) || ';' END AS parties,
    ';' || lang || ';' AS langs,
    CASE WHEN doc_id % 8 = 0 THEN '' ELSE ';' || lang || ';' || source || ';' END AS tags,
    CASE WHEN doc_id % 4 = 3 THEN NULL ELSE '2023-0' || CAST(1 + doc_id % 9 AS STRING) || '-15' END AS date,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE substr(replace(text, chr(10), ' '), 1, 40) END AS title,
    CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'confirmed' END AS confidence,
    CASE WHEN doc_id % 17 = 0 THEN 'keep' ELSE 'unique' END AS dup,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr(text, 1, 200) END AS summary, coalesce(text, '') AS notes,
    CASE WHEN doc_id % 12 = 0 THEN 'not json' WHEN doc_id % 12 = 1 THEN '[1]'
         ELSE '{"amount": ' || CAST(doc_id % 100 AS STRING) || '}' END AS extra
  FROM documents) t
""",
    "fx_ocr": r"""
SELECT doc_id, CASE WHEN quality = 0 THEN 'ocr_full' WHEN toxic = 1 THEN 'ocr_pages' ELSE 'no_ocr' END AS decision,
  CASE WHEN quality = 1 AND toxic = 0 THEN NULL ELSE '2024-02-01T00:00:00Z' END AS done,
  CASE WHEN quality = 1 AND toxic = 0 THEN NULL ELSE 'tesseract' END AS engine,
  CASE WHEN quality = 1 AND toxic = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'tesseract 4.1' ELSE 'tesseract 5.5.0' END AS engine_ver,
  CASE WHEN quality = 1 AND toxic = 0 THEN '' WHEN doc_id % 3 = 0 THEN ';eng;' ELSE ';eng;heb;' END AS langs
FROM labels
""",
    "fx_asr": r"""
SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN 'asr_subtitle' ELSE 'asr_full' END AS decision,
  '2024-02-01T00:00:00Z' AS done, CASE WHEN doc_id % 7 = 5 THEN 'subtitle' ELSE 'faster-whisper' END AS engine,
  CASE WHEN doc_id % 2 = 0 THEN 'engine 1.0 model=a' ELSE 'engine 1.1 model=b' END AS engine_ver,
  ';en;he;' AS langs, CAST(n_chars AS DOUBLE) / 15 AS audio_seconds, CAST(1 + doc_id % 2 AS BIGINT) AS channels,
  'unknown' AS recording_type
FROM documents d WHERE doc_id % 7 IN (4, 5) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)
""",
    "fx_triage": r"""
SELECT doc_id, '2024-03-' || lpad(CAST(1 + (doc_id * 7) % 28 AS STRING), 2, '0') || 'T00:00:00Z' AS enqueued_at,
  CASE WHEN quality = 0 THEN 'digested' ELSE 'rebuild' END AS reason
FROM labels
""",
    "fx_dirs": r"""
SELECT DISTINCT 'Inbox/' || source AS path, 'collection' AS mode, 'heuristic' AS source FROM documents
UNION ALL SELECT DISTINCT 'Financial/' || source, 'collection',
  CASE WHEN source LIKE '%0' OR source LIKE '%5' THEN 'user' ELSE 'heuristic' END FROM documents
UNION ALL SELECT DISTINCT 'Legal/' || lang, CASE WHEN lang = 'de' THEN 'opaque' ELSE 'bundle' END, 'user' FROM documents
UNION ALL SELECT 'Legal', 'collection', 'heuristic'
""",
    "fx_fs": r"""
SELECT CASE WHEN d.id % 13 = 0 THEN 'Archive/' || d.original ELSE d.path END AS rel,
  CASE WHEN d.id % 19 = 0 THEN d.size + 1 WHEN d.id % 26 = 0 THEN d.size + 7 ELSE d.size END AS size,
  CASE WHEN d.id % 5 = 0 THEN '2024-05-01T12:00:00Z' ELSE d.modified END AS mtime,
  CASE WHEN d.id % 19 = 0 THEN 'sha256:' || $sha(s.text || '!') ELSE d.hash END AS hash
FROM (SELECT * FROM fx_docs) d JOIN documents s ON s.doc_id = d.id WHERE d.id % 11 <> 0
UNION ALL SELECT 'Inbox/new_' || CAST(item_id AS STRING) || '.txt', CAST($bytes(text) AS BIGINT),
  '2024-06-01T00:00:00Z', 'sha256:' || $sha(text) FROM benchmark
""",
    "fx_events": r"""
SELECT event_id + 1 AS id, CASE event_type WHEN 'click' THEN 'digest_started' WHEN 'purchase' THEN 'digest_finished'
  WHEN 'view' THEN 'scan_started' WHEN 'signup' THEN 'scan_finished' ELSE 'error' END AS kind, ts,
  '{"file": "f' || CAST(user_id AS STRING) || '.pdf", "ready_count": ' || CAST(event_id % 3 AS STRING)
  || ', "failed": ' || CAST(event_id % 2 AS STRING) || '}' AS payload FROM events
""",
    "fx_proposals": r"""
SELECT event_id + 1 AS id, 'doc:' || CAST(user_id AS STRING) AS subject,
  CASE event_type WHEN 'click' THEN 'recording_type' WHEN 'view' THEN 'speaker_name' ELSE 'dir_mode' END AS kind,
  props AS value, CASE WHEN event_id % 7 = 0 THEN 'rejected' WHEN event_id % 11 = 0 THEN 'accepted' ELSE 'pending' END AS status
FROM events
""",
    "fx_segments": r"""
SELECT conv_id AS doc_id, turn, CAST(turn AS DOUBLE) * 5 + CAST(conv_id % 3 AS DOUBLE) / 4 AS seg_start,
  CAST(turn AS DOUBLE) * 5 + 4.5 AS seg_end,
  CASE WHEN conv_id % 10 = 0 OR turn % 4 IN (0, 1) THEN 'CHANNEL_0' ELSE 'CHANNEL_1' END AS speaker,
  CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS text FROM conversations
""",
    "fx_pages": r"""
SELECT doc_id, CAST(p AS BIGINT) AS page, substr(text, CAST(begun AS INT) + 1, CASE WHEN inside < short THEN 20 ELSE 400 END) AS page_text
FROM (SELECT doc_id, text, p, inside, short,
    (p - inside) / 5 * (short * 20 + (5 - short) * 400) + least(inside, short) * 20 + greatest(inside - short, 0) * 400 AS begun
  FROM (SELECT doc_id, text, short, p, p % 5 AS inside
    FROM (SELECT doc_id, text, short, $seq(last) AS p
      FROM (SELECT doc_id, text, short, CAST(floor(length(text) / (short * 20 + (5 - short) * 400)) AS INT) * 5 + 4 AS last
        FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS short FROM documents) a) b) c) d) e
WHERE begun < length(text)
""",
    "fx_llm_raw": r"""
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN '{"title":"Doc ' || CAST(doc_id AS STRING) || '","summary":"From ' || source || '.","tags":["a","' || lang
       || '"],"category":"Legal","subcategory":null,"correspondent":"A, B & C","date":"2024-01-02","amount":12.5,"currency":"USD","language":"' || lang
       || '","confidence":"High","review":false,"reason":null}'
  WHEN 1 THEN '{"title":"Note","summary":"said "hi" to ' || source || '.","tags":["x"],"category":"Personal","date":null,"language":"' || lang || '","confidence":"medium","review":true}'
  WHEN 2 THEN 'garbage {not json ' || source
  ELSE '{"title":"P","summary":"","tags":[],"category":"","correspondent":["X","Y"],"language":"unknown","confidence":"bogus"}' END AS raw
FROM documents
""",
    "fx_streams": r"""
SELECT s_suppkey AS file_id, CAST(i AS BIGINT) AS idx, CASE WHEN i = 0 THEN 'audio' ELSE 'subtitle' END AS codec_type,
  CASE WHEN (s_suppkey + i) % 4 = 0 THEN 'hdmv_pgs_subtitle' ELSE 'subrip' END AS codec_name,
  CASE (s_suppkey + i) % 5 WHEN 0 THEN 'heb' WHEN 1 THEN 'eng' WHEN 2 THEN 'fra' WHEN 3 THEN '' ELSE 'he' END AS language,
  (s_suppkey + i) % 3 = 0 AS forced, (s_suppkey + i) % 7 = 0 AS hearing_impaired, s_suppkey * 31 % 97 + i AS frames
FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i)
""",
    "fx_raw_paths": r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || replace(url, '/', chr(92)) || ' ' WHEN 1 THEN 'C:' || chr(92) || 'Docs' || chr(92) || CAST(page_id AS STRING) || '//'
  WHEN 2 THEN '.' ELSE url || '///' END AS raw FROM pages
""",
}


def _ordered(names: list[str]) -> list[str]:
    """The views named and those they read, each after what it reads."""
    out: list[str] = []

    def add(name: str) -> None:
        for inner in re.findall(r"fx_\w+", VIEWS[name]):
            add(inner)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def spark_sql(name: str) -> str:
    return re.sub(r"\$sha\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", VIEWS[name]).replace("$bytes(", "octet_length(").replace("$seq(last)", "explode(sequence(0, last))")


def duckdb_ctes(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for an oracle query."""
    text = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _ordered(list(names)))
    return "WITH " + text.replace("$sha(", "sha256(").replace("$bytes(", "strlen(").replace("$seq(last)", "unnest(range(0, last + 1))") + " "


class Inputs:
    """The raw tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if not name.startswith("fx_"):
            return self.raw(name)
        text = spark_sql(name)
        parts = {n: self.raw(n) for n in RAW if re.search(rf"\b{n}\b", text)}
        parts |= {n: getattr(self, n) for n in set(re.findall(r"fx_\w+", text))}
        text = text.replace("{", "{{").replace("}", "}}")
        for n in parts:
            text = re.sub(rf"(?<=FROM )\(?\b{n}\b|(?<=JOIN )\b{n}\b", lambda m: m[0].replace(n, "{" + n + "}"), text)
        return self.spark.sql(text, **parts)
