"""Queries over facts in image and audio files, which are made here of the tables, and over directories' modes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import enrich
from docloom.plans.registry import query
from docloom.sources import extract


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _big(n: Column, width: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def _little(n: Column, width: int = 4) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(width)))))


def _raw(h: str) -> Column:
    return F.unhex(F.lit(h))


def _png(width: Column, height: Column, alpha: Column, title: Column, model: Column) -> Column:
    def chunk(name: str, body: Column) -> Column:
        return F.concat(_big(F.octet_length(body)), _bytes(F.lit(name)), body, _raw("00000000"))

    head = F.concat(_big(width), _big(height), _raw("08"), F.when(alpha, _raw("06")).otherwise(_raw("02")), _raw("000000"))
    field = F.concat(_raw("49492A0008000000" + "0100" + "10010200"), _little(F.octet_length(model) + 1), _raw("1A000000" + "00000000"), _bytes(model), _raw("00"))
    return F.concat(_raw("89504E470D0A1A0A"), chunk("IHDR", head), chunk("tEXt", F.concat(_bytes(F.lit("Title")), _raw("00"), _bytes(title))), chunk("eXIf", field))


def _wav(rate: Column, channels: Column, title: Column, sound: Column) -> Column:
    def chunk(name: str, body: Column) -> Column:
        return F.concat(_bytes(F.lit(name)), _little(F.octet_length(body)), body, F.when(F.octet_length(body) % 2 == 1, _raw("00")).otherwise(_raw("")))

    form = F.concat(_raw("0100"), _little(channels, 2), _little(rate), _little(rate * channels), _little(channels, 2), _raw("0800"))
    body = F.concat(_bytes(F.lit("WAVE")), chunk("fmt ", form), chunk("LIST", F.concat(_bytes(F.lit("INFO")), chunk("INAM", _bytes(title)))), chunk("data", sound))
    return F.concat(_bytes(F.lit("RIFF")), _little(F.octet_length(body)), body)


def _facts(files: DataFrame, names: dict[str, str]) -> DataFrame:
    got = extract.extracted(files)
    key = F.regexp_extract("path", r"^(\d+)\.", 1).cast("long").alias("doc_id")
    return got.select(key, *(F.element_at("metadata", k).alias(n) for k, n in names.items()))


@query("SELECT doc_id, n_chars || 'x' || (1 + doc_id % 100) AS dimensions, CASE WHEN doc_id % 3 = 0 THEN 'RGBA' ELSE 'RGB' END AS color_mode, source AS title, 'Model ' || source || lang AS model FROM documents")
def image_facts(i):
    made = _png(F.col("n_chars"), 1 + F.col("doc_id") % 100, F.col("doc_id") % 3 == 0, F.col("source"), F.concat(F.lit("Model "), "source", "lang"))
    files = i.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), made.alias("content"))
    return _facts(files, {"dimensions": "dimensions", "color_mode": "color_mode", "info_Title": "title", "exif_Model": "model"})


@query("SELECT doc_id, strlen(text) / (8000 * (1 + doc_id % 3) * (1 + doc_id % 2)) AS seconds, CAST(8000 * (1 + doc_id % 3) AS BIGINT) AS sample_rate, CAST(1 + doc_id % 2 AS BIGINT) AS channels, source || lang AS title FROM documents")
def audio_facts(i):
    made = _wav(8000 * (1 + F.col("doc_id") % 3), 1 + F.col("doc_id") % 2, F.concat("source", "lang"), _bytes(F.col("text")))
    files = i.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), made.alias("content"))
    got = _facts(files, {"audio_length": "seconds", "audio_sample_rate": "sample_rate", "audio_channels": "channels", "audio_INAM": "title"})
    return got.select("doc_id", F.col("seconds").cast("double").alias("seconds"), F.col("sample_rate").cast("long").alias("sample_rate"), F.col("channels").cast("long").alias("channels"), "title")


def _client(prompt: str) -> str:
    """Answers of every kind, by the number of files told."""
    n = json.loads(prompt[prompt.rindex("\n") + 1 :])["file_count"]
    if n % 4 == 3:
        raise TimeoutError
    return (' {"mode": "Collection", "rationale": " files alone "}', '```{"mode": "other", "downstream_hints": {"n": 1}}```', "cannot tell")[n % 4]


@query(
    "WITH own AS (SELECT regexp_replace(rel, '/[^/]*$', '') AS dir, count(*) AS n FROM fx_fs GROUP BY 1), up AS (SELECT DISTINCT array_to_string(list_slice(p, 1, k), '/') AS dir FROM (SELECT string_split(dir, '/') AS p, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM own)), c AS (SELECT up.dir, coalesce(n, 0) % 4 AS k FROM up LEFT JOIN own USING (dir)) "
    """SELECT 'dir:' || dir AS subject, 'dir_mode' AS kind, CASE k WHEN 0 THEN '{"mode":"collection","downstream_hints":{}}' WHEN 1 THEN '{"mode":"unknown","downstream_hints":{"n":1}}' ELSE '{"mode":"unknown","downstream_hints":{}}' END AS value, CASE WHEN k < 2 THEN 'llm' ELSE 'fallback' END AS source, CASE k WHEN 0 THEN 'files alone' WHEN 1 THEN 'no rationale' ELSE 'no answer that can be read' END AS rationale FROM c""",
    "fx_fs",
)
def dirs_classified(i):
    return enrich.classified(i.fx_fs, lambda: _client)
