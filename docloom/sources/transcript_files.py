"""Transcripts as JSON twins and subtitle sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.transcripts import cues

_TWIN = "struct<segments:array<struct<seg_start:double,seg_end:double,speaker:string,text:string>>>"


def twins(segments: DataFrame) -> DataFrame:
    """doc_id and the transcript as JSON, segments in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seg_start", "turn", "seg_end", "speaker", "text"))), lambda s: F.struct(s["seg_start"].alias("seg_start"), s["seg_end"].alias("seg_end"), s["speaker"].alias("speaker"), s["text"].alias("text")))
    return segments.groupBy("doc_id").agg(F.to_json(F.struct(rows.alias("segments"))).alias("json"))


def from_twins(frame: DataFrame) -> DataFrame:
    """Segments of JSON twins; malformed ones give none."""
    read = frame.select("doc_id", F.from_json("json", _TWIN).alias("t")).filter("t.segments is not null")
    return read.select("doc_id", F.posexplode("t.segments").alias("turn", "s")).select("doc_id", "turn", "s.seg_start", "s.seg_end", "s.speaker", "s.text")


def subtitles(segments: DataFrame, mark: bool = False) -> DataFrame:
    """doc_id and the subtitle file's text, with a byte order mark if asked for."""
    block = F.concat(F.col("cue").cast("string"), F.lit("\n"), "times", F.lit("\n"), "text", F.lit("\n"))
    rows = cues(segments).select("doc_id", "cue", block.alias("block"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "block"))), lambda x: x["block"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("﻿" if mark else ""), body).alias("srt"))


def sidecar(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".srt"))


def edited_by_hand(srt_time: Column, twin_time: Column) -> Column:
    """A subtitle more than a second newer than its twin is not overwritten."""
    return F.coalesce(F.unix_micros(srt_time) > F.unix_micros(twin_time) + 1_000_000, F.lit(False))


def markup_free(c: Column) -> Column:
    return T.srt_words(c)
