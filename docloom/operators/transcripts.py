"""Speech segments, subtitles and media policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

IMAGE_SUBTITLES = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub")
#: Two- and three-letter codes of one language.
CODES = {"en": "eng", "he": "heb", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "ru": "rus", "ar": "ara"}


def spoken(segments: DataFrame) -> DataFrame:
    return segments.filter(T.strip(F.col("text")) != "")


def speakers(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each document in order of first appearance."""
    firsts = segments.filter("speaker is not null and speaker <> ''").groupBy("doc_id", "speaker").agg(F.min("turn").alias("at"))
    return firsts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "speaker"))), lambda x: x["speaker"]), ",").alias("speakers"), F.count("*").cast("long").alias("n_speakers"))


def runs(segments: DataFrame) -> DataFrame:
    """Neighbouring segments of one speaker as one, `[speaker]` before its text, where a document has two speakers or more."""
    many = speakers(segments).filter("n_speakers >= 2").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy("turn")
    rows = spoken(segments).join(many, "doc_id", "left_semi").withColumn("new", F.when(F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), 0).otherwise(1))
    numbered = rows.withColumn("run", F.sum("new").over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", T.strip(F.col("text")).alias("text")))), lambda x: x["text"])
    return numbered.groupBy("doc_id", "run").agg(F.first("speaker").alias("speaker"), F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), labelled(F.first("speaker"), F.array_join(texts, " ")).alias("text"))


def labelled(speaker: Column, text: Column) -> Column:
    """`[speaker] text`, the text alone where no speaker is named."""
    return F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(F.lit("["), speaker, F.lit("] "), text)).otherwise(text)


def full_texts(segments: DataFrame) -> DataFrame:
    """doc_id and the transcript as a model reads it: a line for each run of a speaker where there are two or more, else
    all texts in one line."""
    plain = F.transform(F.array_sort(F.collect_list(F.struct("turn", T.strip(F.col("text")).alias("text")))), lambda x: x["text"])
    alone = spoken(segments).groupBy("doc_id").agg(F.array_join(plain, " ").alias("plain"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"])
    many = runs(segments).groupBy("doc_id").agg(F.array_join(told, "\n").alias("told"))
    return alone.join(many, "doc_id", "left").select("doc_id", F.coalesce("told", "plain").alias("text"))


def cues(segments: DataFrame) -> DataFrame:
    """Numbered subtitle cues with their time lines, speakers named, lines of right-to-left script marked; empty ones
    skipped."""
    order = Window.partitionBy("doc_id").orderBy("seg_start", "turn")
    span = F.concat(T.srt_time(F.col("seg_start")), F.lit(" --> "), T.srt_time(F.col("seg_end")))
    return spoken(segments).select("doc_id", F.row_number().over(order).cast("long").alias("cue"), span.alias("times"), F.array_join(F.transform(F.split(labelled(F.col("speaker"), T.strip(F.col("text"))), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), bidi), "\n").alias("text"))


def merged_channels(segments: DataFrame) -> DataFrame:
    """Segments of all channels by start, end and channel, with their place."""
    order = Window.partitionBy("doc_id").orderBy("seg_start", "seg_end", "speaker", "turn")
    return segments.select("doc_id", "turn", "speaker", F.row_number().over(order).cast("long").alias("place"), F.max("seg_end").over(Window.partitionBy("doc_id")).alias("duration"))


def chosen_subtitle(streams: DataFrame, languages: tuple[str, ...] = ("he", "en")) -> DataFrame:
    """One text stream of each file: of a wanted or no stated language if there is one, not forced nor for the hard of hearing if
    there is one, then most frames, then the lowest index."""
    wanted = [x for c in languages for x in (c, CODES.get(c, c))]
    texts = streams.filter((F.col("codec_type") == "subtitle") & ~F.col("codec_name").isin(*IMAGE_SUBTITLES))
    best = Window.partitionBy("file_id").orderBy(F.desc(F.coalesce(F.lower("language"), F.lit("")).isin("", *wanted)), F.desc(~F.col("forced") & ~F.col("hearing_impaired")), F.desc("frames"), "idx")
    return texts.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("file_id", "idx", "language", "frames")


def opus_preset(rate: Column, channels: Column) -> Column:
    """Application and bit rate: speech under 16 kHz, else audio; an unknown rate (0 or null) is not narrow."""
    narrow, stereo = (F.coalesce(rate, F.lit(0)) > 0) & (F.coalesce(rate, F.lit(0)) < 16000), F.coalesce(channels, F.lit(1)) >= 2
    return F.when(narrow & stereo, "voip:48k").when(narrow, "voip:24k").when(stereo, "audio:96k").otherwise("audio:64k")


#: Tag names of music.
MUSIC_TAGS = ("genre", "tcon", "artist", "tpe1", "tpe2", "album", "talb", "tracknumber", "trck")


def recording_type(tags: Column, path: Column, channels: Column, voice_ratio: Column, patterns: list[tuple[str, str]]) -> Column:
    """Music by its tags, else the first path pattern that fits, else a call by its channels, else no speech, else
    unknown; committed says whether the rule decides alone."""
    of = lambda kind, source, sure: F.struct(F.lit(kind).alias("type"), F.lit(source).alias("source"), F.lit(sure).alias("committed"))
    names = F.transform(F.map_keys(tags), lambda k: F.regexp_replace(F.lower(k), "^audio_", ""))
    music = F.arrays_overlap(names, F.array(*(F.lit(t) for t in MUSIC_TAGS)))
    by_path = [F.when(path.rlike(pattern), of(kind, "path_pattern", False)) for pattern, kind in patterns]
    return F.coalesce(F.when(music, of("music", "mutagen", True)), *by_path, F.when(channels >= 2, of("phone_call", "channel", True)), F.when(voice_ratio < 0.2, of("non_speech", "vad", True)), of("unknown", "default", False))


#: Right-to-left letters, and the longest runs of Latin text within such a line.
RIGHT_TO_LEFT = "[\u0590-\u05ff\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb1d-\ufdff\ufe70-\ufeff]"
LATIN_RUN = r"""([A-Za-z](?:[A-Za-z0-9_ .,;:!?'"()\[\]\-+/]*[A-Za-z0-9_])?)"""


def bidi(line: Column) -> Column:
    """A line with right-to-left letters embedded as such, its Latin runs as left-to-right."""
    inner = F.regexp_replace(line, LATIN_RUN, "\u202a$1\u202c")
    return F.when(line.rlike(RIGHT_TO_LEFT), F.concat(F.lit("\u202b"), inner, F.lit("\u202c"))).otherwise(line)
