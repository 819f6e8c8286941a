"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

Templates are a table (template, label, words). A block is a window over the words of the whole text, whatever line breaks
they have: for a template of L words, windows of 2 L words begin every L / 2 words, so that any run of 1.5 L words lies
whole in one. A block's words and a template's words are sets; a template is found where the block holds at least
`share` of its words. Words are ordered by how many documents hold them, rarest first. A block that reaches the
threshold t = ceil(share * size) shares a word with the template's first size - t + 1 words, so these alone are
exploded into an index, and the words of the documents are joined with it by equality (prefix filter). Of what meets,
blocks of under t words go (length filter), each block is told once, by the first word of the prefix that it has, and goes
if the words that the template has from there on are under t (positional filter). What passes is verified by the
whole intersection, so every block over the threshold is found.

Documents are scanned where they lie; the index is broadcast if the templates have `INDEXED` prefix words at most, else
joined by a shuffle of words. Texts are never shuffled: only blocks' verdicts are, by 128 bits of the text's hash, so
copies share them.

Defined results: a null or empty text has no words, no labels, null positions and score 0; repeated rows are scanned
each; an empty table gives no rows; very long texts are cut into blocks like others; other input columns, whatever their
names, are ignored but those in `keep`; a template without words is never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._spark import written

SHARE = 0.9
#: Fixed phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed templates: sentences of public license notices, in words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prefix words up to which the index is broadcast.
INDEXED = 200_000


def _plain(text: Column) -> Column:
    """Words joined by single blanks; A-Z alone are lower-cased."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BREAK, " "))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label and words of a list of (label, sentence)."""
    rows = [F.struct(F.lit(k).cast("long").alias("template"), F.lit(label).alias("label"), F.split(F.lit(sentence.strip()), r"\s+").alias("words")) for k, (label, sentence) in enumerate(templates) if sentence.split()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def prefix_index(docs: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """A row for each prefix word of each template: word, template, label, place (in the global order), prefix, ordered (the
    template's distinct words in that order), length, size and least."""
    distinct = templates.select("template", "label", F.size("words").alias("length"), F.array_distinct("words").alias("words"))
    vocabulary = distinct.select(F.explode("words").alias("word")).distinct()
    said = docs.select(F.explode(F.array_distinct(F.split(_plain(F.coalesce("text", F.lit(""))), " "))).alias("word"))
    known = said.join(F.broadcast(vocabulary), "word") if vocabulary.count() <= INDEXED else said.join(vocabulary, "word")
    often = known.groupBy("word").agg(F.count("*").alias("n"))
    ranked = distinct.select("template", F.explode("words").alias("word")).join(often, "word", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
    ordered = ranked.groupBy("template").agg(F.transform(order, lambda x: x["word"]).alias("ordered"))
    sized = ordered.join(distinct.select("template", "label", "length"), "template").withColumn("size", F.size("ordered"))
    sized = sized.withColumn("least", F.ceil(F.col("size") * share - 1e-9).cast("int"))
    sized = sized.withColumn("prefix", F.slice("ordered", F.lit(1), F.col("size") - F.col("least") + 1))
    return sized.select("*", F.posexplode("prefix").alias("place", "word"))


def blocks_found(docs: DataFrame, index: DataFrame) -> DataFrame:
    """one, two (the text's hash), label and share of every block of docs (one, two, plain) that reaches its template."""
    each = docs.select("one", "two", F.split("plain", " ").alias("own")).select("one", "two", "own", F.posexplode("own").alias("at", "word"))
    small = index.count() <= INDEXED
    met = each.join(F.broadcast(index) if small else index, "word")
    stride = F.greatest(F.lit(1), F.call_function("div", F.col("length"), F.lit(2)).cast("int"))
    # windows k * stride .. k * stride + 2 length - 1 that hold the word
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - 2 * F.col("length") + 1) / stride).cast("int"))
    window = met.withColumn("stride", stride).withColumn("k", F.explode(F.sequence(first, F.floor(F.col("at") / stride).cast("int"))))
    block = F.slice("own", F.col("k") * F.col("stride") + 1, 2 * F.col("length"))
    held = window.select("one", "two", "template", "label", "word", "place", "prefix", "ordered", "size", "least", "k", F.array_distinct(block).alias("block"))
    # length filter; then the first word of the prefix that the block has tells the block, and what the template has from there
    lead = F.array_position("prefix", F.get(F.array_intersect("prefix", "block"), F.lit(0))) - 1
    some = held.filter(F.size("block") >= F.col("least")).filter((lead == F.col("place")) & (F.col("size") - F.col("place") >= F.col("least")))
    shared = F.size(F.array_intersect("ordered", "block"))
    return some.withColumn("shared", shared).filter(F.col("shared") >= F.col("least")).select("one", "two", "label", (F.col("shared") / F.col("size")).alias("share"))


def licenses(docs: DataFrame, keep: list[str] | None = None, *, templates: DataFrame | None = None, phrases=PHRASES, share: float = SHARE) -> DataFrame:
    """The `keep` columns (default doc_id) with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    keep = keep or ["doc_id"]
    templates = template_table(docs.sparkSession) if templates is None else templates
    held = [f"__k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)), F.xxhash64(F.lit(1), text).alias("one"), F.xxhash64(F.lit(2), text).alias("two"), _plain(text).alias("plain"))
    index = written(prefix_index(docs, templates, share), "license-index")  # a few words for each template, read twice
    found = blocks_found(read.select("one", "two", "plain"), index)
    verdicts = found.groupBy("one", "two").agg(F.array_sort(F.collect_set("label")).alias("own"), F.max("share").alias("score"))

    padded = read.withColumn("__line", F.concat(F.lit(" "), "plain", F.lit(" ")))
    line = F.col("__line")
    blanks = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        spaced = F.lit(f" {phrase} ")
        has = F.contains(line, spaced)
        counts.append(F.when(has, F.regexp_count(line, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(has, blanks(F.substring_index(line, f" {phrase} ", 1))))
        after = F.substring_index(line, f" {phrase} ", -1)
        # words after the last place, as every word but the first of a padded line has a blank before it
        lasts.append(F.when(has, blanks(line) - 1 - blanks(after) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    base = padded.select(
        *held, "one", "two",
        F.when(F.col("plain") == "", 0).otherwise(blanks(line) - 1).cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )
    joined = base.join(verdicts, ["one", "two"], "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    return joined.select(
        *(F.col(h).alias(c) for c, h in zip(keep, held)), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
