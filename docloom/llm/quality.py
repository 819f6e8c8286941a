"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Both sides are multinomials over hashed one- and two-token grams. The raw side counts every document; the target side
counts trusted labelled ones. Every label is taken: half of them (by xxhash64 of doc_id) fit the target and the other half,
held out, set the threshold: half way from the lowest held-out trusted scores (quantile `tail`) to the median of the held-out
rejected ones, which leaves a margin for clean documents. A bitmap of fixed size tells on the map side which documents may
have a label; joins then decide, so only texts that may be trusted and the scores of held-out documents are shuffled. A
document's score is its mean log ratio; documents at or over the threshold pass.

Defined results: null or empty text has no words, zero counts and base_failed; repeated rows are scored each; a
document without grams scores 0; without trusted labels every ratio is 0 and the base rule alone decides; an empty
table gives no rows; further columns of the input, of whatever name, stay out of the work and come back untouched
through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import WHITE, Hasher, Texts, grams, per_doc_sum, pieces
from docloom.llm._spark import written
from docloom.llm.neardup import _bitmap

BUCKETS = 1 << 16
#: Bits of the filter of labelled documents: 8 MB. More labels let more others through it, never fewer of their own.
FILTER_BITS = 1 << 26
#: Scores of one bin that may be sorted on the driver, and bins of a round.
FEW, BINS = 10_000, 4096
#: Share of trusted documents that may score under the threshold.
TAIL = 0.005

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CLASS = np.zeros(256, np.uint8)  # 0 white space, 1 word byte, 2 punctuation
_CLASS[[c for c in range(256) if not WHITE[c]]] = 2
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def token_buckets(t: Texts, hasher: Hasher, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every one- and two-token gram; tokens are runs of word bytes or of punctuation."""
    kind = _CLASS[t.data]
    s1, e1 = t.runs(kind == 1)
    s2, e2 = t.runs(kind == 2)
    starts, ends = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    docs = t.doc_of(starts)
    one = hasher(starts, ends)
    two, at = grams(one, docs, 2)
    mask = np.uint64(buckets - 1)
    return np.concatenate([one & mask, two & mask]).astype(np.int64), np.concatenate([docs, docs[at]])


def rules(t: Texts, hasher: Hasher) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    n = t.n
    starts, ends = t.words()
    docs = t.doc_of(starts)
    white = WHITE[t.data]
    # lines that have a word: those that some word starts in
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.sort(np.concatenate([t.starts[t.full], breaks + 1]))
    edge = np.union1d(np.concatenate([breaks, t.ends[t.full]]), np.zeros(0, np.int64))
    lines = np.unique(np.searchsorted(line_start, starts, "right") - 1)
    begin = line_start[lines]
    end = edge[np.searchsorted(edge, begin, "right")]
    owner = t.doc_of(begin)
    by_line = hasher(begin, end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    fresh = np.unique(by_line, return_index=True)[1]
    # words within windows of three found twice or more in their document
    three, at = grams(hasher(starts, ends), docs, 3)
    keys = three + docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(starts) + 2, bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": np.bincount(docs, minlength=n),
        "word_chars": t.count(~white & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.count(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(owner, minlength=n) - np.bincount(owner[fresh], minlength=n),
        "n_repeat_words": np.bincount(docs[covered[: len(starts)]], minlength=n),
    }


def _count_buckets(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for _, t in pieces(batches, "text"):
            count += np.bincount(token_buckets(t, Hasher(t.data), buckets)[0], minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    return run


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good and held_out of every labelled document. Toxic ones of quality 1 are neither good nor bad."""
    good, bad = F.max((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)), F.max(F.col("quality") == 0)
    each = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(good.alias("good"), bad.alias("bad")).filter("good <> bad")
    return each.select("doc_id", "good", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 1).alias("held_out"))


def _filter(ids: DataFrame):
    """The broadcast filter of these ids, for `_picked`."""
    return ids.sparkSession.sparkContext.broadcast(_bitmap(ids.select(F.col("doc_id").cast("long").alias("node")), FILTER_BITS))


def _place(doc_id: str) -> Column:
    """Where the filter has a document's bit; null without doc_id."""
    return F.when(F.col(doc_id).isNotNull(), F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(FILTER_BITS))).alias("__place")


def _picked(batches: Iterable[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    """Rows whose bit the filter has, without their last column, the place of that bit."""
    for batch in batches:
        at = pc.fill_null(batch.column(batch.num_columns - 1), -1).to_numpy(zero_copy_only=False)
        there = (at >= 0) & ((shipped.value[at // 64] >> (at % 64)) & 1).astype(bool)
        yield batch.select(range(batch.num_columns - 1)).filter(pa.array(there))


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket. The counts of all documents reach the driver as `buckets` sums, whatever the input."""
    ids = labelled(labels).filter("good and not held_out").select("doc_id")

    def counted(rows: DataFrame) -> np.ndarray:
        sums = rows.select("text").mapInArrow(_count_buckets(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(buckets)
        out[sums["bucket"]] = sums["n"]
        return out

    shipped, some = _filter(ids), docs.select("doc_id", "text", _place("doc_id"))
    some = some.mapInArrow(lambda batches: _picked(batches, shipped), some.select("doc_id", "text").schema)
    good = counted(some.join(ids.hint("merge"), "doc_id", "left_semi"))  # broadcast, it would leave two Python workers to a task
    if not good.sum():
        return np.zeros(buckets)
    raw = counted(docs)
    share = (raw + 1) / (raw.sum() + buckets)
    return np.log((good + buckets * share) / (good.sum() + buckets) / share)


def _scores(ratio, buckets: int, keep: list[str], only=None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for part, t in pieces(batches if only is None else _picked(batches, only), "__text"):
            hasher = Hasher(t.data)
            out = rules(t, hasher)
            at, docs = token_buckets(t, hasher, buckets)
            total, n = per_doc_sum(table[at], docs, t.n), np.bincount(docs, minlength=t.n)
            out["score"] = total / np.maximum(n, 1)
            arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v) for v in out.values())], [*keep, *out])

    return run


def score(docs: DataFrame, ratio: np.ndarray, keep: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
    """The `keep` columns of docs (default doc_id) with the base counts and the score, one row per row of docs; with `among`,
    of all rows whose doc_id it has and few others, picked by the same Python worker."""
    keep = keep or ["doc_id"]
    held = [f"__k{i}" for i in range(len(keep))]
    shipped = docs.sparkSession.sparkContext.broadcast(ratio)  # len(ratio) doubles, a parameter
    read = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)), F.col("text").alias("__text"), *([_place("doc_id")] if among is not None else []))
    kinds = ", ".join(f"{h} {read.schema[h].dataType.simpleString()}" for h in held)
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    only = None if among is None else _filter(among)
    out = read.mapInArrow(_scores(shipped, len(ratio), held, only), f"{kinds}, {counts}")
    return out.select(*(F.col(h).alias(c) for c, h in zip(keep, held)), *(c.split()[0] for c in counts.split(", ")))


def _ranked(scores: DataFrame, rank: int) -> float:
    """The score of this rank (from 0) in ascending order. Bins of equal width are counted and the one that has the rank is
    parted again, until its scores are few or all the same."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while True:
        inside = scores.filter(F.col("score").between(low, high))
        n, at = inside.count(), rank - scores.filter(F.col("score") < low).count()
        if n <= FEW or low == high:
            return low if low == high else inside.select("score").toPandas()["score"].sort_values().iloc[at].item()
        place = F.least(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bin").collect():  # at most BINS
            if at < r["n"]:
                low, high = r["low"], r["high"]
                break
            at -= r["n"]


def _quantile(scores: DataFrame, n: int, q: float) -> float:
    """The quantile of n scores, linear between neighbours as numpy's."""
    at = q * (n - 1)
    below = _ranked(scores, int(at))
    return below if at == int(at) else below + (_ranked(scores, int(at) + 1) - below) * (at - int(at))


def threshold(docs: DataFrame, labels: DataFrame, ratio: np.ndarray, *, tail: float = TAIL) -> float:
    """The lowest score that passes. Held-out documents are scored before they are joined with their labels, so that no text
    is shuffled; a document that stands several times counts once, with the least of its scores."""
    ids = labelled(labels).filter("held_out").select("doc_id", "good")
    scored = score(docs, ratio, among=ids).filter("n_words >= 50").groupBy("doc_id").agg(F.min("score").alias("score"))
    held = written(scored.join(ids, "doc_id").select("good", "score"), "held")
    sizes = {r["good"]: r["n"] for r in held.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if True not in sizes:
        return float("-inf")
    low = _quantile(held.filter("good"), sizes[True], tail)
    return min(low, (low + _quantile(held.filter("not good"), sizes[False], 0.5)) / 2) if False in sizes else low


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **sizes) -> DataFrame:
    """score() of every document with base_failed, and kept: base passed and score at or over the threshold."""
    ratio = fit(docs, labels, **sizes)
    limit = threshold(docs, labels, ratio)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return score(docs, ratio, keep).withColumns({"base_failed": failed, "kept": ~failed & (F.col("score") >= F.lit(limit))})
