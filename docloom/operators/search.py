"""Full-text search: postings, boolean and phrase queries, BM25, and a stored index of immutable segments."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import stored
from docloom.store import Conflict, Log

COLUMNS = ("title", "summary", "notes", "tags", "parties")
K1, B = 1.2, 0.75


def _folding() -> tuple[str, str]:
    """Characters that are one character with marks and that character, then all marks, which go. From Unicode's canonical
    decompositions; the final sigma is the other one."""
    marked, plain, marks = ["\u03c2"], ["\u03c3"], []
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) in ("Mn", "Mc", "Me"):
            marks.append(c)
        elif unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) not in ("Mn", "Mc", "Me")))
            if len(bare) == 1 and bare != c:
                marked.append(c)
                plain.append(bare)
    return "".join(marked + marks), "".join(plain)


MARKED, PLAIN = _folding()


def fold(text: str) -> str:
    """A query's word as `tokens` gives it."""
    return text.lower().translate({ord(c): PLAIN[k] if k < len(PLAIN) else None for k, c in enumerate(MARKED)})


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits, marks taken off."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, field, pos and term of every token."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), tokens(F.col(c)).alias("words")) for c in COLUMNS))
    each = docs.select(F.col("id").alias("doc_id"), F.explode(fields).alias("f"))
    return each.select("doc_id", F.col("f.field").alias("field"), F.posexplode("f.words").alias("pos", "term"))


def parse(query: str) -> tuple:
    """A query as a tree: ("term", fields, words, prefix), ("and" | "or" | "not", left, right). Words side by side are and-ed;
    `"..."` is a phrase; a star after a word or phrase makes its last word a beginning; `name:`, `{a b} :` bind what follows
    to fields, `-name :` and `-{a b} :` to all others."""
    parts = re.findall(r'"[^"]*"\s*\*?|\(|\)|-?\s*\{[\w\s]+\}\s*:|-?\w+\s*:|[^\s()":{}]+', query)
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def unit(fields: tuple[str, ...] | None) -> tuple:
        nonlocal at
        p = parts[at]
        at += 1
        if p.endswith(":"):
            names = re.findall(r"\w+", p)
            for name in names:
                if name not in COLUMNS:
                    raise ValueError(f"no such field: {name}")
            chosen = tuple(c for c in COLUMNS if (c in names) != p.startswith("-"))
            return unit(tuple(c for c in chosen if fields is None or c in fields))
        if p == "(":
            inner = either(fields)
            at += 1
            return inner
        scope = fields[0] if fields is not None and len(fields) == 1 else fields
        words = tuple(re.findall(r"[^\W_]+", fold(p)))
        return ("term", scope, words, True) if p.endswith("*") else ("term", scope, words)

    def both(fields: tuple[str, ...] | None) -> tuple:
        nonlocal at
        left = unit(fields)
        while peek() not in (None, ")", "OR"):
            kind = "and"
            if peek() in ("AND", "NOT"):
                kind = peek().lower()
                at += 1
            left = kind, left, unit(fields)
        return left

    def either(fields: tuple[str, ...] | None) -> tuple:
        nonlocal at
        left = both(fields)
        while peek() == "OR":
            at += 1
            left = "or", left, both(fields)
        return left

    return either(None)


def _fits(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def matches(index: DataFrame, tree: tuple) -> DataFrame:
    """doc_id of the documents that fit."""
    kind, left, right = tree[:3]
    if kind == "term":
        if not right:  # no words, no match
            return index.filter(F.lit(False)).select("doc_id")
        prefix = len(tree) > 3
        scoped = index.filter(F.col("field").isin(*((left,) if isinstance(left, str) else left))) if left is not None else index
        hit = scoped.filter(_fits(right[0], prefix and len(right) == 1))
        for k, word in enumerate(right[1:], 1):
            other = scoped.filter(_fits(word, prefix and k == len(right) - 1)).select("doc_id", "field", (F.col("pos") - k).alias("pos"))
            hit = hit.join(other, ["doc_id", "field", "pos"], "left_semi")
        return hit.select("doc_id").distinct()
    a, b = matches(index, left), matches(index, right)
    return a.union(b).distinct() if kind == "or" else a.join(b, "doc_id", "left_semi" if kind == "and" else "left_anti")


def words_of(tree: tuple) -> list[tuple[str, bool]]:
    """The words that a result is scored by, and whether each is a beginning only; those under a NOT are left out."""
    if tree[0] == "term":
        return list(dict.fromkeys((w, len(tree) > 3 and k == len(tree[2]) - 1) for k, w in enumerate(tree[2])))
    return list(dict.fromkeys([*words_of(tree[1]), *(words_of(tree[2]) if tree[0] != "not" else [])]))


def _asked(docs: DataFrame, words: list[tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Postings of some words (or beginnings) alone, and doc_id and len of every document. Texts are split into words once:
    what is found is written, a row a document, and both are read from that."""
    fits = lambda term: F.lit(False) if not words else reduce(Column.__or__, [F.startswith(term, F.lit(w)) if p else term == w for w, p in words])
    fields = F.array(*(F.struct(F.lit(c).alias("field"), tokens(F.col(c)).alias("words")) for c in COLUMNS))
    mine = lambda f: F.filter(F.transform(f["words"], lambda w, k: F.struct(f["field"].alias("field"), k.alias("pos"), w.alias("term"))), lambda x: fits(x["term"]))
    split = docs.select(F.col("id").alias("doc_id"), fields.alias("fields"))
    length = F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["words"]))
    once = stored(split.select("doc_id", length.alias("len"), F.flatten(F.transform("fields", mine)).alias("hits")), "words")
    return once.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.field", "h.pos", "h.term"), once.select("doc_id", "len")


def search(docs: DataFrame, query: str, limit: int = 50, index: DataFrame | None = None) -> DataFrame:
    """doc_id and score (lower is better) of the best matches: BM25 over all fields alike. Postings that are there already
    may be given; without them the documents are split into words here, once."""
    tree = parse(query)
    if index is None:
        index, sizes = _asked(docs, _all_words(tree))
    else:
        sizes = index.groupBy("doc_id").agg(F.count("*").alias("len"))
    facts = docs.select(F.col("id").alias("doc_id")).join(sizes, "doc_id", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("len", F.lit(0))).alias("mean"))
    said = words_of(tree)
    asked = F.array(*(F.lit(w + "*" * p) for w, p in said))
    hits = F.lit(False)
    for w, p in said:
        hits = hits | _fits(w, p)
    # a beginning counts as one term, whatever words it stands for
    named = F.explode(F.filter(asked, lambda q: F.when(q.endswith("*"), F.startswith("term", F.rtrim(q, F.lit("*")))).otherwise(q == F.col("term"))))
    terms = index.filter(hits).select("doc_id", named.alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    spread = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = terms.join(matches(index, tree), "doc_id").join(spread, "term").join(sizes, "doc_id").crossJoin(F.broadcast(facts))  # one row
    return scored.groupBy("doc_id").agg(F.round(-F.sum(weight), 6).alias("score")).orderBy("score", "doc_id").limit(limit)


def _needed(tree: tuple) -> set[str]:
    """Words (a beginning with its star) that every match has."""
    if tree[0] == "term":
        return {w + "*" * p for w, p in words_of(tree)}
    left, right = _needed(tree[1]), _needed(tree[2])
    return left | right if tree[0] == "and" else left & right if tree[0] == "or" else left


def _all_words(tree: tuple) -> list[tuple[str, bool]]:
    return words_of(tree) if tree[0] == "term" else list(dict.fromkeys([*_all_words(tree[1]), *_all_words(tree[2])]))


#: A stored block: an id has the bits in which doc_id differs from its range's begin; the bound is rounded up to STEPS a unit.
BLOCK, STEPS = "term string, range long, n int, bound float, docs array<struct<id: long, len: int, at: array<long>>>", 1024


def _blocks(docs: pa.Table, mean: float, bits: int) -> pa.Table:
    """The blocks of some ranges, ordered by term and range: for each term the documents of a range, each with its length and
    the places of the term."""
    fields = docs.column("w").combine_chunks().flatten()  # as many a document as COLUMNS
    sizes = fields.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids, doc = np.unique(docs.column("doc_id").to_numpy().astype(np.int64), return_inverse=True)
    range_of = np.zeros(len(ids), np.int64)
    range_of[doc] = docs.column("range").to_numpy()
    row_len = sizes.reshape(-1, len(COLUMNS)).sum(axis=1)
    length = np.zeros(len(ids), np.int64)
    length[doc] = row_len
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(sizes)) % len(COLUMNS) << 40) - np.cumsum(sizes) + sizes, sizes)
    terms = fields.flatten().dictionary_encode()
    by_name = pc.array_sort_indices(terms.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    key = rank[terms.indices.to_numpy(zero_copy_only=False)] * len(ids) + np.repeat(doc, row_len)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    each = np.flatnonzero(np.diff(key, prepend=-1))  # where a term's document begins
    term, one = key[each] // len(ids), key[each] % len(ids)
    head = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(range_of[one], prepend=0) != 0))  # where a block begins
    n = np.diff(np.append(head, len(each)))
    tf = np.diff(np.append(each, len(at)))
    score = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[one] / mean))
    bound = np.ceil(np.maximum.reduceat(score, head) * STEPS) / STEPS if len(head) else score
    lists = lambda starts, inner: pa.ListArray.from_arrays(pa.array(np.append(starts, len(inner)).astype(np.int32)), inner)
    rows = pa.StructArray.from_arrays([pa.array(ids[one] ^ (range_of[one] << bits)), pa.array(length[one].astype(np.int32)), lists(each, pa.array(at))], ["id", "len", "at"])
    columns = [terms.dictionary.take(pa.array(by_name[term[head]])), pa.array(range_of[one[head]]), pa.array(n.astype(np.int32)), pa.array(bound.astype(np.float32)), lists(head, rows)]
    return pa.table(columns, ["term", "range", "n", "bound", "docs"])


class Index:
    """Postings in immutable segments under one log.

    A segment has blocks: for a term and `RANGE` neighbouring doc_ids, the documents with their positions, and the highest
    score (without the term's weight) that one of them can get; and a row for each document with its length. An update writes
    a segment of the changed documents and a list of the rows that died in older segments, nothing else; segments of like
    size are merged when there are `FAN` of them, so a row is rewritten about log times. The log's entry holds the counts of
    documents and their lengths, so a search reads no document but those of the blocks that it needs.

    A search for the first `limit` adds up the bounds of each range's blocks, reads ranges in falling order of these sums,
    `FIRST` of them, then eight times as many, and ends when no range left can beat the last place."""

    RANGE, FAN, FIRST, ROUNDS = 128, 4, 64, 3
    #: Words of a task that builds blocks, so that its memory has a bound and nothing is spilled, whatever the session's settings.
    WORDS = 2_000_000

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, f"{folder.rstrip('/')}/_log")
        self.looked: list[int] = []  # ranges read in each round of the last search

    # --- segments ---

    def _differs(self, doc_id: Column) -> Column:
        """A stored id of a doc_id, and the other way round; bits, since sums overflow at the last of the ids."""
        return doc_id.bitwiseXOR(F.shiftleft("range", self.RANGE.bit_length() - 1))

    def _parts(self, length: int) -> int:
        return max(1, math.ceil(length / self.WORDS))

    def _built(self, docs: DataFrame) -> tuple[Callable[[float, int], DataFrame], DataFrame]:
        """What makes blocks, given the mean and the sum of all lengths, and doc_id, range and length of every document. Only the
        texts are dealt and sorted, by some ranges a task; a row a word or a row a block would be many times as large."""
        named, bits = (F.col("id").alias("doc_id"), F.floor(F.col("id") / self.RANGE).alias("range")), self.RANGE.bit_length() - 1
        words = lambda rows, *more: rows.select("doc_id", "range", *more, F.array(*(tokens(F.col(c)) for c in COLUMNS)).alias("w"))

        def blocks(mean: float, length: int) -> DataFrame:
            parts = self._parts(length)
            rows = docs.select(*named, *COLUMNS).filter("doc_id is not null").withColumn("task", F.pmod(F.xxhash64("range"), F.lit(parts)).cast("int"))
            dealt = rows.repartitionById(parts, F.col("task")).sortWithinPartitions("task")  # texts are sorted, not their words
            return words(dealt, "task").groupBy("task").applyInArrow(lambda t: _blocks(t, mean, bits), BLOCK)

        length = F.aggregate("w", F.lit(0), lambda n, f: n + F.size(f))
        return blocks, words(docs.select(*named, *COLUMNS)).select("doc_id", "range", length.alias("len"))

    def _saved(self, blocks: Callable[[float, int], DataFrame], docs: DataFrame, seq: int) -> dict:
        """Write a segment and describe it. Its bounds hold for its own mean length, and by a factor for any other. Blocks stay
        dealt by range; a file has its terms in order, so a word's blocks are few neighbouring pages of each."""
        name = uuid.uuid4().hex
        save = lambda rows, kind: rows.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/{kind}")
        save(docs.repartition("range").sortWithinPartitions("doc_id"), "docs")
        n, length = self.spark.read.parquet(f"{self.folder}/{name}/docs").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        mean = length / n if length else 1.0
        save(blocks(mean, length), "blocks")
        return {"name": name, "seq": seq, "docs": n, "length": length, "mean": mean}

    def _each(self, state: dict, kind: str, only: set[int] | None = None) -> DataFrame | None:
        """blocks or docs of the segments, with seq and factor (how much a bound grows with today's mean)."""
        mean, out = self._facts(state)[1], None
        for s in state.get("segments", []):
            if only is None or s["seq"] in only:
                part = self.spark.read.parquet(f"{self.folder}/{s['name']}/{kind}")
                if kind == "blocks":
                    part = part.withColumn("docs", F.transform("docs", lambda d: F.struct(self._differs(d["id"]).alias("doc_id"), d["len"].alias("len"), d["at"].alias("at"))))
                part = part.withColumns({"seq": F.lit(s["seq"]), "factor": F.lit(max(1.0, mean / s["mean"]) * (1 + 1e-12))})
                out = part if out is None else out.unionByName(part)
        return out

    def _dead(self, state: dict) -> DataFrame | None:
        """seq, range and doc_id of rows that count no more."""
        paths = [f"{self.folder}/{d['name']}" for d in state.get("dead", [])]
        return self.spark.read.parquet(*paths).select("seq", "range", "doc_id") if paths else None

    @staticmethod
    def _lost(state: dict) -> dict[int, tuple[int, int]]:
        """Of each segment, how many documents died and their length."""
        out = {s["seq"]: (0, 0) for s in state.get("segments", [])}
        for d in state.get("dead", []):
            for seq, (n, length) in d["of"].items():
                if int(seq) in out:
                    out[int(seq)] = out[int(seq)][0] + n, out[int(seq)][1] + length
        return out

    def _facts(self, state: dict) -> tuple[int, float]:
        """Documents and their mean length."""
        lost = self._lost(state)
        n = sum(s["docs"] - lost[s["seq"]][0] for s in state.get("segments", []))
        return n, sum(s["length"] - lost[s["seq"]][1] for s in state.get("segments", [])) / max(n, 1)

    # --- changes ---

    def rebuild(self, docs: DataFrame) -> None:
        """One segment of all documents in place of what is there."""
        while True:
            number, state = self.log.latest()
            seq = state.get("seq", 0) + 1
            made = self._saved(*self._built(docs), seq)
            try:
                return self.log.add(number + 1, {"segments": [made], "dead": [], "seq": seq})
            except Conflict:
                continue

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """docs: new and changed documents, whose old postings die; removed: doc_id of those that are gone."""
        gone = docs.select(F.col("id").alias("doc_id"))
        gone = (gone if removed is None else gone.unionByName(removed.select("doc_id"))).distinct()
        made = None
        while True:
            number, state = self.log.latest()
            seq, dead = state.get("seq", 0) + 1, []
            made = made or self._saved(*self._built(docs), seq)
            there = self._each(state, "docs")
            if there is not None:
                old, before = there.select("seq", "range", "doc_id", "len").join(gone, "doc_id", "left_semi"), self._dead(state)
                old = old if before is None else old.join(before, ["seq", "range", "doc_id"], "left_anti")
                name = uuid.uuid4().hex
                old.repartition("doc_id").write.parquet(f"{self.folder}/{name}")  # a row a changed document
                of = {str(r["seq"]): [r["n"], r["length"]] for r in self.spark.read.parquet(f"{self.folder}/{name}").groupBy("seq").agg(F.count("*").alias("n"), F.sum("len").alias("length")).collect()}
                dead = [{"name": name, "of": of}] if of else []
            segments = [*state.get("segments", []), *([made | {"seq": seq}] if made["docs"] else [])]
            try:
                self.log.add(number + 1, {"segments": segments, "dead": [*state.get("dead", []), *dead], "seq": seq})
                break
            except Conflict:
                continue
        self.merge()

    def merge(self) -> None:
        """Join segments of one size class, and rewrite one of which half has died, until there are none such."""
        while True:
            number, state = self.log.latest()
            lost, tiers = self._lost(state), {}
            for s in state.get("segments", []):
                live = s["docs"] - lost[s["seq"]][0]
                tiers.setdefault(int(math.log(max(live, 1), self.FAN)), []).append(s)
            some = next((t for t in tiers.values() if len(t) >= self.FAN), None) or [s for s in state.get("segments", []) if 2 * lost[s["seq"]][0] >= s["docs"]][:1]
            if not some:
                return
            old, seq = {s["seq"] for s in some}, state["seq"] + 1
            parts = self._parts(sum(s["length"] for s in some))
            blocks, docs, dead = self._each(state, "blocks", old).repartition(parts, "range"), self._each(state, "docs", old), self._dead(state)
            if dead is not None:
                docs = docs.join(dead, ["seq", "range", "doc_id"], "left_anti")
                gone = dead.groupBy("range").agg(F.collect_set(F.struct("seq", "doc_id")).alias("gone"))  # at most RANGE a segment
                blocks = blocks.join(gone, "range", "left").withColumn("docs", F.when(F.col("gone").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda d: ~F.array_contains("gone", F.struct(F.col("seq"), d["doc_id"].alias("doc_id"))))))
            joint = blocks.groupBy("term", "range").agg(F.flatten(F.collect_list("docs")).alias("docs")).filter(F.size("docs") > 0)

            def stored(mean: float, _: int) -> DataFrame:
                score = lambda d: F.size(d["at"]) * (K1 + 1) / (F.size(d["at"]) + K1 * (1 - B + B * d["len"] / mean))
                bound = F.ceil(F.array_max(F.transform("docs", score)) * STEPS) / STEPS
                rows = F.transform("docs", lambda d: F.struct(self._differs(d["doc_id"]).alias("id"), d["len"].alias("len"), d["at"].alias("at")))
                return joint.select("term", "range", F.size("docs").alias("n"), bound.cast("float").alias("bound"), rows.alias("docs")).sortWithinPartitions("term", "range")

            made = self._saved(stored, docs.select("doc_id", "range", "len"), seq)
            rest = [s for s in state["segments"] if s["seq"] not in old] + ([made] if made["docs"] else [])
            names = {str(s["seq"]) for s in rest}
            try:
                self.log.add(number + 1, {"segments": rest, "dead": [d for d in state["dead"] if names & set(d["of"])], "seq": seq})
            except Conflict:
                continue

    # --- search ---

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """doc_id and score (lower is better) of the best matches, as `search` gives them for the same documents."""
        tree, (_, state) = parse(query), self.log.latest()
        shape = "doc_id long, score double"
        said, every = words_of(tree), _all_words(tree)
        blocks = self._each(state, "blocks")
        self.looked = []
        if blocks is None or not said:
            return self.spark.createDataFrame([], shape)
        hits = F.lit(False)
        for w, p in every:
            hits = hits | _fits(w, p)
        asked = F.array(*(F.lit(w + "*" * p) for w, p in every))
        named = F.filter(asked, lambda q: F.when(q.endswith("*"), F.startswith("term", F.rtrim(q, F.lit("*")))).otherwise(q == F.col("term")))
        mine = blocks.filter(hits).withColumn("name", F.explode(named))
        n, mean = self._facts(state)
        dead = self._dead(state)
        gone = None if dead is None else dead.groupBy("seq", "range").agg(F.collect_set("doc_id").alias("gone"))

        def live(rows: DataFrame) -> DataFrame:
            if gone is None:
                return rows
            kept = F.when(F.col("gone").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda d: ~F.array_contains("gone", d["doc_id"])))
            return rows.join(gone, ["seq", "range"], "left").withColumn("docs", kept).drop("gone")

        # documents of each word: from the blocks' counts, less those that died; those of a beginning are counted
        weights = {}
        single, starred = [w for w, p in said if not p], [w for w, p in said if p]
        if single:
            plain = mine.filter(F.col("name").isin(*single))
            counted = plain.groupBy("name").agg(F.sum("n").alias("df"))
            if gone is not None:
                lost = plain.join(gone, ["seq", "range"]).groupBy("name").agg(F.sum(F.size(F.filter("docs", lambda d: F.array_contains("gone", d["doc_id"])))).alias("lost"))
                counted = counted.join(lost, "name", "left").select("name", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
            weights |= {r["name"]: r["df"] for r in counted.collect()}  # one row a word of the query
        if starred:
            begun = live(mine.filter(F.col("name").isin(*(w + "*" for w in starred))))
            weights |= {r["name"]: r["df"] for r in begun.select("name", F.explode("docs.doc_id").alias("d")).groupBy("name").agg(F.count_distinct("d").alias("df")).collect()}
        idf = {name: max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) for name, df in weights.items()}
        if not idf:
            return self.spark.createDataFrame([], shape)
        weight = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))[F.col("name")]
        needed = sorted(_needed(tree))
        sums = mine.groupBy("seq", "range").agg(F.coalesce(F.sum(weight * F.col("bound") * F.col("factor")), F.lit(0.0)).alias("most"), F.collect_set("name").alias("names"))
        for w in needed:
            sums = sums.filter(F.array_contains("names", w))
        sums = sums.select("seq", "range", "most")
        best, last, done = [], None, []
        pairs = lambda rows: F.broadcast(self.spark.createDataFrame(rows, "seq int, range long"))  # noqa: E731  (FIRST and eight times as many)
        for k in range(self.ROUNDS):
            left = sums if last is None else sums.filter(F.col("most") >= last)
            left = left.join(pairs(done), ["seq", "range"], "left_anti") if done else left
            some = None
            if k < self.ROUNDS - 1:
                some = [(r["seq"], r["range"]) for r in left.orderBy(F.desc("most"), "seq", "range").limit(self.FIRST * 8**k).collect()]
                if not some:
                    break
                done += some
                chosen = mine.filter(F.col("range").isin([r for _, r in some])).join(pairs(some), ["seq", "range"], "left_semi")
            else:
                chosen = mine.join(left.select("seq", "range"), ["seq", "range"], "left_semi")
            self.looked.append(len(some) if some else left.count())
            found = self._scored(live(chosen), tree, said, weight, mean).orderBy("score", "doc_id").limit(limit).collect()
            best = sorted([*best, *((r["score"], r["doc_id"]) for r in found)])[:limit]
            if len(best) == limit:
                last = -best[-1][0] - 6e-7  # scores are rounded
            if some is not None and len(some) < self.FIRST * 8**k:
                break
        return self.spark.createDataFrame([(d, s) for s, d in best], shape).orderBy("score", "doc_id")

    @staticmethod
    def _scored(blocks: DataFrame, tree: tuple, said: list[tuple[str, bool]], weight: Column, mean: float) -> DataFrame:
        """doc_id and score of the matches in some blocks, which hold all of the query's words of their ranges."""
        each = blocks.select("name", "term", F.explode("docs").alias("d")).select("name", "term", "d.*")
        at = each.dropDuplicates(["doc_id", "term"]).select("doc_id", "term", F.explode("at").alias("at"))
        fields = F.array(*(F.lit(c) for c in COLUMNS))
        index = at.select("doc_id", F.element_at(fields, (F.shiftright("at", 40) + 1).cast("int")).alias("field"), (F.col("at").bitwiseAND((1 << 40) - 1)).alias("pos"), "term")
        tf = each.filter(F.col("name").isin(*(w + "*" * p for w, p in said))).groupBy("doc_id", "name").agg(F.sum(F.size("at")).alias("tf"), F.first("len").alias("len"))
        score = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
        return tf.join(matches(index, tree), "doc_id", "left_semi").groupBy("doc_id").agg(F.round(-F.sum(score), 6).alias("score"))

    def postings(self) -> DataFrame:
        """doc_id, field, pos and term of every token that counts."""
        state = self.log.latest()[1]
        blocks, dead = self._each(state, "blocks"), self._dead(state)
        each = blocks.select("seq", "range", "term", F.explode("docs").alias("d")).select("seq", "range", "term", "d.doc_id", F.explode("d.at").alias("at"))
        each = each if dead is None else each.join(dead, ["seq", "range", "doc_id"], "left_anti")
        fields = F.array(*(F.lit(c) for c in COLUMNS))
        return each.select("doc_id", F.element_at(fields, (F.shiftright("at", 40) + 1).cast("int")).alias("field"), F.col("at").bitwiseAND((1 << 40) - 1).alias("pos"), "term")
