"""Removal of long repeated byte strings, with suffix arrays by linear grouping.

Suffix order is what makes equal strings neighbours; the work is to bring only strings that may repeat into one array.
Every window of `LENGTH` bytes picks its least hashed `GRAM`-byte gram; windows of one text with one pick form a run, and
equal windows anywhere pick the same gram at the same place. So

1. runs whose gram occurs in one run alone hold no repeated window and are dropped;
2. of equal runs (one class, by gram and 128 bits of hash) one representative goes on, twice if there are two or more;
3. the representatives of a gram enter one suffix array, over symbols of `PACK` bytes in step with the gram. Windows are
   repeated where neighbours in the array have a common prefix that covers the window: whole symbols by the neighbours'
   longest common prefix, the bytes at either end by comparison;
4. a class's windows that the array marks are marked in each of its runs, united by text and cut out.

A task sends one row for equal runs of its own, so a string in a great many documents costs a row per task, not one per
document. A gram with more than `HOT` classes is no group: its representatives are parted again by longer grams
(`GRAMS`), up to whole windows, where a group is one class. So an array's size has a bound, and a gram of very many runs
is work for many tasks, in proportion to its bytes.

Defined results: a null or empty text has no bytes; texts under LENGTH bytes lose nothing; repeated rows are documents
of their own, so their strings repeat; overlaps within a document count; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import Hasher, Texts, pieces
from docloom.llm._spark import written
from docloom.llm.neardup import _bitmap

LENGTH = 200
#: Bytes of the gram that a window is grouped by, and of those that part grams with more than HOT classes.
GRAMS = (64, 128, 176, 200)
HOT = 1024
BATCH = 1 << 18
#: Bytes of a suffix array's symbol.
PACK = 16
FILTER_BITS = 1 << 26
#: Low bits of a gram's hash that give way to its place. Fixed, so that grams tie alike whatever bytes stand around them.
PLACE_BITS = 31
#: A second naming of the bytes, for the other half of a class's 128 bits.
_TWIN = np.random.default_rng(11).permutation(256).astype(np.uint8)


def suffix_array(s: list[int]) -> list[int]:
    """Suffixes of s in order; s ends with its only least symbol.

    First all suffixes with one Lyndon prefix come into one group: groups are taken from the greatest down; each member
    points to the last earlier suffix in a lower group, and a suffix pointed to more often moves behind its group's
    others. Then a scan of the array in order places, before each suffix, its left neighbour and that one's pointers.
    """
    n = len(s)
    array = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    start = [0] * n
    size = [0] * n
    begin = 0
    for k, i in enumerate(array):
        place[i] = k
        if k and s[i] != s[array[k - 1]]:
            begin = k
        start[i] = begin
        size[begin] += 1
    before = [-1] * n
    last = n - 1
    while last >= 0:
        group = start[array[last]]
        members = array[group : last + 1]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and start[j] >= group:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            if len(times) == 1:
                steps = [list(times)]
            else:
                levels: dict[int, list[int]] = {}
                for j, c in times.items():
                    levels.setdefault(c, []).append(j)
                steps = [levels[c] for c in sorted(levels, reverse=True)]
            for step in steps:
                moved: dict[int, list[int]] = {}
                for j in step:
                    g = start[j]
                    size[g] -= 1
                    to, at = g + size[g], place[j]
                    other = array[to]
                    array[to], array[at] = j, other
                    place[other], place[j] = at, to
                    moved.setdefault(g, []).append(j)
                for g, js in moved.items():
                    new = g + size[g]
                    size[new] = len(js)
                    for j in js:
                        start[j] = new
        last = group - 1
    out = [-1] * n
    front = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = start[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def common_symbols(symbol: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Longest common prefix, in symbols and up to `most`, of each suffix in the array's order with the one before it."""
    out = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for k in range(most):
        a, b = order[going] + k, order[going - 1] + k
        inside = (a < len(symbol)) & (b < len(symbol))
        going, a, b = going[inside], a[inside], b[inside]
        going = going[symbol[a] == symbol[b]]
        if not len(going):
            break
        out[going] = k + 1
    return out


def equal_windows(parts: list[bytes], leads: list[int], length: int, pack: int = PACK) -> list[np.ndarray]:
    """For each part, marks of its windows of `length` bytes that stand at the same place about their grams elsewhere.

    Parts are cut into symbols of `pack` bytes that fall in step with the gram (at `leads`), so that equal windows hold
    equal symbols. In the suffix array over symbols, suffixes whose neighbours share as many symbols as a window has whole
    ones form a class; in a class, windows are equal where the bytes that they have before and after those symbols are.
    """
    pack = min(pack, max(1, length // 2))
    words, begin, wide = [], [], []
    for p, lead in zip(parts, leads):
        skip = lead % pack
        n = max(0, len(p) - skip) // pack
        begin.append(0 if not words else begin[-1] + wide[-1] + 1)
        wide.append(n)
        words.append(np.frombuffer(p, np.uint8, n * pack, skip if n else 0).reshape(n, pack))
    total = begin[-1] + wide[-1] + 2
    gap = np.ones(total, bool)
    for b, n in zip(begin, wide):
        gap[b : b + n] = False
    symbol = np.ones(total, np.int64)  # 1 parts the parts, 0 ends them all
    every = np.ascontiguousarray(np.concatenate(words))
    if len(every):
        symbol[~gap] = np.unique(every.view(np.dtype((np.void, pack))).ravel(), return_inverse=True)[1].ravel() + 2
    symbol[-1] = 0
    order = np.array(suffix_array(symbol.tolist()))
    inner = (length - pack + 1) // pack
    shared = common_symbols(symbol, order, inner)
    kind = np.zeros(total, np.int64)
    kind[order] = np.cumsum(shared < inner)
    sizes = np.array([max(0, len(p) - length + 1) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.cumsum([0, *map(len, parts)])[:-1]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    skip = np.repeat([lead % pack for lead in leads], sizes)
    start = np.repeat(at, sizes) + within
    ahead = (skip - within) % pack  # bytes before the first whole symbol
    first = np.repeat(begin, sizes) + (within + ahead - skip) // pack
    edge = length - inner * pack
    ends = np.empty((len(start), edge), np.uint8)  # the bytes around the whole symbols, in order
    for k in range(edge):
        ends[:, k] = data[start + np.where(k < ahead, k, k + inner * pack)]
    named = np.zeros((len(start), 12 + edge), np.uint8)
    named[:, :8] = kind[first].astype(">i8").view(np.uint8).reshape(-1, 8)
    named[:, 8:12] = ahead.astype(">i4").view(np.uint8).reshape(-1, 4)
    named[:, 12:] = ends
    if not len(named):
        return [np.zeros(0, bool) for _ in parts]
    _, inverse, times = np.unique(named.view(np.dtype((np.void, named.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    return np.split(times[inverse.ravel()] > 1, np.cumsum(sizes)[:-1])


def runs(t: Texts, hasher: Hasher, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Maximal stretches of windows that pick one gram: gram hash, run hash, document, first and last window, and the
    gram's place after the first."""
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(t.ends - t.starts >= length)
    if not len(long):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    width = length - gram + 1
    n = len(t.data) - gram + 1
    at = np.arange(n)
    bits = PLACE_BITS
    h = hasher(at, at + gram)
    key = (h >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)  # equal hashes: the leftmost
    # least key of each `width` neighbours: within blocks from both ends
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(t.data) - length + 1
    pick = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    inside = np.zeros(m + 1, np.int8)
    np.add.at(inside, t.starts[long], 1)
    np.add.at(inside, t.ends[long] - length + 1, -1)
    good = np.cumsum(inside[:m]) > 0
    edge = np.zeros(m, bool)
    edge[0] = True
    edge[1:] = pick[1:] != pick[:-1]
    edge[t.starts[long]] = True
    first = np.flatnonzero(edge & good)
    stop = np.append(np.flatnonzero(edge), m)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    doc = t.doc_of(first)
    last = np.minimum(last, t.ends[doc] - length)
    return h[pick[first]], hasher(first, last + length), doc, first - t.starts[doc], last - t.starts[doc], pick[first] - first


_SENT = "gram long, run long, twin long, row long, base int, first int, last int, lead int, n int, who array<struct<row:long,base:int,first:int>>"
_SETTLED = "kind int, hot boolean, gram long, crow long, cbase int, cfirst int, last int, lead int, who array<struct<row:long,base:int,first:int>>"
_WHO = pa.struct([("row", pa.int64()), ("base", pa.int32()), ("first", pa.int32())])


def _send(length: int, gram: int):
    """Runs of texts (row, base, n times each): a row for each class of equal runs, with its members here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            g, e, f, row, base, n, first, last, lead = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((f, e, g))
            g, e, f, row, base, n, first, last, lead = (x[order] for x in (g, e, f, row, base, n, first, last, lead))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1]) | (f[1:] != f[:-1])
            begin = np.flatnonzero(new)
            members = pa.StructArray.from_arrays([pa.array(row), pa.array(base), pa.array(first)], fields=list(_WHO))
            who = pa.ListArray.from_arrays(pa.array(np.append(begin, len(g)).astype(np.int32)), members)
            columns = [g.view(np.int64), e.view(np.int64), f.view(np.int64), row, base, first, last, lead]
            times = np.minimum(np.add.reduceat(n, begin), 2).astype(np.int32)
            return pa.RecordBatch.from_arrays([*(pa.array(x[begin]) for x in columns), pa.array(times), who], ["gram", "run", "twin", "row", "base", "first", "last", "lead", "n", "who"])

        for part, t in pieces(batches, "text"):
            hasher = Hasher(t.data)
            g, e, doc, first, last, lead = runs(t, hasher, length, gram)
            if len(g):
                twin = Hasher(_TWIN[t.data])(t.starts[doc] + first, t.starts[doc] + last + length)
                row, base, n = (part.column(k).to_numpy()[doc] for k in range(3))
                held.append([g, e, twin, row, base.astype(np.int32), n, first.astype(np.int32), last.astype(np.int32), lead.astype(np.int32)])
                count += len(g)
            if count > 300_000:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return run


def _settle(most: int):
    """Rows sorted by gram and class; those of grams with two runs or more come back with their class's representative
    (crow, cbase, cfirst). kind is -1 but on a class's first row: 0 for a class of one run, 1 for two or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        going: int | None = None  # a hot gram of which a part is told already

        def work(table: pa.Table, hot_gram: int | None) -> pa.RecordBatch:
            g, e, f, row, base, first, last, lead, n = (table.column(k).to_numpy() for k in range(9))
            gram_begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1]) | (f[1:] != f[:-1])
            begin = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            times = np.add.reduceat(n, begin)
            gram_of = np.repeat(np.arange(len(gram_begin)), np.diff(np.append(gram_begin, len(g))))
            runs_of, classes_of = np.add.reduceat(n, gram_begin), np.add.reduceat(new.astype(np.int64), gram_begin)
            part = (g == hot_gram) if hot_gram is not None else np.zeros(len(g), bool)
            hot = part | (classes_of > most)[gram_of]
            kept = np.flatnonzero(part | (runs_of > 1)[gram_of])
            kind = np.where(new, np.minimum(times[of] - 1, 1), -1).astype(np.int32)
            rep = begin[of]
            columns = [kind, hot, g, row[rep], base[rep], first[rep], last, lead]
            who = table.column("who").combine_chunks()
            return pa.RecordBatch.from_arrays([*(pa.array(x[kept]) for x in columns), who.take(pa.array(kept))], ["kind", "hot", "gram", "crow", "cbase", "cfirst", "last", "lead", "who"])

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                held += batch.num_rows
            if held > 100_000:
                table = pa.Table.from_batches(rest).combine_chunks()
                g, e, f = (table.column(k).to_numpy() for k in range(3))
                same = g == g[-1]
                earlier = np.flatnonzero(~same)  # the last gram may go on
                if len(earlier):
                    stop = int(earlier[-1]) + 1
                    yield work(table.slice(0, stop), going)
                    going = None
                else:  # one gram alone: told but for its last class, which may go on
                    other = np.flatnonzero((e != e[-1]) | (f != f[-1]))
                    stop = int(other[-1]) + 1 if len(other) else 0
                    if stop:
                        going = int(g[-1])
                        yield work(table.slice(0, stop), going)
                rest = table.slice(stop).to_batches()
                held = table.num_rows - stop
        if rest:
            yield work(pa.Table.from_batches(rest).combine_chunks(), going)

    return run


def _cut(length: int):
    """Bytes of the wanted runs of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("gram", pa.int64()), ("kind", pa.int32()), ("hot", pa.bool_()), ("row", pa.int64()), ("base", pa.int32()), ("first", pa.int32()), ("lead", pa.int32()), ("bytes", pa.binary())]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out: dict[str, list] = {k: [] for k, _ in kinds}
                for x in batch.slice(lo, 64).to_pylist():
                    raw = x["text"]
                    for w in x["wanted"]:
                        for k in ("gram", "kind", "hot", "first", "lead"):
                            out[k].append(w[k])
                        out["row"].append(x["row"])
                        out["base"].append(x["base"])
                        out["bytes"].append(raw[w["first"] : w["last"] + length])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(kinds))

    return run


def _arrays(length: int, most: int):
    """Suffix arrays over the classes of each gram, of about `most` bytes or one gram's: repeated windows of a class."""

    def solve(group: list[tuple]) -> pa.RecordBatch:
        # a class of two runs or more stands in the array twice
        twice = [x for x in group if x[0]]
        every = group + twice
        out: list[tuple] = []
        for (_, row, base, first, _, _), marks in zip(group, equal_windows([x[5] for x in every], [x[4] for x in every], length)):
            if marks.any():
                at = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
                out += [(row, base, first, a, b - 1) for a, b in at.reshape(-1, 2).tolist()]
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], ["crow", "cbase", "cfirst", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, gram = 0, None
        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if x[0] != gram and size >= most:
                    yield solve(waiting)
                    waiting, size = [], 0
                gram = x[0]
                waiting.append(x[1:])
                size += len(x[6]) * (1 + x[1])
        if waiting:
            yield solve(waiting)

    return run


def _finish(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, shas, starts = [], [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                cuts: list[list[int]] = []
                for first, last in sorted((x["first"], x["last"]) for x in found or ()):
                    if cuts and first <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], last + length)
                    else:
                        cuts.append([first, last + length])
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                n_bytes.append(len(raw))
                removed.append(sum(b - a for a, b in cuts))
                spans.append(len(cuts))
                shas.append(hashlib.sha256(b"".join(kept)).hexdigest())
                starts.append(",".join(f"{a}:{b}" for a, b in cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(starts, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def _maybe(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that may be among the nodes, and the others, by a bitmap of fixed size."""
    bits = FILTER_BITS
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    @F.pandas_udf("boolean")
    def maybe(place):
        at = place.to_numpy()
        return pd.Series(((shipped.value[at // 64] >> (at % 64)) & 1).astype(bool))

    marked = docs.withColumn("__maybe", maybe(F.pmod(F.xxhash64("row"), F.lit(bits))))
    return marked.filter("__maybe").drop("__maybe"), marked.filter("not __maybe").drop("__maybe")


def repeated_windows(texts: DataFrame, length: int, grams: tuple[int, ...], hot: int, batch: int) -> DataFrame:
    """row, base, first and last of the stretches of windows of texts (row, base, n, text as bytes) that repeat."""
    last_level = len(grams) == 1
    sent = texts.select("row", "base", "n", "text").mapInArrow(_send(length, grams[0]), _SENT)
    most = (1 << 62) if last_level else hot
    settled = written(sent.repartition("gram").sortWithinPartitions("gram", "run", "twin").mapInArrow(_settle(most), _SETTLED), "settled")
    reps = settled.filter("kind >= 0").select(F.col("crow").alias("row"), F.col("cbase").alias("base"), F.struct("gram", "kind", "hot", F.col("cfirst").alias("first"), "last", "lead").alias("want"))
    asked = reps.groupBy("row", "base").agg(F.collect_list("want").alias("wanted"))
    some, _ = _maybe(texts.select("row", "base", "text"), reps.select(F.col("row").alias("node")))
    shape = "gram long, kind int, hot boolean, row long, base int, first int, lead int, bytes binary"
    snippets = some.join(asked, ["row", "base"]).select("row", "base", "text", "wanted").mapInArrow(_cut(length), shape)
    any_hot = not last_level and bool(settled.filter("hot").head(1))
    if any_hot:
        snippets = written(snippets, "snippets")
    cold = snippets.filter("not hot").select("gram", "kind", "row", "base", "first", "lead", "bytes")
    marks = cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(_arrays(length, batch), "crow long, cbase int, cfirst int, a int, b int")
    if any_hot:
        again = snippets.filter("hot").select("row", F.col("first").alias("base"), F.col("base").alias("under"), (F.col("kind") + 1).alias("n"), F.col("bytes").alias("text"))
        # a class is named by its representative's place; at the next level its bytes are a text of that name
        again = again.withColumn("row", F.xxhash64("row", "under"))
        names = snippets.filter("hot").select(F.xxhash64("row", "base").alias("row"), F.col("first").alias("base"), F.col("row").alias("crow"), F.col("base").alias("cbase"))
        deeper = repeated_windows(again, length, grams[1:], hot, batch).join(names, ["row", "base"])
        marks = marks.union(deeper.select("crow", "cbase", F.col("base").alias("cfirst"), F.col("first").alias("a"), F.col("last").alias("b")))
    found = settled.select("crow", "cbase", "cfirst", "who").join(written(marks, "marks").hint("merge"), ["crow", "cbase", "cfirst"])
    each = found.select("a", "b", F.explode("who").alias("w"))
    return each.select(F.col("w.row").alias("row"), F.col("w.base").alias("base"), (F.col("w.first") + F.col("a")).alias("first"), (F.col("w.first") + F.col("b")).alias("last"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (start:end byte ranges) of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.xxhash64("doc_id", text).alias("row"), "doc_id", text.alias("text"))
    texts = keyed.select("row", F.lit(0).alias("base"), F.lit(1).alias("n"), F.col("text").cast("binary").alias("text"))
    marks = written(repeated_windows(texts, length, grams, hot, batch).select("row", "first", "last"), "windows")
    found = marks.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    hit, clean = _maybe(keyed, marks.select(F.col("row").alias("node")))
    shape = "doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string".format(docs.schema["doc_id"].dataType.simpleString())
    none = F.array().cast("array<struct<first:int,last:int>>")
    cut = hit.join(found, "row", "left").select("doc_id", "text", "found").mapInArrow(_finish(length), shape)
    return cut.union(clean.select("doc_id", "text", none.alias("found")).mapInArrow(_finish(length), shape))
