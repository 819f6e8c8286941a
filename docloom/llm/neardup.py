"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct shingles. A signature has `POSITIONS` MinHash values of 8 bits. Two sets of similarity
0.8 differ in a fifth of the positions on average; the join finds every pair of signatures that differ in at most
`DISTANCE` of them, which a pair of that similarity exceeds with a chance of about one in a million. By the pigeonhole
principle such signatures have a chunk with at most floor(DISTANCE / CHUNKS) = 1 error; every chunk is entered once for
each way of leaving one position out, so the pair meets under an equal key. Links are confirmed on whole sets.

Copies are one node (equal sets, by size and 128 bits of hash). Groups under a key are not expanded into pairs: a first
round confirms each node against the nearest of its groups' hubs. Then every pair within DISTANCE that the links so far
leave in different components is confirmed, each in the group in which it meets first and inside the task that holds
the group's sets; only links that join something leave it. So no link between different texts that could change a
component is left out. A key of more than a block of nodes is compared with its least node block by block, and then only
blocks of different components with each other, so a large component of near copies is work in proportion to its size.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing; with fewer words
than a shingle the whole sequence is the one shingle; repeated rows are copies; rows that share a doc_id but not a text
are one node, linked through one of those texts; rows without doc_id link with nothing
and have no component; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bytes import Hasher, Texts, grams, mix, pieces, texts_of
from docloom.llm._spark import written
from docloom.llm.components import components, spanning

POSITIONS = 128
DISTANCE = 47
CHUNKS = 24
#: Nodes compared in one piece; a key with more is compared in pairs of half blocks.
BLOCK = 4096
#: Bits of the filter that keeps texts without candidates out of the shuffle (1 MB for each 2**23).
FILTER_BITS = 1 << 26
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = (mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (mix(np.arange(1001, POSITIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BOUNDS = np.linspace(0, POSITIONS, CHUNKS + 1).round().astype(int)


def shingles(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of the distinct shingles of each text, ordered by document."""
    t = t.lower()
    starts, ends = t.words()
    docs = t.doc_of(starts)
    words = Hasher(t.data)(starts, ends)
    h, at = grams(words, docs, size)
    owner = docs[at]
    count = np.bincount(docs, minlength=t.n)
    first = np.searchsorted(docs, np.arange(t.n))
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            more = count[few] > k
            whole[more] = mix(whole[more] * _ODD + words[first[few[more]] + k] + np.uint64(k + 1))
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, few])
    fresh = np.unique(mix(h + owner.astype(np.uint64) * _ODD), return_index=True)[1]
    fresh = fresh[np.argsort(owner[fresh], kind="stable")]
    return h[fresh], owner[fresh]


def signatures(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a set, their POSITIONS bytes)."""
    have, begin = np.unique(owner, return_index=True)
    out = np.zeros((len(have), POSITIONS), np.uint8)
    low = (h >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(low)
    for k in range(POSITIONS) if len(have) else ():
        np.bitwise_xor(low, _FLIP[k], out=turned)
        np.multiply(turned, _MULTIPLY[k], out=turned)
        out[:, k] = mix(np.minimum.reduceat(turned, begin)) & np.uint64(255)
    return have, out


def _sign(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in pieces(batches, "text"):
            h, owner = shingles(t, size)
            have, sig = signatures(h, owner, t.n)
            count = np.bincount(owner, minlength=t.n)
            one, two = np.zeros(t.n, np.uint64), np.zeros(t.n, np.uint64)
            if len(have):
                begin = np.searchsorted(owner, have)
                one[have] = np.add.reduceat(mix(h), begin)
                two[have] = np.add.reduceat(mix(h ^ _ODD), begin)
            raw: list = [None] * t.n
            for k, s in zip(have.tolist(), sig):
                raw[k] = s.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "one", "two", "sig"])

    return run


def _chunk_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each position of it left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            node = part.column(0).to_numpy()
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, POSITIONS).astype(np.uint64)
            keys = []
            for c in range(CHUNKS):
                inside = range(_BOUNDS[c], _BOUNDS[c + 1])
                for left_out in inside:
                    key = np.full(len(node), 1 + c * POSITIONS + left_out, np.uint64)
                    for k in inside:
                        if k != left_out:
                            key = (key << np.uint64(8)) | sig[:, k]
                    keys.append(mix(key * _ODD + np.uint64(left_out)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(node, len(keys)))], ["key", "node"])


#: What a list is for: all of its pairs; its first node against the others; members of a key with more than a block.
_PAIRS, _HUB, _HOT = range(3)


def _list_mark(part: np.ndarray, use: int) -> int:
    """A list's number, that of its nodes and its use."""
    mark = (int(np.add.reduce(mix(part.view(np.uint64) + _ODD))) + use * 0x2545F4914F6CDD1D ^ len(part)) & 0xFFFFFFFFFFFFFFFF
    return mark - (1 << 64) if mark >= 1 << 63 else mark


def _groups(block: int):
    """Sorted (key, node) rows to lists of the nodes under one key, two or more. A key with more than a block gives lists of
    its least node and a block of others each, and its members in blocks under the key, to be paired once components are
    known. Its nodes pass through in order, a block at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        key, hub = None, None
        out: list[tuple[int, int, np.ndarray]] = []

        def put(part: np.ndarray, use: int) -> None:
            mark = _list_mark(part, use)
            if mark not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(mark)
                out.append((mark, use, part))

        def spill(last: bool) -> None:
            """Held nodes of the current key: whole, or in blocks beside the hub."""
            nonlocal held, hub
            nodes = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            if hub is None and last:
                if len(nodes) > 1:
                    put(nodes, _PAIRS)
                held = []
                return
            while len(nodes) >= block or (last and len(nodes)):
                part, nodes = nodes[:block], nodes[block:]
                hub = part[0] if hub is None else hub
                others = part[part != hub]
                if len(others):
                    put(np.concatenate([[hub], others]), _HUB)
                out.append((int(key), _HOT, part))
            held = [nodes] if len(nodes) else []

        def told() -> pa.RecordBatch:
            marks, uses, members = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(uses, pa.int32()), pa.array(members, pa.list_(pa.int64()))], ["mark", "use", "members"])

        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
            for k in np.flatnonzero((end - begin > 1) | (np.arange(len(begin)) == 0) | (np.arange(len(begin)) == len(begin) - 1)).tolist():
                if keys[begin[k]] != key:
                    if key is not None:
                        spill(True)
                    key, hub, held = keys[begin[k]], None, []
                held.append(nodes[begin[k] : end[k]].copy())
                if sum(map(len, held)) > block:
                    spill(False)
            yield told()
        if key is not None:
            spill(True)
            yield told()

    return run


def _crossed(block: int):
    """Members of hot keys, sorted by key and component, to lists of two half blocks that hold different components. Blocks
    of one component and the same are not paired, so a large component costs a list for each block of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = max(1, block // 2)
        key = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            nodes, comps = (np.concatenate(x) for x in zip(*held))
            parts = [(nodes[k : k + half], comps[k], comps[min(len(nodes), k + half) - 1]) for k in range(0, len(nodes), half)]
            for i, (left, a, b) in enumerate(parts):
                rows = []
                for j in range(i, len(parts)):
                    right, c, d = parts[j]
                    if a == d and len({a, b, c, d}) == 1:
                        continue
                    both = np.unique(np.concatenate([left, right]))
                    if len(both) > 1:
                        rows.append((_list_mark(both, _PAIRS), both))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["mark", "members"])

        for batch in batches:
            keys, nodes, comps = (batch.column(k).to_numpy() for k in range(3))
            if not len(keys):
                continue
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if keys[a] != key:
                    if held:
                        yield from close()
                    key, held = keys[a], []
                held.append((nodes[a:b].copy(), comps[a:b].copy()))
        if held:
            yield from close()

    return run


def _near(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty(len(left), np.int64)
    for k in range(0, len(left), 20_000):
        out[k : k + 20_000] = (sig[left[k : k + 20_000]] != sig[right[k : k + 20_000]]).sum(1)
    return out


def _collisions(differ: np.ndarray) -> np.ndarray:
    """The first slot (chunk and position left out, as the number of the position) at which rows of a mismatch table
    have an equal key; POSITIONS if at none."""
    errors = np.add.reduceat(differ, _BOUNDS[:-1], axis=1, dtype=np.int16)
    meets = errors <= 1
    chunk = meets.argmax(1)
    out = np.full(len(differ), POSITIONS)
    for c in np.unique(chunk[meets.any(1)]).tolist():
        mine = np.flatnonzero((chunk == c) & meets[:, c])
        out[mine] = _BOUNDS[c] + differ[mine, _BOUNDS[c] : _BOUNDS[c + 1]].argmax(1)
    return out


def _pending(sig: np.ndarray, comp: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list within DISTANCE, of different components, that meet at this slot first."""
    left, right = [], []
    for k in range(0, len(sig), 64):
        differ = sig[k : k + 64, None, :] != sig[None, k:, :]
        near = differ.sum(2, dtype=np.int16) <= DISTANCE
        near &= comp[k : k + 64, None] != comp[None, k:]
        i, j = np.nonzero(np.triu(near, 1))
        mine = _collisions(differ[i, j]) == slot
        left.append(i[mine] + k)
        right.append(j[mine] + k)
    return np.concatenate(left), np.concatenate(right)


def _by_list(solve):
    """mapInArrow over rows sorted by mark, of which solve takes the whole lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            mark = table.column(0).to_numpy()
            earlier = np.flatnonzero(mark != mark[-1])  # the last list may go on
            if len(earlier):
                stop = int(earlier[-1]) + 1
                yield solve(table.slice(0, stop))
                held = table.slice(stop).to_batches()
                rows = table.num_rows - stop
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _lists_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes, nodes, components and signatures of a table's lists."""
    mark = table.column("mark").to_numpy()
    begin = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1])
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, POSITIONS)
    return begin, np.diff(np.append(begin, len(mark))), table.column("node").to_numpy(), table.column("comp").to_numpy(), sig


def _hubs(table: pa.Table) -> pa.RecordBatch:
    """Each member with its list's least node, if within DISTANCE."""
    begin, size, node, _, sig = _lists_of(table)
    right = np.arange(len(node))
    left = np.repeat(begin, size)
    left, right = left[left != right], right[left != right]
    gap = _near(sig, left, right)
    good = gap <= DISTANCE
    return pa.RecordBatch.from_arrays([pa.array(node[right[good]]), pa.array(node[left[good]]), pa.array(gap[good])], ["a", "b", "gap"])


def _open_nodes(table: pa.Table) -> pa.RecordBatch:
    """Members that have a pending pair in a list, and the slot at which all of the list meet."""
    begin, size, node, comp, sig = _lists_of(table)
    mark = table.column("mark").to_numpy()
    marks, nodes, slots = [], [], []
    mixed = np.flatnonzero(np.maximum.reduceat(comp, begin) != np.minimum.reduceat(comp, begin))
    for lo, n in zip(begin[mixed].tolist(), size[mixed].tolist()):
        own = sig[lo : lo + n]
        slot = int(_collisions((own != own[0]).any(0)[None, :])[0])
        left, right = _pending(own, comp[lo : lo + n], slot)
        some = np.unique(np.concatenate([left, right]))
        if len(some):
            marks.append(np.full(len(some), mark[lo]))
            nodes.append(node[lo + some])
            slots.append(np.full(len(some), slot))
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (marks, nodes, slots)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["mark", "node", "slot"])


def _shared(h: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, from bit rows over slices of the shingles in use."""
    names, at = np.unique(h, return_inverse=True)
    times = np.bincount(at)
    kept = times[at] > 1  # a shingle of one set is in no intersection
    at, owner = (np.cumsum(times > 1) - 1)[at[kept]], owner[kept]
    out = np.zeros(len(left), np.int64)
    width = 1 << 14
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for lo in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        bits = np.zeros((n, width), bool)
        bits[owner[a:b], at[a:b] - lo] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(left), 8192):
            out[k : k + 8192] += np.bitwise_count(packed[left[k : k + 8192]] & packed[right[k : k + 8192]]).sum(1, dtype=np.int64)
    return out


def _settle(size: int, percent: int):
    """Confirmed links of the pending pairs of each list, one for each node that they join to another."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        begin, count, node, comp, sig = _lists_of(table)
        slot, text = table.column("slot").to_numpy(), table.column("text")
        ones, twos = [], []
        for lo, n in zip(begin.tolist(), count.tolist()):
            left, right = _pending(sig[lo : lo + n], comp[lo : lo + n], int(slot[lo]))
            if not len(left):
                continue
            h, owner = shingles(texts_of(text.slice(lo, n).combine_chunks()), size)
            sizes = np.bincount(owner, minlength=n)
            both = _shared(h, owner, n, left, right)
            good = (100 * both >= percent * (sizes[left] + sizes[right] - both)) & (both > 0)
            a, b = spanning(node[lo + left[good]], node[lo + right[good]])
            ones.append(a)
            twos.append(b)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, twos)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b"])

    return _by_list(solve)


def _confirm(size: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = [shingles(texts_of(part.column(k)), size) for k in (2, 3)]
                keys = [mix(h + owner.astype(np.uint64) * _ODD) for h, owner in sets]
                sizes = [np.bincount(owner, minlength=part.num_rows) for _, owner in sets]
                _, at, _ = np.intersect1d(*keys, assume_unique=True, return_indices=True)
                both = np.bincount(sets[0][1][at], minlength=part.num_rows)
                good = (100 * both >= percent * (sizes[0] + sizes[1] - both)) & (both > 0)
                kept = part.select(["a", "b"]).filter(pa.array(good))
                yield kept

    return run


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each node; what reaches the driver is bits / 8 bytes whatever the input."""
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    rows = nodes.select(F.floor(place / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _texts_in(shipped, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            maybe = (table[place // 64] >> (place % 64)) & 1
            yield batch.select(["node", "text"]).filter(pa.array(maybe.astype(bool)))

    return run


def near_duplicates(docs: DataFrame, *, size: int = 4, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    signed = written(docs.select("doc_id", "text").mapInArrow(_sign(size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, one long, two long, sig binary"), "signed")
    usable = signed.filter("n_shingles > 0 and doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    copies = usable.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("node"))
    nodes = written(usable.join(copies, ["n_shingles", "one", "two"]).filter("doc_id = node").select("node", "sig").dropDuplicates(["node"]), "nodes")

    keyed = nodes.mapInArrow(_chunk_keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    lists = written(keyed.mapInArrow(_groups(block), "mark long, use int, members array<long>"), "lists")
    once = lists.filter(F.col("use") < _HOT).dropDuplicates(["mark"])
    members = written(once.select("mark", "use", F.explode("members").alias("node")), "members")
    hot = lists.filter(F.col("use") == _HOT).select("mark", F.explode("members").alias("node"))
    any_hot = bool(lists.filter(F.col("use") == _HOT).head(1))
    with_sig = members.join(nodes, "node")

    bits = FILTER_BITS
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(members.select("node").distinct(), bits))
    wide = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("place"))
    texts = written(wide.mapInArrow(_texts_in(shipped, bits), "node long, text string").join(members.select("node").distinct(), "node", "left_semi"), "texts")
    texts = texts.dropDuplicates(["node"]) if _repeats(texts) else texts

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long")

    def listed(frame: DataFrame) -> DataFrame:
        return frame.repartition("mark").sortWithinPartitions("mark", "node")

    alone = with_sig.select("mark", "node", F.col("node").alias("comp"), "sig")
    hubs = listed(alone).mapInArrow(_by_list(_hubs), "a long, b long, gap long").groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = written(confirmed(hubs), "links")
    comp = written(components(links), "components").select(F.col("node").alias("n"), F.col("component").alias("comp"))
    of_comp = lambda frame: frame.join(comp, frame["node"] == comp["n"], "left").withColumn("comp", F.coalesce("comp", "node")).drop("n")
    pairs = with_sig.filter(F.col("use") == _PAIRS)
    if any_hot:
        sorted_hot = of_comp(hot).select("mark", "node", "comp").repartition("mark").sortWithinPartitions("mark", "comp", "node")
        crossed = written(sorted_hot.mapInArrow(_crossed(block), "mark long, members array<long>").dropDuplicates(["mark"]), "crossed")
        pairs = pairs.select("mark", "node", "sig").unionByName(crossed.select("mark", F.explode("members").alias("node")).join(nodes, "node").select("mark", "node", "sig"))
    placed = of_comp(pairs.select("mark", "node", "sig")).select("mark", "node", "comp", "sig")
    left_open = written(listed(placed).mapInArrow(_by_list(_open_nodes), "mark long, node long, slot long"), "open")
    again = left_open.join(comp, left_open["node"] == comp["n"], "left").join(nodes, "node").join(texts, "node")
    again = again.select("mark", "node", F.coalesce("comp", "node").alias("comp"), "sig", "slot", "text")
    more = listed(again).mapInArrow(_settle(size, percent), "a long, b long")
    comp = components(links.union(more))
    whole = copies.join(comp, "node", "left").select("n_shingles", "one", "two", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(whole, ["n_shingles", "one", "two"], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("doc_id"), F.lit(False)).alias("kept"))


def _repeats(texts: DataFrame) -> bool:
    return bool(texts.groupBy("node").count().filter("count > 1").head(1))
