"""Mixing sources to target weights, in DataFrame functions alone.

Each source's words are packed into blocks of `block` words, documents in a pseudorandom order. Targets share a total
by weight, none over `most` times its source. Output shards hold `shard` slots each (the last one the rest). For every
shard a multinomial draw says how many of its slots each source gets: the whole part of a source's share is certain, and
the slots that the whole parts leave over are drawn one by one with the fractions as chances (residual multinomial
draws), so a source's total strays from its target by a few slots, not by the square root of their number. A source's
slots are numbered through the shards; number k stands for the place k mod blocks of epoch k div blocks, which a keyed
permutation of the source's indices, another one each epoch, maps to a block; slots and blocks are joined by that index.
Numbers from `most` times the blocks on have no block: their slots stay empty, so that no document passes its limit.

No group is a task of its own: the order within a source is found from sums over about 256 rows, in two levels; shards
are drawn independently, and their slots are numbered from sums over `NEAR` shards, in two levels too. Only the table of
sources (one row each) passes through one task, and each shard's draws read it whole.

Defined results: a null text has no words, an empty one neither; a null source is a source of its own, last in order;
repeated rows are documents each, and equal ones may swap their taken words; an empty table gives no rows; further
columns of the input, whatever their names, are ignored but for `mixed_documents`, which returns them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm._spark import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD = 4096
SEED = 17
_WORD = r"[^\x20\x09-\x0D]+"
#: Words and the white space after them, as many as a block has: possessive, so that nothing is tried twice.
_PACKED = r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,%d}+"
#: Shards whose slots are numbered together, and slots made by one task.
NEAR = 64
TASK = 1 << 18
_ROUNDS = 4


def _row_sizes(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """doc_id, the kept columns, __key (code point order, null last), __size and __h of every row of docs."""
    key = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(SEED), "doc_id", "text")
    return docs.select("doc_id", *(c.alias(name) for name, c in keep.items()), key.alias("__key"), size.alias("__size"), h.alias("__h"), F.monotonically_increasing_id().alias("__row"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source: sid, source_size, target. Pouring a total over capped vessels: those that fill first, by cap
    over weight, are full; the rest share what is left by weight, which is where repeated resharing ends."""
    each = rows.groupBy("__key").agg(F.sum("__size").alias("source_size"))
    numbered = each.withColumn("sid", F.row_number().over(Window.orderBy("__key")) - 1)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    weighed = numbered.withColumn("w", F.get(listed, F.col("sid") % len(weights))).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    everything = Window.partitionBy(F.lit(0))
    spread = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        (share * F.sum("source_size").over(everything)).alias("total"),
        F.row_number().over(order).alias("rn"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    free = F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("rn", "level"))
    settled = spread.withColumn("settled", F.min(free).over(everything)["level"])
    return settled.select("__key", "sid", "source_size", F.least("cap", F.coalesce(F.col("settled") * F.col("w"), F.col("cap"))).alias("target"))


def _offsets(rows: DataFrame, n: int) -> DataFrame:
    """rows with __at, the words of the source before each row, in the order (two hash levels, h, doc_id)."""
    k = max(1, math.isqrt(max(1, n // 256)) + 1)
    one, two = F.pmod("__h", F.lit(k)).cast("int"), F.pmod(F.shiftrightunsigned("__h", 24), F.lit(k)).cast("int")
    split = rows.withColumns({"__one": one, "__two": two})
    fine = split.groupBy("sid", "__one", "__two").agg(F.sum("__size").alias("s"))
    coarse = fine.groupBy("sid", "__one").agg(F.sum("s").alias("s"))
    before = lambda *by, order: F.sum("s").over(Window.partitionBy(*by).orderBy(order)) - F.col("s")
    top = coarse.select("sid", "__one", before("sid", order="__one").alias("a"))
    low = fine.select("sid", "__one", "__two", before("sid", "__one", order="__two").alias("b"))
    base = low.join(top.hint("merge"), ["sid", "__one"]).select("sid", "__one", "__two", (F.col("a") + F.col("b")).alias("__base"))
    own = Window.partitionBy("sid", "__one", "__two").orderBy("__h", "doc_id", "__row")
    running = split.withColumn("__own", F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    return running.join(base.hint("merge"), ["sid", "__one", "__two"]).withColumn("__at", F.col("__base") + F.col("__own"))


def block_pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each part of a document within a block: row, sid, block, word (its first within the document), words, lead
    (the room that the document's first block had for it)."""
    first, last = F.floor(F.col("__at") / block), F.floor((F.col("__at") + F.col("__size") - 1) / block)
    parts = placed.filter("__size > 0").select("__row", "sid", "__at", "__size", F.explode(F.sequence(first, last)).alias("block"))
    lead = block - F.pmod("__at", F.lit(block))
    begin = F.greatest(F.col("block") * block, F.col("__at"))
    end = F.least((F.col("block") + 1) * block, F.col("__at") + F.col("__size"))
    return parts.select("__row", "sid", "block", (begin - F.col("__at")).alias("word"), (end - begin).alias("words"), lead.alias("lead"))


def index(k: Column, blocks: Column, key: list[Column]) -> Column:
    """A permutation of [0, blocks), keyed by `key`: rounds that shift one half of the number by a hash of the other, over
    the least rectangle of sides about sqrt(blocks); what leaves [0, blocks) walks on until it is back. About one number in
    sqrt(blocks) leaves, and its walk has at most about sqrt(blocks) steps."""
    high = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    low = F.call_function("div", blocks + high - 1, high)

    def turn(x: Column) -> Column:
        halves = F.struct(F.call_function("div", x, low).alias("l"), F.pmod(x, low).alias("r"))
        for n in range(_ROUNDS):
            shift = lambda v, side: F.pmod(F.xxhash64(F.lit(n), *key, v), side)
            step = (lambda p: F.struct(F.pmod(p["l"] + shift(p["r"], high), high).alias("l"), p["r"].alias("r"))) if n % 2 == 0 else (lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + shift(p["l"], low), low).alias("r")))
            # a list of one, so that each half is worked out once
            halves = F.get(F.transform(F.array(halves), step), F.lit(0))
        return F.get(F.transform(F.array(halves), lambda p: p["l"] * low + p["r"]), F.lit(0))

    walk = lambda x: F.aggregate(F.sequence(F.lit(1).cast("long"), high * low - blocks + 1), x, lambda y, _: F.when(y < blocks, y).otherwise(turn(y)))
    return F.get(F.transform(F.array(turn(k)), lambda x: F.when(x < blocks, x).otherwise(walk(x))), F.lit(0))


def slot_table(aims: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """sid, blocks and aim (the slots that the target asks for) of every source that has words."""
    blocks = F.ceil(F.col("source_size") / block)
    aim = F.least((most * blocks).cast("double"), F.col("target") * blocks / F.col("source_size"))
    return aims.filter("source_size > 0 and target > 0").select("sid", blocks.alias("blocks"), aim.alias("aim"))


def _listed(table: DataFrame) -> DataFrame:
    """One row: the sources in order, and the sum of their aims in that order, so that reruns agree to the last bit."""
    one = table.agg(F.sort_array(F.collect_list(F.struct("sid", "blocks", "aim"))).alias("sources"))
    return one.withColumn("all", F.aggregate("sources", F.lit(0.0), lambda a, s: a + s["aim"]))


def shard_counts(table: DataFrame, slots: int, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The counts drawn for each shard: shard, sid, blocks, n."""
    shards = table.sparkSession.range(0, -(-slots // shard), 1, max(1, slots // (TASK * 16))).withColumnRenamed("id", "shard")
    size = F.least(F.lit(shard).cast("long"), F.lit(slots) - F.col("shard") * shard)
    # one row, its list as long as the sources are many, joined to all shards
    each = shards.join(F.broadcast(_listed(table))).withColumn("size", size)
    share = lambda s: F.col("size") * s["aim"] / F.col("all")
    sure = F.transform("sources", lambda s: F.struct(s["sid"].alias("sid"), s["blocks"].alias("blocks"), F.floor(share(s)).alias("n"), (share(s) - F.floor(share(s))).alias("part")))
    each = each.select("shard", "size", sure.alias("sources"))
    rest = F.col("size") - F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    parts = F.aggregate("sources", F.array().cast("array<double>"), lambda a, s: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + s["part"]))
    each = each.select("shard", "sources", rest.alias("rest"), parts.alias("upto"))
    uniform = lambda j: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("shard"), j), 11) / F.lit(float(1 << 53))
    drawn = F.when(F.col("rest") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("rest")), lambda j: F.least(F.size("upto") - 1, F.size(F.filter("upto", lambda u: u <= uniform(j) * F.element_at("upto", -1)))))).otherwise(F.array().cast("array<int>"))
    each = each.select("shard", "sources", drawn.alias("drawn"))
    counts = F.transform("sources", lambda s, k: F.struct(s["sid"].alias("sid"), s["blocks"].alias("blocks"), (s["n"] + F.size(F.filter("drawn", lambda d: d == k))).alias("n")))
    return each.select("shard", F.inline(counts)).filter("n > 0")


def slots(aims: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, most: int = MOST) -> DataFrame:
    """Every output slot: shard, slot (its place among the shard's slots of this source), sid, epoch, block."""
    table = slot_table(aims, block, most)
    total = round(_listed(table).first()["all"])
    counts = shard_counts(table, total, shard, seed).withColumn("near", F.floor(F.col("shard") / NEAR))
    above = counts.groupBy("sid", "near").agg(F.sum("n").alias("s"))
    above = above.select("sid", "near", (F.sum("s").over(Window.partitionBy("sid").orderBy("near")) - F.col("s")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("sid", "near").orderBy("shard")) - F.col("n")
    numbered = counts.withColumn("own", own).join(above.hint("merge"), ["sid", "near"])
    first = F.col("before") + F.col("own")
    dealt = numbered.select("shard", "sid", "blocks", "n", first.alias("first")).repartition(max(8, -(-total // TASK)), "shard", "sid")
    each = dealt.select("shard", "sid", "blocks", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    each = each.withColumn("k", F.col("first") + F.col("slot")).filter(F.col("k") < most * F.col("blocks"))
    epoch = F.call_function("div", F.col("k"), F.col("blocks"))
    placed = each.select("shard", "slot", "sid", "blocks", epoch.alias("epoch"), F.pmod("k", "blocks").alias("place"))
    block_of = index(F.col("place"), F.col("blocks"), [F.lit(seed), F.col("sid"), F.col("epoch")])
    return placed.select("shard", "slot", "sid", "epoch", block_of.alias("block"))


def plan(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, keep: dict[str, Column] | None = None):
    """(rows, targets, pieces, slots) of a mix. rows has docs' doc_id and the columns of `keep` and is written once, so
    that row numbers stay what they are."""
    rows = written(_row_sizes(docs, keep or {}), "mix-rows")
    aims = written(targets(rows, weights, share, most), "mix-targets")
    sized = rows.join(aims.select("__key", "sid"), "__key").select("doc_id", "sid", "__size", "__h", "__row")
    pieces = block_pieces(_offsets(sized, rows.count()), block)
    return rows, aims, pieces, slots(aims, block, shard, seed, most)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs."""
    rows, aims, pieces, dealt = plan(docs, **settings)
    used = pieces.join(dealt.groupBy("sid", "block").agg(F.count("*").alias("times")).hint("merge"), ["sid", "block"])
    taken = used.groupBy("__row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = rows.join(aims, "__key").join(taken.hint("merge"), "__row", "left")
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_shards(docs: DataFrame, **settings) -> DataFrame:
    """What each output shard holds: shard, slot, source_size, epoch, block, doc_id, word (the first one taken of the
    document) and words; a block that spans documents has a row for each."""
    rows, aims, pieces, dealt = plan(docs, **settings)
    used = dealt.join(pieces.hint("merge"), ["sid", "block"]).join(aims.select("sid", "source_size"), "sid")
    return used.join(rows.select("__row", "doc_id").hint("merge"), "__row").select("shard", "slot", "source_size", "epoch", "block", "doc_id", "word", "words")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs' columns again, a row for each document and epoch that the mix takes words of, its text those words with
    the white space after them; documents of which nothing is taken, or that have no words, have no row.

    A document's text is cut once into what its blocks hold: what its first block has of it, then a block's words each."""
    block = settings.get("block", BLOCK)
    tag = f"__c{uuid.uuid4().hex[:8]}_"
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    held = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias(tag))
    rows, _, pieces, dealt = plan(held, keep={"text": F.col("text"), tag: F.col(tag)}, **settings)
    used = pieces.join(dealt.select("sid", "block", "epoch").hint("merge"), ["sid", "block"])
    # the words before the first whole block tell all: the n-th piece begins at word lead + (n - 1) * block
    place = F.when(F.col("word") == 0, 0).otherwise(F.ceil(F.col("word") / block)).cast("int")
    lead = F.col("lead")
    spans = used.select("__row", "epoch", place.alias("n"), "lead").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("epoch", "n"))).alias("spans"), F.first("lead").alias("lead"))
    joined = rows.join(spans.hint("merge"), "__row").select("text", tag, "spans", "lead")
    head = F.regexp_substr("text", F.concat(F.lit(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,"), lead.cast("string"), F.lit("}+")))
    cut = joined.withColumn("__head", head)
    rest = F.regexp_extract_all(F.substr("text", F.length("__head") + 1), F.lit(_PACKED % block), F.lit(0))
    cut = cut.select(tag, "spans", F.concat(F.array(F.regexp_replace("__head", r"^[\x20\x09-\x0D]+", "")), rest).alias("pieces"))
    epochs = F.array_distinct(F.transform("spans", lambda s: s["epoch"]))
    each = cut.select(tag, "spans", "pieces", F.explode(epochs).alias("epoch"))
    text = F.rtrim(F.array_join(F.transform(F.filter("spans", lambda s: s["epoch"] == F.col("epoch")), lambda s: F.get("pieces", s["n"])), ""), F.lit("\t\n\x0b\x0c\r "))
    each = each.select(tag, text.alias("__text"))
    out = []
    for c in columns:
        value = F.col("__text") if c == "text" else F.length("__text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(tag)[c]
        out.append(value.alias(c))
    return each.select(*out)
