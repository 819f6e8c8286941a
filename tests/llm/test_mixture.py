"""The mix: draws, permutations, and what the shards hold."""

import collections

from pyspark.sql import functions as F

from docloom.llm import mixture


def test_index_is_a_permutation_at_any_size(spark):
    key = [F.lit(1), F.lit(2)]
    for n in (1, 2, 3, 5, 16, 17, 1000):
        got = spark.range(n).select(mixture.index(F.col("id"), F.lit(n).cast("long"), key).alias("i")).collect()
        assert sorted(r["i"] for r in got) == list(range(n))
    most = 10**10
    got = [r["i"] for r in spark.range(0, most, most // 5000).select(mixture.index(F.col("id"), F.lit(most).cast("long"), key).alias("i")).collect()]
    assert len(set(got)) == len(got) and min(got) >= 0 and max(got) < most


def _docs(spark):
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(37 + 13 * (k % 7))), "abcd"[k % 4] if k % 9 else None) for k in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_counts_are_drawn_and_decide(spark):
    docs = _docs(spark)
    drawn = {}
    for seed in (1, 2):
        rows, aims, pieces, _ = mixture.plan(docs, block=8, shard=16, seed=seed)
        table = mixture.slot_table(aims, 8)
        total = round(sum(r["aim"] for r in table.collect()))
        counts = [tuple(r) for r in mixture.shard_counts(table, total, 16, seed).select("shard", "sid", "n").collect()]
        per_shard = collections.Counter()
        for shard, _, n in counts:
            per_shard[shard] += n
        assert sum(per_shard.values()) == total and set(list(per_shard.values())) <= {16, total % 16}
        drawn[seed] = sorted(counts), sorted(map(tuple, mixture.mix(docs, block=8, shard=16, seed=seed).collect()))
    assert drawn[1][0] != drawn[2][0] and drawn[1][1] != drawn[2][1]
    assert drawn[1][1] == sorted(map(tuple, mixture.mix(docs, block=8, shard=16, seed=1).collect()))


def test_slots_follow_the_counts(spark):
    docs = _docs(spark)
    _, aims, _, dealt = mixture.plan(docs, block=8, shard=16)
    table = mixture.slot_table(aims, 8)
    blocks = {r["sid"]: r["blocks"] for r in table.collect()}
    total = round(sum(r["aim"] for r in table.collect()))
    want = {(r["shard"], r["sid"]): r["n"] for r in mixture.shard_counts(table, total, 16).collect()}
    rows = dealt.collect()
    got = collections.Counter((r["shard"], r["sid"]) for r in rows)
    used = collections.defaultdict(collections.Counter)
    for r in rows:
        assert 0 <= r["block"] < blocks[r["sid"]] and r["epoch"] < 2
        used[r["sid"], r["epoch"]][r["block"]] += 1
    assert all(n == 1 for each in used.values() for n in each.values())  # a permutation each epoch
    assert all(len(used[s, 0]) == blocks[s] for s in blocks if used[s, 1])  # the second after the first
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= total - len(blocks) * 10
    assert dealt.rdd.getNumPartitions() >= 8


def test_shards_and_documents_hold_the_same_words(spark):
    docs = _docs(spark)
    taken = {r["doc_id"]: r["taken"] for r in mixture.mix(docs, block=8, shard=16).collect()}
    held = collections.Counter()
    for r in mixture.mixed_shards(docs, block=8, shard=16).collect():
        held[r["doc_id"]] += r["words"]
    assert {d: n for d, n in taken.items() if n} == held
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    words = collections.Counter()
    for r in mixture.mixed_documents(docs, block=8, shard=16).collect():
        own = r["text"].split()
        words[r["doc_id"]] += len(own)
        places = [texts[r["doc_id"]].index(w) for w in own]
        assert places == sorted(set(places))  # in the document's order, none twice in an epoch
    assert words == held


def test_clashing_columns_and_odd_white_space(spark):
    rows = [(1, "\t a\n b  c ", "x", 1, 2, 3), (2, "d", "x", 1, 2, 3), (None, None, None, None, None, None), (3, "", "x", 1, 2, 3), (1, "\t a\n b  c ", "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __key long, __size long, __row long")
    assert mixture.mix(docs, block=2).count() == 5
    made = mixture.mixed_documents(docs, block=2)
    assert made.columns == docs.columns
    assert all(r["text"] in ("a\n b  c", "a", "a\n b", "b  c", "c", "d") and r["__key"] == 1 for r in made.collect())
