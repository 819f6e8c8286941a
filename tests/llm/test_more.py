"""Cases beside the first tests: hot keys, audits, ledgers, letter classes, base spans and verdicts against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from docloom.llm import bpe, hnsw, lm, neardup, pii, quality, secrets


def test_hot_key_lists_are_linear():
    import pyarrow as pa

    n, block = 5000, 64
    table = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n))], ["key", "node"])
    out = pa.Table.from_batches(neardup._groups(block)([table.slice(0, 1700), table.slice(1700)])).to_pydict()
    hubs = [m for m, u in zip(out["members"], out["use"]) if u == 1]
    assert sorted(x for m, u in zip(out["members"], out["use"]) if u == 2 for x in m) == list(range(n)) and len(hubs) <= n // block + 2
    assert all(m[0] == 0 for m in hubs) and set(x for m in hubs for x in m) == set(range(n))
    comp = np.where(np.arange(n) < n - 40, 0, np.arange(n))
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(comp)], ["key", "node", "comp"])
    lists = pa.Table.from_batches(neardup._crossed(block)([rows])).to_pydict()["members"]
    assert len(lists) < 4 * (n // (block // 2)) + 20  # in proportion, not its square
    met = {(min(a, b), max(a, b)) for m in lists for a in m if comp[a] for b in m}
    assert all((x, y) in met for y in range(n - 40, n) for x in (0, 777, n - 41, n - 40) if x < y)


def test_audit_counts_nearest_points_where_no_query_has_links():
    r = np.random.default_rng(2)
    points = r.normal(size=(400, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = hnsw.Graph(points)
    assert hnsw.links_of(graph, points)[2][1] >= 0.99
    cut = hnsw.Graph(points)
    cut.layers = [(members, np.full_like(table, -1)) for members, table in cut.layers]
    _, _, (beam, recall) = hnsw.links_of(cut, points)
    assert beam == len(points) and recall == 1.0  # nothing passed on nothing: the block was compared exactly


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    shape = "doc_id long, text string"
    one = spark.createDataFrame([(1, "token = aaaaaa1"), (2, "b"), (2, "b")], shape)
    two = spark.createDataFrame([(1, "token = aaaaaa2"), (2, "b"), (3, None)], shape)
    path = f"file://{tmp_path}/ledger"
    rules = secrets.RULES[:2]
    assert secrets.advance(one, path, rules).count() == 4
    assert secrets.unseen(two, secrets.ledger_at(spark, path), rules).count() == 2
    ledger = secrets.advance(two, path, rules)
    assert ledger.count() == 8
    newer = (*rules, secrets.RULES[2])
    assert {tuple(r["todo"]) for r in secrets.unseen(one.union(two), ledger, newer).collect()} == {("hex@1",)}
    assert {r["doc_id"]: r["spans"] for r in secrets.findings(one, ledger, rules).collect()} == {1: "assign:0:15", 2: ""}


def base_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_secrets_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    hit = 0
    for r in secrets.findings(docs, secrets.scan(docs)).collect():
        want = base_secrets(texts[r["doc_id"]])
        said = ",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secrets.BASE] == [sum(x[1] == n for x in want) for n in range(3)]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        hit += bool(want)
    assert hit


def test_base_spans_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def plain(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([ -]?[0-9])+", text) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        return sorted(out)

    hit = 0
    for r in pii.find(docs).collect():
        want = plain(texts[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        hit += bool(want)
    assert hit


def test_field_agrees_with_patterns_on_documents_it_never_saw(spark, sf):
    """The field alone, over the corpus: the listed patterns' cards, addresses and mails are labels that training had not."""
    field = pii.trained()
    found = total = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = pii.base_spans(r["text"] or "")
        if base:
            own = {(a, k) for a, k, _ in pii.added_spans(r["text"], field, [])}
            total += len(base)
            found += sum((a, k) in own or (a + 1, k) in own or (a - 1, k) in own for a, k, _ in base)
    assert total > 20 and found >= 0.8 * total


def test_long_numeric_region_is_bounded():
    import tracemalloc

    text = " ".join(str(k) for k in range(2000))
    tokens = pii.tokens_of(text)
    tracemalloc.start()
    pii.trained().best(text, tokens)
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()


def test_letter_classes_are_the_matchers_own():
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    judge = tiktoken.Encoding("bytes", pat_str=public.PATTERN, mergeable_ranks=single | {b"a\xc3": 256}, special_tokens={})
    points = [*range(0x80, 0xD800, 37), *range(0xE000, 0x110000, 211), 0x105E7, 0x113A7]
    text = "\n".join(f"a{chr(c)}1 {chr(c)} a" for c in points)
    codec = bpe.Codec(single | {b"a\xc3": 256}, public.PATTERN)
    assert codec.encode(text) == judge.encode_ordinary(text)
    assert bpe.digest({b"a": 0, b"b": 1}, "x") != bpe.digest({b"a": 0, b"c": 1}, "x")


def test_remembered_pieces_take_few_bytes():
    import tracemalloc

    import pyarrow as pa

    codec = bpe.Codec({bytes([b]): b for b in range(256)}, bpe.PATTERN)
    codec.encode("warm up")
    text = " ".join(f"x{k:05d}" for k in range(20000))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    got = codec.encode(text)
    assert bytes(got) == text.encode()
    del got
    took = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert took < 100 * 20002, took  # as Python's objects each took some 200


def test_pieces_are_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "JUDGED", 20)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cab": 257, b"abc": 258, b" a": 259}
    codec, whole = bpe.Codec(ranks, bpe.PATTERN), bpe.Codec(ranks, bpe.PATTERN)
    for k in range(40):
        text = " ".join(f"cab{'abc' * (j % 7)}{k % 5}{j}" for j in range(k, k + 9)) + " a"
        assert codec.encode(text) == [i for s in re.findall(r" ?[a-z]+| ?[0-9]+", text) for i in whole.encode_piece(s.encode())]
        assert len(codec.keys) < 90


def test_quality_verdicts_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ratio = quality.fit(docs, labels)
    limit = quality.threshold(docs, labels, ratio)
    got = quality.quality(docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= limit) for r in got)
    sides = {r["doc_id"]: r for r in quality.labelled(labels).collect()}
    held = [r["score"] for r in got if r["doc_id"] in sides and sides[r["doc_id"]]["held_out"] and sides[r["doc_id"]]["good"] and not r["base_failed"]]
    assert sum(x >= limit for x in held) >= (1 - quality.TAIL) * len(held) - 1


def test_quality_takes_every_label(spark):
    labels = spark.range(25000).selectExpr("id doc_id", "cast(id % 2 as int) quality", "0 toxic")
    assert quality.labelled(labels).count() == 25000
    # one trusted text of many labels, chosen so that a sample by hash would leave it out
    last = labels.filter("quality = 1").selectExpr("doc_id", "xxhash64(doc_id) h", "pmod(xxhash64('half', doc_id), 2) half").filter("half = 0").orderBy("h", ascending=False).first()["doc_id"]
    docs = spark.createDataFrame([(last, "rare words here"), (-1, "other words there")], "doc_id long, text string")
    assert quality.fit(docs, labels).any()


def test_quality_takes_one_python_worker_a_task(spark, sf):
    """A batch filter before a mapper in one stage holds two workers at once for every core."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList()
    plans = [ran.apply(k).physicalPlanDescription() for k in range(before, ran.size())]
    assert any("MapInArrow" in p for p in plans) and not any("ArrowEvalPython" in p for p in plans)


def test_quality_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 5)
    monkeypatch.setattr(quality, "BINS", 3)
    rng = np.random.default_rng(9)
    scores = np.concatenate([rng.normal(-1, 1, 60), np.full(30, -0.5), [9e9]])
    held = spark.createDataFrame([(float(x),) for x in scores], "score double").cache()
    for q in (0.005, 0.5):
        assert quality._quantile(held, len(scores), q) == pytest.approx(np.quantile(scores, q), abs=1e-12)


def test_pair_probabilities_sum_to_about_one():
    """Over all words after a word, from counts read back at their levels: within the quantisation's factor."""
    r = np.random.default_rng(1)
    counts = collections.Counter(int(x) for x in r.zipf(1.6, 4000) if x < 400)
    read = lambda n: float(lm.level_count(lm.levels(np.array([n])))[0])
    before = sum(counts.values())
    total = sum(min(read(n), read(before)) / read(before) for n in counts.values())
    assert 1 / (math.sqrt(2) * 1.42) <= total <= math.sqrt(2) * 1.42


def test_points_without_links_in_are_found():
    """2,000 queries, of which 15 are near copies of late points that no other point links to."""
    rng = np.random.default_rng(8)
    points = rng.normal(0, 1, (4000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    graph = hnsw.Graph(points)
    lost = np.arange(3900, 3915)
    for members, table in graph.layers:
        table[np.isin(table, np.searchsorted(members, lost[np.isin(lost, members)]))] = -1
    queries = rng.normal(0, 1, (2000, 16))
    queries[100:115] = points[lost] + rng.normal(0, 0.005, (15, 16))
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    assert set(lost) <= set(graph.apart().tolist())
    left, right, _ = hnsw.links_of(graph, queries)
    truth = set(zip(*(x.tolist() for x in np.nonzero(queries @ points.T >= hnsw.COSINE)), strict=True))
    found = list(zip(left.tolist(), right.tolist(), strict=True))
    assert len(truth) >= 15 and set(found) == truth and len(found) == len(truth)


def test_a_full_neighbourhood_hides_no_point():
    rng = np.random.default_rng(9)
    center = rng.normal(0, 1, 16)
    tight = center + rng.normal(0, 0.01, (3000, 16))
    late = center + rng.normal(0, 0.12, (60, 16))
    points = np.concatenate([rng.normal(0, 1, (900, 16)), tight, late])
    points /= np.linalg.norm(points, axis=1)[:, None]
    left, right, _ = hnsw.links_of(hnsw.Graph(points), points[-60:])
    truth = points[-60:] @ points.T >= hnsw.COSINE
    assert len(left) >= 0.99 * truth.sum() and truth[left, right].all() and len(set(zip(left.tolist(), right.tolist(), strict=True))) == len(left)
