"""License scans against exhaustive containment."""

import random
import re

from docloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, templates, share):
    words = WORD.findall((text or "").translate(LOWER))
    labels, best = set(), 0.0
    for label, sentence in templates:
        own = sentence.split()
        size = len(set(own))
        for k in range(0, max(1, len(words)), max(1, len(own) // 2)):
            got = len(set(own) & set(words[k : k + 2 * len(own)])) / size
            if got >= share - 1e-12:
                labels.add(label)
                best = max(best, got)
    return labels, best


def test_join_finds_every_block(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["the", "of", "and"]
    templates = [(f"t{k}", " ".join(r.choice(words) for _ in range(r.randint(3, 14)))) for k in range(25)]
    rows = []
    for k in range(120):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        own = r.choice(templates)[1].split()
        if k % 3 and text:
            for _ in range(k % 4):  # words lost, put in, or on other lines
                own.insert(r.randrange(len(own) + 1), r.choice(words))
            at = r.randrange(len(text))
            text[at:at] = own
        rows.append((k, "\n".join(" ".join(text[j : j + 7]).title() for j in range(0, len(text), 7))))
    rows += [(200, None), (201, ""), (202, "\u212aERNEL THE"), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for share in (0.9, 0.6):
        got = licenses.licenses(frame, templates=licenses.template_table(spark, templates), share=share).collect()
        assert len(got) == len(rows)
        by_text = dict(rows)
        hits = 0
        for x in got:
            labels, best = brute(by_text[x["doc_id"]], templates, share)
            assert set(filter(None, x["labels"].split(","))) == labels and abs(x["score"] - best) < 1e-9
            hits += bool(labels)
        assert hits > 10


def test_no_python_and_no_text_in_a_shuffle(spark, sf):
    plan = licenses.licenses(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "MapIn" not in plan
    assert "Cartesian" not in plan
