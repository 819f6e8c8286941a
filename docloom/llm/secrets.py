"""Secret scans over an incremental blob ledger.

A text version is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger holds a row for each blob and rule
version that was ever scanned, with the spans found. A scan takes the distinct blobs, leaves out the pairs that the
ledger has, runs the other rules once per blob, and joins the findings back to every row that has the blob. `advance`
keeps the ledger as a table in a folder: each call scans what the folder lacks and adds it, whatever versions of texts
the rows come from, so that a history's blobs are scanned once each and a new rule version alone is run on all of them.
A call that dies leaves nothing behind or whole files; pairs that two calls both scanned are told once.

Defined results: a null text is the empty blob; repeated rows and copies share one scan and each get its findings; a
very long text is one blob and is scanned whole; an empty table gives no rows; clashing column names of the input do
no harm, as only the named columns are read and `keep` columns come back under their own names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "blob string, rule string, spans string"


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a change of pattern or test takes a new version."""

    kind: str
    version: int
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


#: Fixed patterns, the listed ones first. A run of 24 hex digits or more is the greedy run itself, so its length stands
#: in the pattern; likewise for access keys.
RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", _long_value),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def spans(text: str, rule: Rule, matcher: re.Pattern) -> str:
    """start:end of the accepted matches, in code points, comma-joined."""
    return ",".join([f"{m.start()}:{m.end()}" for m in matcher.finditer(text) if rule.accept(m)])


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {r.key: (r, re.compile(r.pattern)) for r in rules}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512).to_pydict()
                blobs, keys, found = [], [], []
                for blob, text, todo in zip(part["blob"], part["text"], part["todo"]):
                    for key in todo:
                        blobs.append(blob)
                        keys.append(key)
                        found.append(spans(text, *ready[key]))
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(keys, pa.string()), pa.array(found, pa.string())], ["blob", "rule", "spans"])

    return run


def _with_blob(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("__blob", F.sha2(text, 256))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text and todo: each distinct text once, with the rule versions that the ledger lacks for it."""
    blobs = _with_blob(docs.select("text")).select(F.col("__blob").alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    every = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: append them to the ledger and nothing is scanned twice."""
    return unseen(docs, ledger, rules).mapInArrow(_scan(rules), LEDGER)


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, None before its first scan."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def advance(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger in the folder lacks for docs, add it there, and read the whole ledger."""
    spark = docs.sparkSession
    scan(docs, ledger_at(spark, path), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of every row (default doc_id) with n_<kind> for the base kinds, base_sha256, spans and blob."""
    keep = keep or ["doc_id"]
    order = {r.key: k for k, r in enumerate(rules)}
    kinds = [r.kind for r in rules]
    base = {order[r.key] for r in rules if r.kind in BASE}
    counted = [k for k in BASE if k in kinds]

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"blob": [], **{f"n_{k}": [] for k in counted}, "base_sha256": [], "spans": []}
            for blob, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = []
                for row in rows:
                    for x in filter(None, row["spans"].split(",")):
                        start, end = map(int, x.split(":"))
                        got.append((start, order[row["rule"]], end))
                got.sort()
                say = [f"{kinds[k]}:{start}:{end}" for start, k, end in got]
                out["blob"].append(blob)
                for k in counted:
                    out[f"n_{k}"].append(sum(kinds[x[1]] == k for x in got))
                out["base_sha256"].append(hashlib.sha256(",".join(s for s, x in zip(say, got) if x[1] in base).encode()).hexdigest())
                out["spans"].append(",".join(say))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("blob", pa.string()), *((f"n_{k}", pa.int64()) for k in counted), ("base_sha256", pa.string()), ("spans", pa.string())]))

    current = ledger.filter(F.col("rule").isin(*order) & (F.col("spans") != ""))
    named = current.groupBy("blob").agg(F.collect_set(F.struct("rule", "spans")).alias("found"))
    shape = "blob string, " + "".join(f"n_{k} long, " for k in counted) + "base_sha256 string, spans string"
    per_blob = named.mapInArrow(join, shape).withColumnRenamed("blob", "__blob")
    empty = {**{f"n_{k}": F.lit(0).cast("long") for k in counted}, "base_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.lit("")}
    held = [f"__k{i}" for i in range(len(keep))]
    rows = _with_blob(docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)), "text")).drop("text")
    joined = rows.join(per_blob, "__blob", "left")
    return joined.select(*(F.col(h).alias(c) for c, h in zip(keep, held)), *(F.coalesce(c, v).alias(c) for c, v in empty.items()), F.col("__blob").alias("blob"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `found` (blob and spans, as `findings` gives them) replaced by the mark; n_chars follows
    the text. Spans meet texts by the blobs' addresses, whatever the rows are called: rows that share an id and rows
    without one are redacted by their own texts' spans."""
    @F.pandas_udf("string")
    def hide(texts, lists):
        def one(text, said):
            if not text or not said:
                return text
            at = sorted(tuple(map(int, x.split(":")[1:])) for x in said.split(","))
            out, done = [], 0
            for start, end in at:
                if end <= done:
                    continue
                if start >= done:
                    out += [text[done:start], mark]
                done = end
            return "".join(out) + text[done:]

        return pd.Series([one(t, s) for t, s in zip(texts, lists)], dtype=object)

    tag = f"__s{uuid.uuid4().hex[:8]}"
    have = found.filter("spans <> ''").groupBy("blob").agg(F.first("spans").alias(tag)).withColumnRenamed("blob", f"{tag}b")
    marked = docs.withColumn(f"{tag}k", F.sha2(F.coalesce("text", F.lit("")), 256)).join(have, F.col(f"{tag}k") == F.col(f"{tag}b"), "left")
    hit = F.col(tag).isNotNull()
    out = marked.withColumn("text", F.when(hit, hide("text", tag)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
