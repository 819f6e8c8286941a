"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and encoding, one stage after the other.

Each stage takes what its predecessor wrote, with the columns of documents, and acts on its own operator's decisions:
rejected documents go, one document of each near-duplicate group stays, secrets give way to a mark, the mix takes words
of some documents twice and of others not at all, and the last stage encodes what is left.

Defined results, for every stage: an empty table gives no rows; further columns, whatever their names, are returned as
they are by all stages but the last, which returns doc_id and source beside the ids. A null or empty text, and one of
white space, fails the quality rules; the later stages alone keep such rows (near-duplicates: once for each doc_id and
text), have nothing to hide in them, take no words of them, and encode them as no tokens. Repeated rows are documents
each, of which the near-duplicate stage keeps one; rows without doc_id or sharing one are documents of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixture, neardup, quality, secrets
from docloom.llm._spark import scratch_dir, written
from docloom.session import ship_package


#: Words of a shingle in the near-duplicate stage, at a similarity of 0.8.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    columns = docs.columns
    judged = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=columns)
    return judged.filter("kept").select(*columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of texts that share 80 % of their five-word shingles; repeated
    rows of it once.

    Rows are compared under numbers of their own, so that different texts of one doc_id are different documents and rows
    without doc_id take part, after those that have one. Texts without words link with nothing: rows of them stay, those
    of one doc_id and text once."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    alike = neardup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), size=SHINGLE)
    alike = alike.select(F.col("doc_id").alias("__row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("__group"))
    bare = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text"))
    named = alike.join(rows.select("__row", "doc_id", bare.alias("__bare")), "__row")
    alone = F.col("__group").isNull()
    own = F.when(alone, F.col("doc_id")), F.when(alone, F.col("__bare")), F.when(alone & F.col("doc_id").isNull(), F.col("__row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row").alias("row")))
    kept = named.groupBy("__group", *(c.alias(f"__own{k}") for k, c in enumerate(own))).agg(first.alias("first"))
    return rows.join(kept.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark; spans meet texts by the texts' addresses, whatever the doc_id."""
    ledger = secrets.advance(docs, f"{scratch_dir(spark)}/docloom-ledger-{uuid.uuid4().hex}")
    return secrets.redacted(docs, secrets.findings(docs, ledger)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and epoch, its text the words taken."""
    return mixture.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the checksums of the ids and of the decoded bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
#: SQL cannot express the fitted rules, the mix's permutations or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's result written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/docloom-stage-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
