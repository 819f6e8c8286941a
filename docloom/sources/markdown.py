"""Documents as Markdown with front matter, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

FIELDS = ("title", "category", "date", "confidence", "dup")
LISTS = ("tags", "parties", "langs")


def render(docs: DataFrame) -> DataFrame:
    """id and Markdown: a front matter of scalar and list fields, then the summary and notes sections."""
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)))
    items = lambda c: F.concat(F.lit(f"{c}: ["), F.array_join(T.from_semilist(F.col(c)), ", "), F.lit("]"))
    front = F.concat_ws("\n", F.lit("---"), *(line(c) for c in FIELDS), *(items(c) for c in LISTS), F.lit("---"))
    body = F.concat(F.lit("\n\n## Summary\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n## Notes\n\n"), F.coalesce("notes", F.lit("")), F.lit("\n"))
    return docs.select("id", F.concat(front, body).alias("markdown"))


def front_matter(markdown: Column) -> Column:
    return F.regexp_extract(markdown, r"(?s)\A---\n(.*?)\n---\n", 1)


def section(markdown: Column, name: str) -> Column:
    """Text under a heading up to the next one, in whatever order they stand."""
    return T.strip(F.regexp_extract(markdown, rf"(?ms)^## {name}[ \t]*\n(.*?)(?=^## |\z)", 1))


def parse(frame: DataFrame, markdown: str = "markdown") -> DataFrame:
    """The fields of Markdown documents; lists may be given in brackets, by semicolons or as one value."""
    front = front_matter(F.col(markdown))
    scalar = lambda c: F.from_json(F.concat(F.lit('{"v":'), F.nullif(F.regexp_extract(front, rf'(?m)^{c}: (".*")$', 1), F.lit("")), F.lit("}")), "v string")["v"]
    many = lambda c: T.semilist(F.split(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{c}: (.*)$", 1), r"^\[|\]$", ""), "[,;]"))
    columns = [F.coalesce(scalar(c), F.nullif(T.strip(F.regexp_extract(front, rf'(?m)^{c}: ([^"].*)$', 1)), F.lit(""))).alias(c) for c in FIELDS]
    return frame.select(*[c for c in frame.columns if c != markdown], *columns, *(many(c).alias(c) for c in LISTS), section(F.col(markdown), "Summary").alias("summary"), section(F.col(markdown), "Notes").alias("notes"))


def applied(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edited fields (by id); path, hash, size, times, original and state stay the row's own."""
    frozen = {"id", "path", "hash", "size", "modified", "digested", "original", "dup"}
    given = [c for c in edits.columns if c not in frozen]
    new = edits.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in given))
    joined = docs.join(new, docs["id"] == new["__id"], "left")
    return joined.select(*(F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in docs.columns))
