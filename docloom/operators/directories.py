"""Directories: modes, opaque subtrees, summaries and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators.queue import ancestors

#: Directory names that are never entered.
OPAQUE_NAMES = (
    ".venv", "venv", "node_modules", ".git", ".hg", ".svn", "__pycache__", "build", "dist", "target", ".gradle", ".next", ".tox",
    ".mypy_cache", ".pytest_cache", ".idea", ".vs", ".vscode", ".cache", ".ruff_cache",
)
MODE_TAGS = {"collection": "col", "bundle": "bun", "opaque": "opq", "unknown": "unk"}


def observed(paths: DataFrame) -> DataFrame:
    """Every directory above the paths, with the mode its name gives."""
    dirs = paths.filter(F.col("path").contains("/")).select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return dirs.withColumn("mode", F.when(F.lower(T.name_of(F.col("path"))).isin(*OPAQUE_NAMES), "opaque").otherwise("collection"))


def opaque_ancestors(docs: DataFrame, dirs: DataFrame) -> DataFrame:
    """id, nearest and topmost opaque directory of documents that lie under one: by mode, by name, or hidden."""
    above = docs.filter(F.col("path").contains("/")).select("id", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    marked = above.join(dirs.filter("mode = 'opaque'").select(F.col("path").alias("dir"), F.lit(True).alias("set")), "dir", "left")
    name = F.lower(T.name_of(F.col("dir")))
    hit = marked.filter(F.col("set") | name.isin(*OPAQUE_NAMES) | name.startswith("."))
    return hit.groupBy("id").agg(F.max_by("dir", "depth").alias("nearest"), F.min_by("dir", "depth").alias("topmost"))


#: Fixed patterns of names that a template makes.
TEMPLATED = (r"\d{4}-\d{2}-\d{2}", r"\d{8}_\d{6}", r"(?i)IMG_\d+", r"(?i)DSC[N]?_?\d+", r"\[(?:[^\]]+)\]_\d+_\d{4}")


def _parent(rel: str = "rel") -> Column:
    return F.when(F.col(rel).contains("/"), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")


def _kind(rel: str = "rel") -> Column:
    return F.coalesce(F.nullif(T.suffix_of(F.col(rel)), F.lit("")), F.lit("<noext>"))


def tree(files: DataFrame) -> DataFrame:
    """Every directory above the files."""
    return files.filter(F.col("rel").contains("/")).select(F.explode(ancestors(F.col("rel"))).alias("rel")).distinct()


def summary(files: DataFrame) -> DataFrame:
    """Per directory: files, sub-directories, megabytes to two places, distinct suffixes, and whether the sampled names look
    templated. Directories without files of their own count too."""
    own = files.groupBy(_parent().alias("dir")).agg(F.count("*").cast("long").alias("n_files"), F.round(F.sum("size") / 1048576, 2).alias("mb"), F.count_distinct(_kind()).cast("long").alias("n_suffixes"))
    below = tree(files).groupBy(_parent().alias("dir")).agg(F.count("*").cast("long").alias("n_dirs"))
    looks = F.lit(False)
    for p in TEMPLATED:
        looks = looks | F.col("name").rlike(p)
    made = sample_names(files).groupBy("dir").agg(F.bool_or(looks).alias("templated"))
    nothing = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return own.join(below, "dir", "full_outer").join(made, "dir", "left").select("dir", nothing("n_files", 0), nothing("n_dirs", 0), nothing("mb", 0.0), nothing("n_suffixes", 0), nothing("templated", False))


def histogram(files: DataFrame) -> DataFrame:
    """Files by directory and suffix with their place, the most frequent first, ties by suffix."""
    each = files.groupBy(_parent().alias("dir"), _kind().alias("suffix")).agg(F.count("*").cast("long").alias("n"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "suffix")).cast("long"))


def sample_names(files: DataFrame, most: int = 10) -> DataFrame:
    """Names of a directory spread over its suffixes: most // suffixes of each (one at least), in name order, suffixes in the
    order of their first names, `most` in all."""
    named = files.select(_parent().alias("dir"), _kind().alias("suffix"), T.name_of(F.col("rel")).alias("name"))
    kinds = named.groupBy("dir", "suffix").agg(F.min("name").alias("lead"))
    counted = kinds.groupBy("dir").agg(F.count("*").alias("kinds"))
    placed = named.withColumn("k", F.row_number().over(Window.partitionBy("dir", "suffix").orderBy("name"))).filter(F.col("k") <= most)
    chosen = placed.join(counted, "dir").join(kinds, ["dir", "suffix"]).filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("kinds"))))
    return chosen.withColumn("all", F.row_number().over(Window.partitionBy("dir").orderBy("lead", "name"))).filter(F.col("all") <= most).select("dir", "suffix", "name")


def prefixed(dirs: DataFrame, top: str) -> DataFrame:
    return dirs.filter(T.under(F.col("path"), top)).orderBy("path")


def upserted(dirs: DataFrame, new: DataFrame) -> DataFrame:
    """A mode that a user has set outlives automatic ones."""
    fresh = new.select("path", F.col("mode").alias("new_mode"), F.col("source").alias("new_source"))
    both = dirs.join(fresh, "path", "full_outer")
    keep = (F.col("source") == "user") & (F.coalesce("new_source", F.lit("")) != "user")
    pick = lambda c: F.when(keep | F.col(f"new_{c}").isNull(), F.col(c)).otherwise(F.col(f"new_{c}"))
    return both.select("path", pick("mode").alias("mode"), pick("source").alias("source"))


def mode_tag(mode: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in MODE_TAGS.items() for x in p)), mode), F.lit("-"))


def listing(files: DataFrame, docs: DataFrame, dirs: DataFrame, top: str) -> DataFrame:
    """What lies right in a directory: sub-directories with their mode's tag, then files marked if they have a row."""
    inside = files.filter(F.col("rel").startswith(top + "/")).select("rel", F.regexp_extract(F.substring("rel", len(top) + 2, 1 << 30), "^([^/]*)(/?)", 1).alias("name"), F.substring("rel", len(top) + 2, 1 << 30).contains("/").alias("is_dir"))
    each = inside.select(F.concat(F.lit(top + "/"), "name").alias("path"), "name", "is_dir").distinct()
    known = each.join(docs.select("path", F.lit("*").alias("row_mark")), "path", "left").join(dirs.select("path", mode_tag(F.col("mode")).alias("tag")), "path", "left")
    mark = F.when(F.col("is_dir"), F.coalesce("tag", F.lit("-"))).otherwise(F.coalesce("row_mark", F.lit(" ")))
    return known.select("name", "is_dir", mark.alias("mark")).orderBy(F.desc("is_dir"), F.lower("name"))


def fingerprint(files: DataFrame, most: int = 256) -> DataFrame:
    """dir, fingerprint and n: SHA-256 of each directory's first `most` entries, as compact JSON pairs of relative path and
    size, null for a directory. Entries come breadth first, each directory's by lower-case name; directories that are never
    entered are told, not entered.

    Of one parent's entries only the first `most` can count, and of an ancestor's levels only those before which fewer
    stand; both cuts come before the ranking."""
    every = files.select("rel", F.col("size").cast("long").alias("size"), F.lit(False).alias("is_dir")).unionByName(tree(files).select("rel", F.lit(None).cast("long").alias("size"), F.lit(True).alias("is_dir")))
    own = Window.partitionBy("parent").orderBy(F.lower(T.name_of(F.col("rel"))), "rel")
    near = every.withColumn("parent", _parent()).withColumn("k", F.row_number().over(own)).filter(F.col("k") <= most)
    each = near.filter("parent <> ''").select("rel", "size", "is_dir", F.explode(ancestors(F.col("rel"))).alias("dir"))
    inner = F.substring("rel", F.length("dir") + 2, F.length("rel"))
    each = each.select("dir", inner.alias("inner"), "size", "is_dir").withColumn("parts", F.split("inner", "/"))
    closed = F.exists(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda x: x.isin(*OPAQUE_NAMES))
    each = each.filter(~closed).withColumn("depth", F.size("parts"))
    levels = each.groupBy("dir", "depth").agg(F.count("*").alias("c"))
    above = levels.select("dir", "depth", (F.sum("c").over(Window.partitionBy("dir").orderBy("depth")) - F.col("c")).alias("above")).filter(F.col("above") < most)
    order = Window.partitionBy("dir").orderBy("depth", F.transform("parts", lambda x: F.lower(x)), "inner")
    first = each.join(above, ["dir", "depth"]).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    quoted = F.regexp_extract(F.to_json(F.array("inner")), r"(?s)^\[(.*)\]$", 1)
    pair = F.concat(F.lit("["), quoted, F.lit(","), F.coalesce(F.col("size").cast("string"), F.lit("null")), F.lit("]"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("rn", pair.alias("pair")))), lambda x: x["pair"])
    return first.groupBy("dir").agg(F.sha2(F.concat(F.lit("["), F.array_join(told, ","), F.lit("]")), 256).alias("fingerprint"), F.count("*").cast("long").alias("n"))
