"""Walk a directory tree level by level: executors list the directories of a level, and closed ones are never listed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.directories import OPAQUE_NAMES
from docloom.session import stored

SHAPE = "dir string, name string, is_dir boolean, size long, mtime timestamp"
FILES = "rel string, dir string, name string, size long, mtime timestamp"
#: Directories that one task lists.
LISTED = 64
Lister = Callable[[str, str], Iterable[tuple[str, bool, int, object]]]


def listed(root: str, rel: str) -> Iterator[tuple[str, bool, int, object]]:
    """name, is_dir, size and time of a directory's entries, by Arrow's file systems; a directory that cannot be read has none."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
    try:
        found = system.get_file_info(fs.FileSelector(f"{path}/{rel}".rstrip("/")))
    except OSError:
        return
    for f in found:
        if f.type in (fs.FileType.Directory, fs.FileType.File):
            yield f.base_name, f.type == fs.FileType.Directory, f.size or 0, f.mtime


def walk(spark: SparkSession, root: str, dirs: DataFrame | None = None, lister: Lister = listed) -> DataFrame:
    """rel, dir, name, size and mtime of the files below root but dot files. Directories that are hidden, have a closed name,
    or are opaque by mode in `dirs` (path, relative to root) are not entered; root itself is, whatever its name. Each
    level's listing is written, as the next level and the result are made of it; the driver learns whether there is a next."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rel in frame["rel"]:
                rows = [(rel, *entry) for entry in lister(root, rel)]
                yield pd.DataFrame(rows, columns=["dir", "name", "is_dir", "size", "mtime"]).assign(mtime=lambda d: pd.to_datetime(d["mtime"], utc=True))

    files, frontier, n = spark.createDataFrame([], FILES), spark.createDataFrame([("",)], "rel string"), 1
    rel = F.concat(F.when(F.col("dir") != "", F.concat("dir", F.lit("/"))).otherwise(""), "name")
    while n:
        level = stored(frontier.repartition(-(-n // LISTED)).mapInPandas(run, SHAPE).withColumn("rel", rel), "level")
        files = files.unionByName(level.filter(~F.col("is_dir") & ~F.col("name").startswith(".")).select(*files.columns))
        frontier = level.filter(F.col("is_dir") & ~F.col("name").startswith(".") & ~F.lower("name").isin(*OPAQUE_NAMES)).select("rel")
        if dirs is not None:
            frontier = frontier.join(dirs.filter("mode = 'opaque'").select(F.col("path").alias("rel")), "rel", "left_anti")
        n = frontier.count()
    return files


def in_order(files: DataFrame) -> DataFrame:
    """A directory's files before those of its directories, both by name, whatever its case."""
    return files.orderBy(F.transform(F.filter(F.split("dir", "/"), lambda d: d != ""), lambda d: F.lower(d)), F.lower("name"), "name")
