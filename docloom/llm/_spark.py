"""Session helpers: shared scratch tables and Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a folder of this machine's if
    the session runs on this machine alone (tests), else an error, since executors would write to disks of their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and a lost executor costs one re-read."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this library; call it once results that read them are written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/docloom-*")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(fs_path) or []:
        fs.delete(status.getPath(), True)
