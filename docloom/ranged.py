"""A table by path whose changes rewrite only the files that they must: the log's entry lists the data files with the least and
largest path (lower-cased, as prefixes are) of each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions import text as T
from docloom.store import Conflict, Log


class Ranged:
    """Rows with a column `path`, in files that hold neighbouring paths. Reading a prefix opens the files that may have it; a
    change below a prefix writes the rows of those files anew, the changed ones apart from the others, and keeps all others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, f"{folder.rstrip('/')}/_log")

    def _written(self, frame: DataFrame, files: int | None) -> list[dict]:
        """frame as files of neighbouring paths (as many as the session's settings make of its size, or the number given)."""
        name = f"{self.folder}/{uuid.uuid4().hex}"
        key = F.lower("path")
        dealt = frame.repartitionByRange(files, key) if files else frame.repartitionByRange(key)
        dealt.sortWithinPartitions(key).write.parquet(name)
        ends = self.spark.read.parquet(name).groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
        return [r.asDict() for r in ends.orderBy("low").collect()]  # one row a file

    def files(self) -> list[dict]:
        """file, low, high and rows of every data file."""
        return self.log.latest()[1].get("files", [])

    def create(self, frame: DataFrame, files: int | None = None) -> None:
        number, _ = self.log.latest()
        self.log.add(number + 1, {"files": self._written(frame, files), "schema": frame.schema.json()})

    def _of(self, files: list[dict], state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*(f["file"] for f in files)) if files else self.spark.createDataFrame([], schema)

    @staticmethod
    def _met(files: list[dict], top: str) -> list[dict]:
        """Files that may have the path `top` or paths below it."""
        low = top.rstrip("/").lower()
        return [f for f in files if f["low"] is not None and f["high"] >= low and (f["low"] <= low or f["low"].startswith(low))]

    def read(self, top: str | None = None) -> DataFrame:
        """All rows, or those at or below a path."""
        state = self.log.latest()[1]
        rows = self._of(state["files"] if top is None else self._met(state["files"], top), state)
        return rows if top is None else rows.filter(T.under(F.col("path"), top))

    def change(self, top: str, make: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
        """The rows at or below `top` as `make` returns them; how many files were rewritten and how many rows they have now.
        Should another writer have come first, it is done again."""
        while True:
            number, state = self.log.latest()
            met = self._met(state["files"], top)
            if not met:
                return 0, 0
            rows = self._of(met, state)
            below = F.coalesce(T.under(F.col("path"), top), F.lit(False))
            made = [f for part in (rows.filter(~below), make(rows.filter(below)).select(*rows.columns)) for f in self._written(part, None) if f["rows"]]
            names = {f["file"] for f in met}
            try:
                self.log.add(number + 1, state | {"files": [f for f in state["files"] if f["file"] not in names] + made})
                return len(met), sum(f["rows"] for f in made)
            except Conflict:
                continue

    def move(self, source: str, target: str) -> tuple[int, int]:
        """A file or directory moved with all below it."""
        return self.change(source, lambda rows: rows.withColumn("path", T.moved(F.col("path"), source, target)))

    def drop(self, top: str) -> tuple[int, int]:
        return self.change(top, lambda rows: rows.limit(0))
