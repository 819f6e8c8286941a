"""The event journal as a Spark data source: appended in files under one log, read in batches or as a stream by event id.

An append writes a folder of Parquet files and an entry of the log with the first and last id, made in one exclusive step, so
ids have no gaps and two appenders never share one. The stream's offset is an event id; a batch is parted into ranges of
`RANGE` ids. A cursor file, if named, is where a new stream begins (none: after the last event; one that cannot be read: at
the first) and is replaced in one step after each batch; a stream that has a checkpoint follows that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docloom.operators.documents import numbered
from docloom.store import Conflict, Log

SCHEMA = "id long, ts timestamp_ntz, kind string, payload string"
RANGE = 500
NAME = "docloom_journal"


class Journal:
    """Appends to a journal's folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, f"{folder.rstrip('/')}/_log")

    def append(self, events: DataFrame) -> tuple[int, int]:
        """kind and payload, numbered on; the first and last id (last below first: there were none)."""
        name = uuid.uuid4().hex
        rows = events.select("kind", "payload").withColumn("__key", F.concat_ws(" ", "kind", "payload"))
        none = self.spark.range(1).select(F.lit(0).cast("long").alias("top"))
        own = numbered(rows, none, "__key").select("id", F.current_timestamp().cast("timestamp_ntz").alias("ts"), "kind", "payload")
        own.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.folder}/{name}")
        n = self.spark.read.parquet(f"{self.folder}/{name}").count()
        while True:
            number, state = self.log.latest()
            last = state.get("last", 0)
            if not n:
                return last + 1, last
            try:
                self.log.add(number + 1, {"name": name, "first": last + 1, "last": last + n})
                return last + 1, last + n
            except Conflict:
                continue


def _entries(where: str) -> tuple[fs.FileSystem, str, list[tuple[int, str]]]:
    system, path = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
    found = system.get_file_info(fs.FileSelector(f"{path}/_log", allow_not_found=True))
    return system, path, sorted((int(f.base_name[:12]), f.path) for f in found if len(f.base_name) == 17 and f.base_name[:12].isdigit() and f.base_name.endswith(".json"))


def _entry(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def last_id(where: str) -> int:
    """The highest id of a journal; 0 if it has none."""
    system, _, entries = _entries(where)
    return _entry(system, entries[-1][1])["last"] if entries else 0


def cursor(where: str) -> int | None:
    """What a cursor file says: None if there is none, 0 if it cannot be read."""
    system, path = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    try:
        with system.open_input_stream(path) as f:
            return int(f.read().decode().strip() or 0)
    except (OSError, ValueError):
        return 0


def move_cursor(where: str, event: int) -> None:
    """A new cursor beside the old one, then in its place."""
    system, path = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as f:
        f.write(str(event).encode())
    system.move(draft, path)


@dataclass
class Stretch(InputPartition):
    """Ids over `after` up to `last` of one append, whose own ids begin after `base`."""

    name: str
    base: int
    after: int
    last: int


def stretches(where: str, after: int, last: int) -> list[Stretch]:
    """The appends that hold ids over `after` up to `last`, in ranges. The log is read from its end."""
    system, _, entries = _entries(where)
    out = []
    for _, path in reversed(entries):
        e = _entry(system, path)
        if e["last"] <= after:
            break
        for low in range(max(e["first"] - 1, after), min(e["last"], last), RANGE):
            out.append(Stretch(e["name"], e["first"] - 1, low, min(low + RANGE, e["last"], last)))
    return sorted(out, key=lambda s: s.after)


def _rows(where: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    system, path = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/{part.name}")) if f.base_name.endswith(".parquet")]
    table = pq.read_table(files, filesystem=system, filters=[("id", ">", part.after - part.base), ("id", "<=", part.last - part.base)], columns=["id", "ts", "kind", "payload"]).sort_by("id")
    ids = pa.array([i + part.base for i in table["id"].to_pylist()], pa.int64())
    schema = pa.schema([("id", pa.int64()), ("ts", pa.timestamp("us")), ("kind", pa.string()), ("payload", pa.string())])
    yield from table.set_column(0, "id", ids).cast(schema).to_batches()


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.after = options["path"], int(options.get("after", 0))

    def partitions(self) -> Sequence[InputPartition]:
        return stretches(self.where, self.after, last_id(self.where)) or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _rows(self.where, partition) if partition.name else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.where, self.cursor, self.start = options["path"], options.get("cursor"), options.get("start", "latest")

    def initialOffset(self) -> dict:
        held = cursor(self.cursor) if self.cursor else (None if self.start == "latest" else int(self.start))
        return {"id": last_id(self.where) if held is None else held}

    def latestOffset(self) -> dict:
        return {"id": last_id(self.where)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return stretches(self.where, start["id"], end["id"])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _rows(self.where, partition)

    def commit(self, end: dict) -> None:
        if self.cursor:
            move_cursor(self.cursor, end["id"])


class JournalSource(DataSource):
    """`spark.read` or `spark.readStream.format(NAME)`. Options: path; for batches after (an id), for streams cursor (a file)
    or start (`latest` or the id before the first)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def plain(events: DataFrame) -> DataFrame:
    """events whose payload is no JSON object with an empty one."""
    good = F.try_variant_get(F.try_parse_json("payload"), F.lit("$"), "map<string,variant>").isNotNull()
    return events.withColumn("payload", F.when(good, F.col("payload")).otherwise("{}"))
