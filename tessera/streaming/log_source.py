"""Structured Streaming over a log: a version is an offset, a new entry is new rows.

    spark.dataSource.register(LogStream)
    spark.readStream.format("tessera_log").option("path", path).load()

Entries are immutable and numbered without gaps, so a batch from one offset to
the next can be read again after a failure with the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.ops import ADD, REMOVE
from ..sources.log import latest_version, parse
from ..sources.storage import local_storage

SCHEMA = "version long, timestamp long, file string, act int, pos int"


class Range(InputPartition):
    """Versions first to last, both included."""

    def __init__(self, first: int, last: int) -> None:
        self.first = first
        self.last = last


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.start = int(options.get("startingVersion", "0"))
        self.each = int(options.get("versionsPerPartition", "64"))

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        return {"next": max(self.start, latest_version(local_storage(self.path)) + 1)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(v, min(v + self.each, end["next"]) - 1) for v in range(start["next"], end["next"], self.each)]

    def read(self, partition: Range) -> Iterator[tuple]:
        storage = local_storage(self.path)
        for v in range(partition.first, partition.last + 1):
            entry = parse(storage, v)
            for act, names in ((ADD, entry.adds), (REMOVE, entry.removes)):
                for pos, name in enumerate(names):
                    yield entry.version, entry.timestamp, name, act, pos

    def commit(self, end: dict) -> None:
        pass


class LogStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogStreamReader:  # noqa: ANN001  a StructType
        return LogStreamReader(self.options)
