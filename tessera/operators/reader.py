"""A reader pinned to one version."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import LogError, MissingVersionError
from ..sources.layout import data_key
from ..sources.log import latest_version, read_logs
from ..sources.storage import StorageBackend
from .snapshot import build_snapshot


class SnapshotReader:
    """The files of a version, resolved once: later commits do not show.

    Without a version the latest is pinned; an empty table pins -1 and has no files.
    """

    def __init__(self, storage: StorageBackend, version: int | None = None, spark: SparkSession | None = None) -> None:
        if version is not None and version < 0:
            raise MissingVersionError(version)
        self.storage = storage
        self._spark = spark
        self._pinned = latest_version(storage) if version is None else version
        self._files = tuple(build_snapshot(storage, self._pinned)) if self._pinned >= 0 else ()

    @property
    def pinned_version(self) -> int:
        return self._pinned

    @property
    def files(self) -> tuple[str, ...]:
        return self._files

    def read(self) -> tuple[str, ...]:
        """Sorted names of the active files."""
        return self._files

    def _read(self, files: tuple[str, ...], schema: StructType | str | None, merge: bool) -> DataFrame:
        if self._spark is None:
            raise LogError("the reader has no session")
        reader = self._spark.read.option("mergeSchema", merge)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            return reader.parquet(*[self.storage.uri(data_key(f)) for f in files])
        except AnalysisException as e:
            raise LogError(f"version {self._pinned} cannot be read: {e.getCondition()}") from e

    def _last_schema(self) -> StructType:
        """Of the newest files that still exist: an empty snapshot has none of its own."""
        for e in reversed(read_logs(self.storage, self._pinned) if self._pinned >= 0 else []):
            there = tuple(f for f in e.adds if self.storage.exists(data_key(f)))
            if there:
                try:
                    return self._read(there, None, False).schema
                except LogError:
                    continue
        raise LogError(f"version {self._pinned} has no file to take a schema from; pass one")

    def df(self, schema: StructType | str | None = None, merge_schema: bool = False) -> DataFrame:
        """The version's rows. One scan over the files: pruning and pushdown are Spark's own."""
        if not self._files and self._spark is not None:
            return self._spark.createDataFrame([], schema or self._last_schema())
        return self._read(self._files, schema, merge_schema)

    def create_view(self, name: str, schema: StructType | str | None = None) -> None:
        """A temporary view of the pinned version, for SQL."""
        self.df(schema).createOrReplaceTempView(name)
