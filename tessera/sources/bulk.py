"""Long logs, parsed by the executors.

The driver's listing stays the authority on which entries exist: Spark's scan
leaves out empty files, which are corrupt entries and not absent ones. Parsing
is the same strict one. Executors read through Spark, so any store will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptedJsonError, MissingVersionError
from .layout import log_key, version_of
from .log import LOG_SCHEMA, LogEntry, versions
from .storage import StorageBackend

_SCHEMA = f"named long, error string, {LOG_SCHEMA}"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["named", "error", "version", "timestamp", "adds", "removes"]
    for batch in batches:
        rows = []
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                e = LogEntry.from_json(raw.decode())
                rows.append((version_of(name), None, e.version, e.timestamp, e.adds, e.removes))
            except (ValueError, RecursionError) as e:
                rows.append((version_of(name), str(e), None, None, None, None))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def parsed_log(spark: SparkSession, storage: StorageBackend, upto: int) -> DataFrame:
    """(named, error, version, timestamp, adds, removes) of the entries up to a version whose file is not empty."""
    paths = [storage.uri(log_key(v)) for v in versions(storage) if v <= upto]
    if not paths:
        return spark.createDataFrame([], _SCHEMA)
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(_parse, _SCHEMA)


def checked_log(spark: SparkSession, storage: StorageBackend) -> DataFrame:
    """(version, ok) of every entry that has a file."""
    present = versions(storage)
    parsed = parsed_log(spark, storage, max(present, default=-1)).select("named", (F.col("error").isNull() & (F.col("version") == F.col("named"))).alias("good"))
    every = spark.createDataFrame([(v,) for v in present], "version long")
    return every.join(parsed, every["version"] == parsed["named"], "left").select("version", F.coalesce("good", F.lit(False)).alias("ok"))


def bulk_log(spark: SparkSession, storage: StorageBackend, upto: int) -> DataFrame:
    """(version, timestamp, adds, removes) up to a version; the errors are those of read_logs()."""
    parsed = parsed_log(spark, storage, upto)
    expected = spark.range(upto + 1).select(F.col("id").alias("named"))
    bad = expected.join(parsed.where("error IS NULL").select("named"), "named", "left_anti").agg(F.min("named")).first()[0]
    if bad is not None:
        if not storage.exists(log_key(bad)):
            raise MissingVersionError(bad)
        detail = parsed.where(F.col("named") == bad).select("error").first()
        raise CorruptedJsonError(bad, detail[0] if detail else "empty")
    return parsed.select("version", "timestamp", "adds", "removes")
