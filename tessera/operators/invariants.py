"""The five invariants of a table, as plans that return violations and as assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import CorruptedJsonError, InvariantViolation, MissingVersionError
from ..plans import checks, ops
from ..sources.layout import VERSIONS
from ..sources.log import latest_version, log_frame, read_logs
from ..sources.storage import StorageBackend


def names_frame(spark: SparkSession, storage: StorageBackend) -> DataFrame:
    """(name): the file names of the log folder."""
    return spark.createDataFrame([(n,) for n in storage.list_dir_filenames(VERSIONS)], "name string")


def _raise_first(rows: DataFrame, invariant: str, what: str) -> None:
    found = rows.orderBy(*rows.columns).first()
    if found is not None:
        raise InvariantViolation(invariant, what.format(**found.asDict()))


def assert_contiguous_versions(spark: SparkSession, storage: StorageBackend) -> None:
    latest = latest_version(storage)
    if latest < 0:
        return
    try:
        entries = read_logs(storage, latest)
    except (MissingVersionError, CorruptedJsonError) as e:
        raise InvariantViolation("contiguous_versions", str(e)) from e
    for v, e in enumerate(entries):
        if e.version != v:
            raise InvariantViolation("contiguous_versions", f"{v}.json holds version {e.version}")


def assert_no_duplicate_versions(spark: SparkSession, storage: StorageBackend) -> None:
    _raise_first(checks.duplicate_versions(names_frame(spark, storage)), "no_duplicate_versions", "version {version} has {n} files")


def _table(spark: SparkSession, storage: StorageBackend, version: int) -> DataFrame:
    return ops.ops(log_frame(spark, read_logs(storage, version)))


def assert_deterministic_snapshot(spark: SparkSession, storage: StorageBackend, version: int) -> None:
    """Two reads of the log make the same snapshot."""
    differing = checks.unequal_snapshots(_table(spark, storage, version), _table(spark, storage, version), version)
    _raise_first(differing, "deterministic_snapshot", "{file} differs")


def assert_no_duplicate_files(spark: SparkSession, storage: StorageBackend, version: int) -> None:
    table = _table(spark, storage, version)
    _raise_first(checks.duplicate_adds(table), "no_duplicate_files", "version {version} adds {file} {n} times")
    _raise_first(checks.readds(table), "no_duplicate_files", "version {version} adds {file}, which is active")


def assert_no_ghost_removes(spark: SparkSession, storage: StorageBackend, version: int) -> None:
    _raise_first(checks.ghost_removes(_table(spark, storage, version)), "no_ghost_removes", "version {version} removes {file}, which is not active")


def assert_all_invariants(spark: SparkSession, storage: StorageBackend) -> None:
    """All five, with determinism at every version. An empty table has no violation."""
    latest = latest_version(storage)
    if latest < 0:
        return
    assert_contiguous_versions(spark, storage)
    assert_no_duplicate_versions(spark, storage)
    table = _table(spark, storage, latest)
    _raise_first(checks.unequal_intervals(table, _table(spark, storage, latest)), "deterministic_snapshot", "{file} differs")
    _raise_first(checks.duplicate_adds(table), "no_duplicate_files", "version {version} adds {file} {n} times")
    _raise_first(checks.readds(table), "no_duplicate_files", "version {version} adds {file}, which is active")
    _raise_first(checks.ghost_removes(table), "no_ghost_removes", "version {version} removes {file}, which is not active")
