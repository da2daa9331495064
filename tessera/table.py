"""A versioned table, its log as DataFrames, and its operators in one place."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .operators import gc, invariants, recovery
from .operators.reader import SnapshotReader
from .operators.snapshot import make_checkpoint
from .operators.transaction import Transaction
from .plans import checks, ops
from .sources.bulk import bulk_log, checked_log
from .sources.log import ensure_dirs, latest_version, log_frame, read_logs
from .sources.storage import StorageBackend, open_storage

#: Versions from which on the executors parse a log.
LONG = 1000


class Table:
    """A table by path: a local or mounted folder, or any URI that Hadoop opens."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike[str] | StorageBackend) -> None:
        self.spark = spark
        self.storage = path if isinstance(path, StorageBackend) else open_storage(spark, path)

    def create(self) -> Table:
        ensure_dirs(self.storage)
        return self

    # The log as DataFrames.

    def latest_version(self) -> int:
        return latest_version(self.storage)

    def log(self, upto: int | None = None, bulk: bool | None = None) -> DataFrame:
        """(version, timestamp, adds, removes) up to a version; strictly parsed, by the executors if the log is long (or as bulk says)."""
        end = self.latest_version() if upto is None else upto
        if bulk if bulk is not None else end >= LONG:
            return bulk_log(self.spark, self.storage, end)
        return log_frame(self.spark, read_logs(self.storage, end))

    def ops(self, upto: int | None = None) -> DataFrame:
        return ops.ops(self.log(upto))

    def snapshot(self, version: int | None = None) -> DataFrame:
        end = self.latest_version() if version is None else version
        return ops.snapshot(self.ops(end), end)

    def snapshots(self, low: int, high: int) -> DataFrame:
        return ops.snapshots(self.ops(high), low, high)

    def referenced(self, low: int, high: int) -> DataFrame:
        return ops.referenced(self.ops(high), low, high)

    def diff(self, low: int, high: int) -> DataFrame:
        return ops.diff(self.ops(max(low, high)), low, high)

    def history(self) -> DataFrame:
        return ops.history(self.ops())

    def physical(self) -> DataFrame:
        """(file): what is in data/ by name."""
        return self.spark.createDataFrame([(f,) for f in gc.physical_files(self.storage)], "file string")

    def vacuum_plan(self, retain_last_n: int = 1) -> DataFrame:
        """(file): what vacuum would delete, live intents aside."""
        return ops.vacuum_plan(self.ops(), self.physical(), self.latest_version(), retain_last_n)

    def checked(self) -> DataFrame:
        """(version, ok) of each entry's file."""
        return checked_log(self.spark, self.storage)

    def violations(self) -> DataFrame:
        """(invariant, version, file): all violations of a log that can be read; two reads of it are compared."""
        entries, again = self.log(), self.log()
        names = invariants.names_frame(self.spark, self.storage)
        return checks.violations(self.spark, ops.ops(entries), entries, names, self.latest_version(), ops.ops(again))

    # Rows.

    def reader(self, version: int | None = None) -> SnapshotReader:
        return SnapshotReader(self.storage, version, self.spark)

    def rows_between(self, low: int, high: int, schema: StructType | str | None = None) -> DataFrame:
        """Rows of the files that version high has and version low has not."""
        old, new = set(self.reader(low).files), self.reader(high)
        files = tuple(f for f in new.files if f not in old)
        if not files:
            return self.spark.createDataFrame([], schema or new.df(schema).schema)
        return new._read(files, schema, False)

    def register(self, name: str, version: int | None = None) -> None:
        """Temporary views for SQL: name for the rows, and name_log, name_ops, name_history for the log."""
        self.reader(version).create_view(name)
        self.log(version).createOrReplaceTempView(f"{name}_log")
        self.ops(version).createOrReplaceTempView(f"{name}_ops")
        ops.history(self.ops(version)).createOrReplaceTempView(f"{name}_history")

    # Changes.

    def transaction(self) -> Transaction:
        return Transaction(self.storage)

    def append(self, df: DataFrame) -> int:
        txn = self.transaction()
        txn.add_dataframe(df)
        return txn.commit()

    def overwrite(self, df: DataFrame) -> int:
        """Replaces the latest version's files; a commit that touched them in between is a conflict."""
        txn = self.transaction()
        if txn.base_version >= 0:
            for f in SnapshotReader(self.storage, txn.base_version).files:
                txn.track_read(f)
                txn.remove(f)
        txn.add_dataframe(df)
        return txn.commit()

    def checkpoint(self, version: int | None = None) -> int:
        """Writes the active files of a version beside the log, from which readers go on; the version."""
        end = self.latest_version() if version is None else version
        make_checkpoint(self.storage, end)
        return end

    def validate(self) -> int:
        return recovery.validate_log(self.storage)

    def recover(self) -> recovery.RecoveryResult:
        return recovery.recover_log(self.storage)

    def vacuum(self, retain_last_n: int = 1) -> gc.VacuumResult:
        return gc.vacuum(self.storage, retain_last_n)

    def assert_all_invariants(self) -> None:
        invariants.assert_all_invariants(self.spark, self.storage)
