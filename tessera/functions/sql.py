"""Table functions for SQL: SELECT * FROM table_snapshot('/path', 3).

Metadata only, read where the function runs: the path must be one that every
executor can open. Rows of a version are read through Table.register().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.snapshot import active_files
from ..sources.log import latest_version, read_logs
from ..sources.storage import local_storage


@udtf(returnType="version long, timestamp long, n_adds long, n_removes long")
class TableVersions:
    """The entries of a table's log."""

    def eval(self, path: str) -> Iterator[tuple]:
        storage = local_storage(path)
        for e in read_logs(storage, latest_version(storage)):
            yield e.version, e.timestamp, len(e.adds), len(e.removes)


@udtf(returnType="file string")
class TableSnapshot:
    """The active files of a version; of a negative one, the latest."""

    def eval(self, path: str, version: int) -> Iterator[tuple]:
        storage = local_storage(path)
        end = latest_version(storage) if version < 0 else version
        for f in active_files(read_logs(storage, end)):
            yield (f,)


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("table_versions", TableVersions)
    spark.udtf.register("table_snapshot", TableSnapshot)
