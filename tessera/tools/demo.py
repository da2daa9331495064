"""python -m tessera.tools.demo: isolation, conflict, recovery, and time travel with vacuum, on rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import ConflictError
from ..sources.layout import log_key
from ..table import Table


def isolation(spark: SparkSession, path: str) -> list[int]:
    """A pinned reader's count before and after a commit, and a new reader's."""
    table = Table(spark, path)
    table.append(spark.range(10))
    pinned = table.reader()
    before = pinned.df().count()
    table.append(spark.range(5))
    return [before, pinned.df().count(), table.reader().df().count()]


def conflict(spark: SparkSession, path: str) -> str:
    """What the second of two writers on one base is told."""
    table = Table(spark, path)
    table.append(spark.range(1))
    one, two = table.transaction(), table.transaction()
    one.add("one.parquet")
    one.commit()
    two.add("two.parquet")
    try:
        two.commit()
    except ConflictError as e:
        return str(e)
    return "no conflict"


def recovery(spark: SparkSession, path: str) -> list[int]:
    """The valid version after the last entry was damaged, and the versions cut off."""
    table = Table(spark, path)
    for n in range(3):
        table.append(spark.range(n + 1))
    table.storage.write_all_text(log_key(2), "{ damaged")
    done = table.recover()
    return [done.valid_version, *done.truncated_versions]


def time_travel(spark: SparkSession, path: str) -> list[int]:
    """Counts at versions 0 to 2 of a table that was overwritten, and the files a vacuum of 2 deletes."""
    table = Table(spark, path)
    table.append(spark.range(3))
    table.append(spark.range(4))
    table.overwrite(spark.range(100))
    counts = [table.reader(v).df().count() for v in range(3)]
    table.overwrite(spark.range(200))
    return [*counts, len(table.vacuum(2).deleted_files)]


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    for show in (isolation, conflict, recovery, time_travel):
        with tempfile.TemporaryDirectory() as path:
            print(f"{show.__name__}: {show(spark, path)}")


if __name__ == "__main__":
    main()
