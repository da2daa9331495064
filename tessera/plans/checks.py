"""Plans that check a log: gaps, the valid prefix, and the five invariants as tables of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ops import ADD, REMOVE, intervals, snapshot


def missing_versions(spark: SparkSession, present: DataFrame, latest_version: int) -> DataFrame:
    """(version): absent from 0 to latest."""
    return spark.range(latest_version + 1).select(F.col("id").alias("version")).join(present.select("version"), "version", "left_anti")


def valid_prefix(spark: SparkSession, checked: DataFrame, latest_version: int) -> DataFrame:
    """(valid_version): the last version before the first that is absent or not ok; -1 if 0 is.

    Two minima and no ordering of the whole log.
    """
    bad = missing_versions(spark, checked, latest_version).unionByName(checked.where(~F.col("ok")).select("version"))
    return bad.agg((F.coalesce(F.min("version"), F.lit(latest_version + 1)) - 1).alias("valid_version"))


def truncated_versions(spark: SparkSession, checked: DataFrame, latest_version: int) -> DataFrame:
    """(version): present after the valid prefix."""
    end = valid_prefix(spark, checked, latest_version)  # one row
    return checked.join(F.broadcast(end), F.col("version") > F.col("valid_version")).select("version")


def duplicate_versions(names: DataFrame) -> DataFrame:
    """(version, n): numbers that two names of the log folder stand for, as 1.json and 01.json."""
    number = F.regexp_extract("name", r"^(\d+)\.json$", 1)
    found = names.select(F.when(number != "", number).alias("version")).where("version IS NOT NULL")
    return found.groupBy(F.expr("try_cast(version AS bigint)").alias("version")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_adds(table: DataFrame) -> DataFrame:
    """(version, file, n): names that one entry adds more than once."""
    return table.where(F.col("act") == ADD).groupBy("version", "file").agg(F.count("*").alias("n")).where("n > 1")


def _before(table: DataFrame) -> DataFrame:
    order = Window.partitionBy("file").orderBy("version", "act", "pos")
    return table.withColumn("before", F.lag("act").over(order))


def readds(table: DataFrame) -> DataFrame:
    """(version, file): adds of a file that is active."""
    return _before(table).where((F.col("act") == ADD) & (F.col("before") == ADD)).select("version", "file")


def ghost_removes(table: DataFrame) -> DataFrame:
    """(version, file): removes of a file that is not active; adds of the same entry count."""
    gone = F.col("before").isNull() | (F.col("before") == REMOVE)
    return _before(table).where((F.col("act") == REMOVE) & gone).select("version", "file")


def unequal_snapshots(one: DataFrame, other: DataFrame, version: int) -> DataFrame:
    """(file): in one snapshot of a version but not in the other."""
    a, b = snapshot(one, version), snapshot(other, version)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def unequal_intervals(one: DataFrame, other: DataFrame) -> DataFrame:
    """(file, since, until) of one read only: equal intervals make equal snapshots at every version."""
    a, b = intervals(one), intervals(other)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def violations(spark: SparkSession, table: DataFrame, log: DataFrame, names: DataFrame, latest_version: int, again: DataFrame | None = None) -> DataFrame:
    """(invariant, version, file) of every violation; that of determinism only with again, the ops of a second read."""
    gap = missing_versions(spark, log, latest_version)
    parts = [
        ("contiguous_versions", gap.select("version", F.lit("").alias("file"))),
        ("no_duplicate_versions", duplicate_versions(names).select("version", F.lit("").alias("file"))),
        ("no_duplicate_files", duplicate_adds(table).select("version", "file")),
        ("no_duplicate_files", readds(table)),
        ("no_ghost_removes", ghost_removes(table)),
    ]
    if again is not None:
        parts.append(("deterministic_snapshot", unequal_intervals(table, again).select(F.col("since").alias("version"), "file")))
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("invariant"), "version", "file")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
