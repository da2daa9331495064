"""The ops table (version, file, act, pos) and the plans over it.

act is 0 for an add and 1 for a remove. Within a version removes come after
adds, so a file is active at V if its last op up to V, by (version, act), is an
add. ``intervals`` states that once for all versions: from it snapshots, unions
of snapshots and their sizes are range filters, without replaying the log once
a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = 0, 1
#: The end of an interval that no later op closes.
OPEN = 2**63 - 1


def ops(log: DataFrame) -> DataFrame:
    """One row for each name in adds and removes, in list order and with repeats."""

    def side(column: str, act: int) -> DataFrame:
        return log.select("version", F.posexplode(column).alias("pos", "file"), F.lit(act).alias("act"))

    return side("adds", ADD).unionByName(side("removes", REMOVE)).select("version", "file", "act", "pos")


def log_scan(log: DataFrame) -> DataFrame:
    """(version, n_adds, n_removes) of each entry."""
    return log.select("version", F.size("adds").cast("long").alias("n_adds"), F.size("removes").cast("long").alias("n_removes"))


def latest(log: DataFrame) -> DataFrame:
    """(latest): the greatest version, -1 of an empty log."""
    return log.agg(F.coalesce(F.max("version"), F.lit(-1)).alias("latest"))


def snapshot(table: DataFrame, version: int) -> DataFrame:
    """(file): active at a version. One partial aggregate and one shuffle of the files' last ops."""
    last = table.where(F.col("version") <= version).groupBy("file").agg(F.max(F.struct("version", "act")).alias("last"))
    return last.where(F.col("last.act") == ADD).select("file")


def intervals(table: DataFrame) -> DataFrame:
    """(file, since, until): active from version since on, and no more at until."""
    state = table.groupBy("file", "version").agg(F.max("act").alias("act"))
    after = F.lead("version", 1, OPEN).over(Window.partitionBy("file").orderBy("version"))
    return state.withColumn("until", after).where(F.col("act") == ADD).select("file", F.col("version").alias("since"), "until")


def referenced(table: DataFrame, low: int, high: int) -> DataFrame:
    """(file): active at some version from low to high; none if the range is inverted."""
    if low > high:
        return table.select("file").where(F.lit(False))
    return intervals(table).where((F.col("since") <= high) & (F.col("until") > low)).select("file").distinct()


def snapshots(table: DataFrame, low: int, high: int) -> DataFrame:
    """(at_version, file) for each version of the range."""
    inside = intervals(table).where((F.col("since") <= high) & (F.col("until") > low)) if low <= high else intervals(table).where(F.lit(False))
    each = F.sequence(F.greatest("since", F.lit(low)), F.least(F.col("until") - 1, F.lit(high)))
    return inside.select(F.explode(each).alias("at_version"), "file")


def snapshot_sizes(table: DataFrame, low: int, high: int) -> DataFrame:
    """(at_version, n_files) of each version of the range, empty snapshots included.

    Sums of changes, not of files: an interval is +1 where it begins and -1 where
    it ends, so a long-lived file is two rows and not one a version. The running
    sum is over one row a version.
    """
    spark = table.sparkSession
    live = intervals(table)
    change = live.select(F.greatest("since", F.lit(low)).alias("v"), "until").where((F.col("until") > F.col("v")) & (F.col("v") <= high))
    change = change.select(F.explode(F.array(F.struct(F.col("v"), F.lit(1).alias("n")), F.struct(F.col("until").alias("v"), F.lit(-1).alias("n")))).alias("c")).select("c.v", "c.n")
    by_version = change.where(F.col("v") <= high).groupBy("v").agg(F.sum("n").alias("n"))
    every = spark.range(low, high + 1).select(F.col("id").alias("at_version"))
    joined = every.join(by_version, F.col("at_version") == F.col("v"), "left").select("at_version", F.coalesce("n", F.lit(0)).alias("n"))
    running = F.sum("n").over(Window.orderBy("at_version").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("at_version", running.cast("long").alias("n_files"))


def diff(table: DataFrame, low: int, high: int) -> DataFrame:
    """(file, change): 'added' or 'removed' from snapshot low to snapshot high."""
    live = intervals(table)
    was = (F.col("since") <= low) & (F.col("until") > low)
    now = (F.col("since") <= high) & (F.col("until") > high)
    state = live.where(was | now).groupBy("file").agg(F.max(was.cast("int")).alias("was"), F.max(now.cast("int")).alias("now"))
    return state.where("was <> now").select("file", F.when(F.col("now") == 1, "added").otherwise("removed").alias("change"))


def history(table: DataFrame) -> DataFrame:
    """(file, first_added, last_touched, n_adds, n_removes)."""
    added = F.col("act") == ADD
    return table.groupBy("file").agg(
        F.min(F.when(added, F.col("version"))).alias("first_added"), F.max("version").alias("last_touched"),
        F.count_if(added).alias("n_adds"), F.count_if(~added).alias("n_removes"),
    )


def conflicts(table: DataFrame, reads: DataFrame, base: int) -> DataFrame:
    """(file, conflicting_version): files read that a version after base adds or removes, with the first that does."""
    touched = table.where(F.col("version") > base).join(reads.select("file").distinct(), "file", "left_semi")
    return touched.groupBy("file").agg(F.min("version").alias("conflicting_version"))


def first_conflict(table: DataFrame, reads: DataFrame, base: int) -> DataFrame:
    """(file, version): the conflict that a commit reports, by version, adds before removes, in list order."""
    touched = table.where(F.col("version") > base).join(reads.select("file").distinct(), "file", "left_semi")
    return touched.orderBy("version", "act", "pos").limit(1).select("file", "version")


def vacuum_plan(table: DataFrame, physical: DataFrame, latest_version: int, retain_last_n: int) -> DataFrame:
    """(file): physical files that none of the retained versions references."""
    low = max(0, latest_version - max(1, retain_last_n) + 1)
    return physical.select("file").join(referenced(table, low, latest_version), "file", "left_anti")
