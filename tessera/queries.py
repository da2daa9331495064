"""Registered queries over two tables that the engine builds from the given data, and their SQL.

The events table becomes a log of 30 versions, one a day: an error removes its
user's file, other events but clicks add it, a click reads it. The orders table
becomes a versioned table of rows: a version for each order year, then a remove
and an overwrite. The SQL computes the same from events and orders alone.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.invariants import names_frame
from .operators.reader import SnapshotReader
from .plans import checks, ops
from .sources.layout import VERSIONS, data_key, log_key
from .sources.log import READERS, ensure_dirs, write_log
from .table import Table

DAYS = 30
#: Versions deleted from the damaged copy of the log.
GAPS = (12, 25)
_built: dict[tuple[str, str, str], Table] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; a local one only where none is set and executors share this disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tessera-")


def _once(name: str, build: Callable[[SparkSession, str], Table]) -> Callable[[SparkSession, str], Table]:
    def get(spark: SparkSession, sf_dir: str) -> Table:
        key = (name, sf_dir, spark.sparkContext.applicationId)
        if key not in _built:
            _built[key] = build(spark, sf_dir)
        table = _built[key]
        return Table(spark, table.storage)

    return get


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return _load(spark, sf_dir, "events").select(day.cast("long").alias("version"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".parquet")).alias("file"), "event_type")


def _event_log(spark: SparkSession, sf_dir: str, repeats: bool) -> list[tuple[list[str], list[str]]]:
    """Names that each version adds and removes, with repeats or without."""
    gather = F.collect_list if repeats else F.collect_set
    added = F.when(F.col("event_type").isin("purchase", "signup", "view"), F.col("file"))
    removed = F.when(F.col("event_type") == "error", F.col("file"))
    rows = _event_names(spark, sf_dir).groupBy("version").agg(F.sort_array(gather(added)).alias("adds"), F.sort_array(gather(removed)).alias("removes"))
    found = {r["version"]: (r["adds"], r["removes"]) for r in rows.collect()}  # one row a version: the entries to write
    return [found.get(v, ([], [])) for v in range(DAYS)]


def _build_log(
    spark: SparkSession, sf_dir: str, repeats: bool = False, gaps: tuple[int, ...] = (), files: bool = False, emptied: tuple[int, ...] = (), zeroed: bool = False
) -> Table:
    """gaps: versions deleted. files: of what is added, as empty files. emptied: versions without ops. zeroed: versions that add an odd number of files also as 0<version>.json."""
    table = Table(spark, scratch(spark))
    ensure_dirs(table.storage)
    entries = _event_log(spark, sf_dir, repeats)
    for v, (adds, removes) in enumerate(entries):
        write_log(table.storage, v, *(([], []) if v in emptied else (adds, removes)))
        if zeroed and len(adds) % 2:
            table.storage.write_all_bytes(f"{VERSIONS}/0{v}.json", table.storage.read_all_bytes(log_key(v)))
    for v in gaps:
        table.storage.remove_file(log_key(v))
    if files:
        with ThreadPoolExecutor(READERS) as pool:
            list(pool.map(lambda name: table.storage.write_all_bytes(data_key(name), b""), sorted({f for adds, _ in entries for f in adds})))
    return table


events_log = _once("events", lambda spark, sf: _build_log(spark, sf, files=True))
repeated_log = _once("repeated", lambda spark, sf: _build_log(spark, sf, repeats=True))
emptied_log = _once("emptied", lambda spark, sf: _build_log(spark, sf, emptied=GAPS))
zeroed_log = _once("zeroed", lambda spark, sf: _build_log(spark, sf, zeroed=True))
gapped_log = _once("gapped", lambda spark, sf: _build_log(spark, sf, gaps=GAPS))


def _build_orders(spark: SparkSession, sf_dir: str) -> Table:
    table = Table(spark, scratch(spark))
    orders = _load(spark, sf_dir, "orders")
    files: dict[int, list[str]] = {}
    for year in range(1995, 2002):
        txn = table.transaction()
        files[year] = txn.add_dataframe(orders.where(F.year("o_orderdate") == year))
        txn.commit()
    txn = table.transaction()
    for f in files[1995]:
        txn.remove(f)
    txn.commit()
    txn = table.transaction()
    for f in files[1996]:
        txn.track_read(f)
        txn.remove(f)
    txn.add_dataframe(orders.where((F.year("o_orderdate") == 1996) & (F.col("o_orderstatus") == "F")))
    txn.commit()
    return table


orders_table = _once("orders", _build_orders)


def time_travel_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = orders_table(spark, sf_dir).reader(3).df()
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"))


def read_latest_after_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir).reader().df().groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def rows_between_v2_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir).rows_between(2, 4).select("o_orderkey")


def pinned_reader_ignores_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(spark, scratch(spark))
    orders = _load(spark, sf_dir, "orders")
    table.append(orders.where(F.year("o_orderdate") == 1995))
    pinned: SnapshotReader = table.reader()
    for year in range(1996, 2002):
        table.append(orders.where(F.year("o_orderdate") == year))
    return pinned.df().agg(F.count("*").alias("n"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_names(spark, sf_dir).where((F.col("event_type") == "click") & (F.col("version") == 20)).select("file").distinct()


def _gapped(plan: Callable[[SparkSession, DataFrame, int], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = gapped_log(spark, sf_dir)
        return plan(spark, table.checked(), table.latest_version())

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_scan": lambda s, d: ops.log_scan(events_log(s, d).log()),
    "read_logs_upto_9": lambda s, d: events_log(s, d).ops(9).select("version", "file", "act"),
    "latest_version": lambda s, d: ops.latest(events_log(s, d).log()),
    "snapshot_at_15": lambda s, d: events_log(s, d).snapshot(15),
    "snapshot_sizes": lambda s, d: ops.snapshot_sizes(events_log(s, d).ops(), 0, DAYS - 1),
    "range_refs_10_12": lambda s, d: events_log(s, d).referenced(10, 12),
    "vacuum_plan_retain_1": lambda s, d: events_log(s, d).vacuum_plan(1),
    "vacuum_plan_retain_3": lambda s, d: events_log(s, d).vacuum_plan(3),
    "occ_conflicts_base_20": lambda s, d: ops.conflicts(events_log(s, d).ops(), _reads(s, d), 20),
    "occ_first_conflict": lambda s, d: ops.first_conflict(events_log(s, d).ops(), _reads(s, d), 20),
    "missing_versions": _gapped(checks.missing_versions),
    "valid_prefix": _gapped(checks.valid_prefix),
    "truncated_versions": _gapped(checks.truncated_versions),
    "invariant_duplicate_versions": lambda s, d: checks.duplicate_versions(names_frame(s, zeroed_log(s, d).storage)),
    "invariant_determinism": lambda s, d: checks.unequal_snapshots(events_log(s, d).ops(), emptied_log(s, d).ops(), 12),
    "all_violations": lambda s, d: repeated_log(s, d).violations(),
    "invariant_dup_in_entry": lambda s, d: checks.duplicate_adds(repeated_log(s, d).ops()),
    "invariant_readds": lambda s, d: checks.readds(events_log(s, d).ops()),
    "invariant_ghost_removes": lambda s, d: checks.ghost_removes(events_log(s, d).ops()),
    "snapshot_diff_10_20": lambda s, d: events_log(s, d).diff(10, 20),
    "file_history": lambda s, d: events_log(s, d).history(),
    "snapshots_10_12": lambda s, d: events_log(s, d).snapshots(10, 12),
    "time_travel_v3": time_travel_v3,
    "read_latest_after_overwrite": read_latest_after_overwrite,
    "rows_between_v2_v4": rows_between_v2_v4,
    "pinned_reader_ignores_commits": pinned_reader_ignores_commits,
}

_OPS = """ops AS (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS version,
  'u' || CAST(user_id AS VARCHAR) || '.parquet' AS file,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS act
  FROM events WHERE event_type IN ('purchase', 'signup', 'view', 'error'))"""
_SNAP = f"""{_OPS},
vs AS (SELECT DISTINCT version AS at_version FROM ops),
st AS (SELECT at_version, file, max(version * 2 + act) AS m FROM vs JOIN ops ON ops.version <= vs.at_version GROUP BY 1, 2),
snap AS (SELECT at_version, file FROM st WHERE m % 2 = 0)"""
_PHYS = f"{_SNAP}, phys AS (SELECT DISTINCT file FROM ops WHERE act = 0)"
_READS = f"""{_OPS}, rs AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) || '.parquet' AS file
  FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-21')"""
_LEFT = f"{_OPS}, l AS (SELECT DISTINCT version FROM ops WHERE version NOT IN (12, 25))"
_PREFIX = f"{_LEFT}, r AS (SELECT version, row_number() OVER (ORDER BY version) - 1 AS rn FROM l)"

ORACLE_SQL: dict[str, str] = {
    "log_scan": f"WITH {_OPS} SELECT version, count(*) FILTER (act = 0) AS n_adds, count(*) FILTER (act = 1) AS n_removes FROM ops GROUP BY version",
    "read_logs_upto_9": f"WITH {_OPS} SELECT version, file, act FROM ops WHERE version <= 9",
    "latest_version": f"WITH {_OPS} SELECT max(version) AS latest FROM ops",
    "snapshot_at_15": f"WITH {_SNAP} SELECT file FROM snap WHERE at_version = 15",
    "snapshot_sizes": f"WITH {_SNAP} SELECT vs.at_version, count(snap.file) AS n_files FROM vs LEFT JOIN snap USING (at_version) GROUP BY 1",
    "range_refs_10_12": f"WITH {_SNAP} SELECT DISTINCT file FROM snap WHERE at_version BETWEEN 10 AND 12",
    "vacuum_plan_retain_1": f"WITH {_PHYS} SELECT file FROM phys WHERE file NOT IN (SELECT file FROM snap WHERE at_version = 29)",
    "vacuum_plan_retain_3": f"WITH {_PHYS} SELECT file FROM phys WHERE file NOT IN (SELECT file FROM snap WHERE at_version BETWEEN 27 AND 29)",
    "occ_conflicts_base_20": f"WITH {_READS} SELECT file, min(version) AS conflicting_version FROM ops JOIN rs USING (file) WHERE version > 20 GROUP BY file",
    "occ_first_conflict": f"WITH {_READS} SELECT file, version FROM ops JOIN rs USING (file) WHERE version > 20 ORDER BY version, act, file LIMIT 1",
    "missing_versions": f"WITH {_LEFT} SELECT CAST(range AS BIGINT) AS version FROM range(30) WHERE range NOT IN (SELECT version FROM l)",
    "valid_prefix": f"WITH {_PREFIX} SELECT max(version) AS valid_version FROM r WHERE rn = version",
    "truncated_versions": f"WITH {_PREFIX} SELECT version FROM l WHERE version > (SELECT max(version) FROM r WHERE rn = version)",
    "invariant_duplicate_versions": f"WITH {_OPS} SELECT version, CAST(2 AS BIGINT) AS n FROM ops WHERE act = 0 GROUP BY version HAVING count(*) % 2 = 1",
    "invariant_determinism": f"""WITH {_SNAP}, other AS (SELECT file FROM ops WHERE version <= 12 AND version NOT IN (12, 25) GROUP BY file HAVING max(version * 2 + act) % 2 = 0),
one AS (SELECT file FROM snap WHERE at_version = 12) (SELECT file FROM one EXCEPT SELECT file FROM other) UNION ALL (SELECT file FROM other EXCEPT SELECT file FROM one)""",
    "all_violations": f"""WITH {_SNAP}, many AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS version,
  'u' || CAST(user_id AS VARCHAR) || '.parquet' AS file, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS act, count(*) AS n
  FROM events WHERE event_type IN ('purchase', 'signup', 'view', 'error') GROUP BY 1, 2, 3),
was AS (SELECT m.*, s.file IS NOT NULL OR (m.act = 1 AND a.file IS NOT NULL) AS active FROM many m LEFT JOIN snap s ON s.file = m.file AND s.at_version = m.version - 1
  LEFT JOIN ops a ON a.version = m.version AND a.file = m.file AND a.act = 0)
SELECT 'no_duplicate_files' AS invariant, version, file FROM was WHERE act = 0 AND (n > 1 OR active)
UNION ALL SELECT 'no_ghost_removes' AS invariant, version, file FROM was WHERE act = 1 AND (n > 1 OR NOT active)""",
    "invariant_dup_in_entry": """WITH e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS version,
  'u' || CAST(user_id AS VARCHAR) || '.parquet' AS file FROM events WHERE event_type IN ('purchase', 'signup', 'view'))
SELECT version, file, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1""",
    "invariant_readds": f"WITH {_SNAP} SELECT o.version, o.file FROM ops o JOIN snap s ON s.file = o.file AND s.at_version = o.version - 1 WHERE o.act = 0",
    "invariant_ghost_removes": f"""WITH {_SNAP} SELECT o.version, o.file FROM ops o
LEFT JOIN snap s ON s.file = o.file AND s.at_version = o.version - 1
LEFT JOIN ops a ON a.version = o.version AND a.file = o.file AND a.act = 0
WHERE o.act = 1 AND s.file IS NULL AND a.file IS NULL""",
    "snapshot_diff_10_20": f"""WITH {_SNAP}, a AS (SELECT file FROM snap WHERE at_version = 10), b AS (SELECT file FROM snap WHERE at_version = 20)
SELECT file, 'added' AS change FROM (SELECT file FROM b EXCEPT SELECT file FROM a)
UNION ALL SELECT file, 'removed' AS change FROM (SELECT file FROM a EXCEPT SELECT file FROM b)""",
    "file_history": f"""WITH {_OPS} SELECT file, min(version) FILTER (act = 0) AS first_added, max(version) AS last_touched,
count(*) FILTER (act = 0) AS n_adds, count(*) FILTER (act = 1) AS n_removes FROM ops GROUP BY file""",
    "snapshots_10_12": f"WITH {_SNAP} SELECT at_version, file FROM snap WHERE at_version BETWEEN 10 AND 12",
    "time_travel_v3": """SELECT o_orderstatus, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi
FROM orders WHERE year(o_orderdate) <= 1998 GROUP BY 1""",
    "read_latest_after_overwrite": """SELECT o_orderstatus, count(*) AS n FROM orders
WHERE year(o_orderdate) BETWEEN 1997 AND 2001 OR (year(o_orderdate) = 1996 AND o_orderstatus = 'F') GROUP BY 1""",
    "rows_between_v2_v4": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1998, 1999)",
    "pinned_reader_ignores_commits": "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1995",
}
