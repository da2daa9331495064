"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, at most.
BATCH_ROWS = 2000
#: The white space of the word rule [^\x20\x09-\x0D]+, as characters.
SPACES = " \t\n\x0b\f\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name.

    Other columns may be called anything, names that differ only in case
    included: positions are resolved here, not by Spark's analyzer.
    """
    cols = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in names])


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session: rows are whole texts, and 10,000 of them fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def doc_texts(df: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a documents table, null texts as empty."""
    short_batches(df.sparkSession)
    return pick(df, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once.

    A lambda's argument is a value, so unlike an aliased column it is never
    inlined back into each place that uses it.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Numbers that running() sums at once.
_BLOCK = 32


def running(numbers: str, fold: str = "ra + ry", start: str = "0L") -> str:
    """SQL for the sums (or another fold of ra and ry) of an array of longs up to each of its items.

    They are taken in blocks, so that the cost grows little faster than the length.
    """
    within = f"slice(rn, cast((ri div {_BLOCK}) * {_BLOCK} + 1 AS int), cast(ri % {_BLOCK} + 1 AS int))"
    every = f"transform(rn, (rx, ri) -> aggregate({within}, rs[ri div {_BLOCK}], (ra, ry) -> {fold}))"
    before = f"transform(rb, (rx, rc) -> aggregate(slice(rb, 1, rc), {start}, (ra, ry) -> {fold}))"
    blocks = f"transform(sequence(0, size(rn) div {_BLOCK}), rc -> aggregate(slice(rn, cast(rc * {_BLOCK} + 1 AS int), {_BLOCK}), {start}, (ra, ry) -> {fold}))"
    return let(numbers, "rn", let(blocks, "rb", let(before, "rs", every)))


def frugal(batches: Iterator) -> Iterator:
    """The batches; then gives the memory that they needed back to the system, as idle workers share it with busy ones."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and executors share its disk."""
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


#: Paths of the tables that written() made and nobody deleted.
_KEPT: list[str] = []


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system and path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back.

    Cuts lineage: a lost executor costs a read, not a recomputation. The files
    go with forget() or stage_written(), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"t-{uuid.uuid4().hex}")
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    _KEPT.append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that written() returned and nothing reads any more."""
    _delete(df.sparkSession, df.written_path)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)
    if path in _KEPT:
        _KEPT.remove(path)


def stage_written(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's result, written; deletes all that the stage wrote on its way, and docs if written() made it."""
    before = set(_KEPT)
    out = written(stage(docs))
    for path in [p for p in _KEPT if p not in before and p != out.written_path]:
        _delete(docs.sparkSession, path)
    if hasattr(docs, "written_path"):
        forget(docs)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sql(expression: str) -> Column:
    return F.expr(expression)
