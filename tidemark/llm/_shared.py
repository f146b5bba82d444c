"""Shared storage of intermediate tables, in the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one is made if the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, so that no later job repeats its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; columnar, so later reads prune columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches; then unused memory goes back to the system, as Python workers are kept for other tasks."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


class Scratch:
    """Tables that one operator writes for itself; they are deleted when its result is written, or, in a with statement, also when it fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back; everything staged before is deleted."""
        out = stage(df, name)
        self.clear()
        return out

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions by the size of df's input: each gets about bytes_each of it, and never fewer than the session's setting."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-size // bytes_each)) if size < 1 << 60 else least)
