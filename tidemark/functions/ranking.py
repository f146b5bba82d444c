"""Running sums and ranks over a whole table, without one task that sorts it all."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it names none, a local one if the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sums_before(df: DataFrame, order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """df with, under each name, the sum of that value over all rows that come before in the order; rows of equal order keys count in any order.

    Rows are dealt by ranges of the order; each range's sums become the next ranges' offsets, one small row a range. The rows are written first, as dealing by ranges reads them twice.
    """
    df = cut(df)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.withColumns({f"_v_{k}": v for k, v in values.items()}).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    ranges = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(ranges), F.lit(0)).alias(f"_o_{k}") for k in values])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "_p")
    return out.withColumns({k: F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)) for k in values}).select(*df.columns, *values)


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with the row's place in the order, from 1; the order must be total for the same places at each run."""
    return sums_before(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)
