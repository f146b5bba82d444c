"""Views of general test tables as position reports, incidents and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reports: users are vessels, props.k and the value give a place, a tenth of the value is the speed."""
    k = F.get_json_object("props", "$.k").cast("int")
    value, user = F.col("value"), F.col("user_id")
    far = F.lit(21.0) + F.lit(0.05) * (F.col("event_id") % 97).cast("double") + F.lit(0.01)
    near = F.lit(19.0) + F.lit(0.02) * F.floor(k / 10).cast("double") + F.lit(0.01)
    draft = F.when(user % 4 == 0, None).when(user % 4 == 1, 5.0).otherwise(F.round(value / 50, 0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        user.alias("mmsi"),
        "ts",
        F.when(value > 250, far).otherwise(near).alias("lat"),
        (F.lit(-158.0) + F.lit(0.02) * (k % 2).cast("double") + F.lit(0.01)).alias("lon"),
        (value / 10.0).alias("sog"),
        (F.lit(3.6) * k.cast("double")).alias("cog"),
        F.concat(F.lit("V"), user.cast("string")).alias("vessel_name"),
        F.concat(F.lit("C"), (user % 7).cast("string")).alias("vessel_class"),
        draft.cast("double").alias("draft"),
        "event_type",
    )


def incidents(pts: DataFrame) -> DataFrame:
    """Fast vessels' errors in six-hour buckets: incident_num, mmsi, t_start, t_end (of the bucket's reports), incident_type, evidence."""
    from tidemark.functions.core import time_bin

    errors = pts.where((F.col("event_type") == "error") & (F.col("sog") > 8)).withColumn("incident_num", time_bin("ts", 6))
    span = errors.groupBy("incident_num").agg(F.min("ts").alias("t_start"), F.max("ts").alias("t_end"))
    return (
        errors.select("incident_num", "mmsi").distinct().join(span, "incident_num")
        .select("incident_num", "mmsi", "t_start", "t_end", F.lit("error").alias("incident_type"), F.when(F.col("mmsi") % 2 == 0, "High").otherwise("Some").alias("evidence"))
    )


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as vessel cells: suppliers meet in a month and a bucket of parts."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(
        month.cast("long").alias("tbin"), (F.col("l_partkey") % 50).alias("ci"), F.lit(0).cast("long").alias("cj"), F.col("l_suppkey").alias("mmsi")
    ).agg(F.max(F.col("l_quantity") < 10).alias("stopped"), F.max(F.col("l_quantity") > 25).alias("moving"))
