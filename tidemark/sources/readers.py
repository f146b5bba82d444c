"""Readers and writers of point tables and small tables, and column reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import CONCEPTS, TrackConfig

POINT_COLUMNS = {
    "MMSI": ("mmsi", "long"),
    "datetime_utc": ("ts", "timestamp"),
    "lat": ("lat", "double"),
    "lon": ("lon", "double"),
    "speed_over_ground_knots": ("sog", "double"),
    "course_over_ground_deg": ("cog", "double"),
    "heading_deg": ("heading", "double"),
    "vessel_name": ("vessel_name", "string"),
    "vessel_class": ("vessel_class", "string"),
    "draft_depth_m": ("draft", "double"),
    "status": ("status", "string"),
}
INCIDENT_COLUMNS = {
    "incident_num": ("incident_num", "long"),
    "MMSI": ("mmsi", "long"),
    "ais_incident_start_bound_hst": ("t_start", "timestamp"),
    "ais_incident_end_bound_hst": ("t_end", "timestamp"),
    "ais_incident_type": ("incident_type", "string"),
    "ais_incident_evidence": ("evidence", "string"),
    "report_based_incident_description": ("description", "string"),
}


def read_csv(spark: SparkSession, path: str | list[str], columns: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """CSV with a header; doubled quotes are quotes. With columns, those the files have, typed leniently: what doesn't parse is null."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df if columns is None else typed(df, columns)


def typed(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Those of columns that df has, renamed and typed leniently: what doesn't parse is null."""
    there = {c.strip().lstrip("﻿"): c for c in df.columns}

    def one(source: str, kind: str):
        c = F.col(f"`{there[source]}`")
        return F.try_to_timestamp(c) if kind == "timestamp" else c.try_cast(kind)

    return df.select(*[one(s, kind).alias(name) for s, (name, kind) in columns.items() if s in there])


def clean_points(df: DataFrame, profile: str = "network", c: TrackConfig = TrackConfig()) -> DataFrame:
    """Rows with vessel, time and place. Profile `features` also keeps places on Earth only and nulls unavailable headings."""
    df = df.na.drop(subset=["mmsi", "ts", "lat", "lon"])
    if profile == "features":
        df = df.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
        if "heading" in df.columns:
            df = df.withColumn("heading", F.when(F.col("heading") != c.heading_unavailable, F.col("heading")))
    elif profile != "network":
        raise ValueError(f"profile {profile!r}: network or features")
    return df


def read_points(spark: SparkSession, path: str | list[str], profile: str = "network") -> DataFrame:
    return clean_points(read_csv(spark, path, POINT_COLUMNS), profile)


def read_incidents(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """Times are taken as UTC, or with zone as that zone's."""
    df = read_csv(spark, path, INCIDENT_COLUMNS)
    return df if zone is None else df.withColumns({t: F.to_utc_timestamp(t, zone) for t in ("t_start", "t_end")})


def load_generic(df: DataFrame) -> DataFrame:
    """Any position table: trimmed column names, the time column by its name, real places, one row a vessel and time (the least by all columns)."""
    df = df.toDF(*[c.strip() for c in df.columns])
    time = next((c for c in df.columns if c.lower() in ("basedatetime", "timestamp", "time")), None)
    if time is None:
        raise ValueError("no time column: basedatetime, timestamp or time")
    by_low = {c.lower(): c for c in df.columns}
    lat, lon, vessel = (F.col(by_low[k]) for k in ("lat", "lon", "mmsi"))
    df = df.withColumn(time, F.try_to_timestamp(F.col(time).cast("string")))
    df = df.where(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)))
    first = Window.partitionBy(vessel, F.col(time)).orderBy(*[F.col(c) for c in df.columns])
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def write_csv(df: DataFrame, path: str) -> None:
    exact = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("timestampFormat", exact).option("timestampNTZFormat", exact).csv(path)


def schema_report(df: DataFrame) -> DataFrame:
    """One row: whether there is a draft column, which, the concepts that no column's name fits, and all columns; as JSON too."""
    low = [c.lower() for c in df.columns]
    drafts = [c for c, x in zip(df.columns, low) if any(a in x for a in CONCEPTS["draft"])]
    missing = [k for k, names in CONCEPTS.items() if not any(a in x for a in names for x in low)]
    schema = T.StructType([
        T.StructField("has_draft", T.BooleanType()),
        T.StructField("draft_columns", T.ArrayType(T.StringType())),
        T.StructField("missing_expected", T.ArrayType(T.StringType())),
        T.StructField("columns", T.ArrayType(T.StringType())),
    ])
    out = df.sparkSession.createDataFrame([(bool(drafts), drafts, missing, df.columns)], schema)
    return out.withColumn("json", F.to_json(F.struct("*")))
