"""Tracks: voyages by time gaps, their kinematics, coverage, signal gaps, drafts, and the joined feature table.

Points are (mmsi, ts, lat, lon, sog, cog, vessel_name, vessel_class, draft); rows of one vessel and time are ordered by place.
Everything per vessel is one window over (mmsi; ts), which one shuffle on mmsi serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TrackConfig
from tidemark.functions.core import HOUR_US, above, below, cell, micros, wrapped_degrees


def track() -> Window:
    return Window.partitionBy("mmsi").orderBy("ts", "lat", "lon", "sog")


def split_voyages(points: DataFrame, c: TrackConfig = TrackConfig()) -> DataFrame:
    """points with gap_hours, voyage_seq from 1 and voyage_id. A voyage ends at a gap of more than voyage_gap_hours; a gap of just that continues it."""
    w = track()
    gap = (micros("ts") - F.lag(micros("ts")).over(w)) / F.lit(HOUR_US)
    df = points.withColumn("gap_hours", gap)
    new = F.when(F.col("gap_hours").isNull() | (F.col("gap_hours") > c.voyage_gap_hours), 1).otherwise(0)
    df = df.withColumn("voyage_seq", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return df.withColumn("voyage_id", F.concat_ws("_", F.col("mmsi").cast("string"), F.col("voyage_seq").cast("string")))


def kinematics(voyages: DataFrame, c: TrackConfig = TrackConfig()) -> DataFrame:
    """One row a voyage_id. Name and class are the earliest that aren't null; std_sog is the sample deviation, null for one point; a missing speed counts as not stopped."""
    return voyages.groupBy("voyage_id").agg(*kinematic_columns(c))


def kinematic_columns(c: TrackConfig) -> list[Column]:
    at = F.struct("ts", "lat", "lon", "sog")
    edge = lambda name, f: f(F.col(name), at)
    known = lambda name: F.min_by(F.col(name), F.when(F.col(name).isNotNull(), at))
    return [
        F.first("mmsi").alias("mmsi"),
        known("vessel_name").alias("vessel_name"),
        known("vessel_class").alias("vessel_class"),
        F.min("ts").alias("t_start"),
        F.max("ts").alias("t_end"),
        F.count("*").alias("n_points"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / F.lit(HOUR_US)).alias("duration_hours"),
        F.avg("sog").alias("avg_sog"),
        F.stddev_samp("sog").alias("std_sog"),
        F.max("sog").alias("max_sog"),
        edge("lat", F.min_by).alias("lat_start"),
        edge("lon", F.min_by).alias("lon_start"),
        edge("lat", F.max_by).alias("lat_end"),
        edge("lon", F.max_by).alias("lon_end"),
        F.avg(below("sog", c.stopped_sog).cast("double")).alias("stopped_ratio"),
    ]


def course_spread(voyages: DataFrame) -> DataFrame:
    """voyage_id, course_std: sample deviation of course changes between points that follow each other; a missing course takes both its changes away."""
    w = Window.partitionBy("voyage_id").orderBy("ts", "lat", "lon", "sog")
    turns = voyages.withColumn("turn", wrapped_degrees(F.col("cog") - F.lag("cog").over(w)))
    return turns.groupBy("voyage_id").agg(F.stddev_samp("turn").alias("course_std"))


def coverage_grid(points: DataFrame, c: TrackConfig = TrackConfig()) -> DataFrame:
    """One row a grid cell (ci, cj): n_points, n_vessels, n_days, coverage_ok.

    Distinct vessels and days are counted from one partial aggregate by (cell, vessel, day), so points are shuffled once, combined.
    """
    day = F.to_date("ts")
    fine = points.groupBy(cell("lat", c.grid).alias("ci"), cell("lon", c.grid).alias("cj"), "mmsi", day.alias("day")).agg(F.count("*").alias("n"))
    out = fine.groupBy("ci", "cj").agg(F.sum("n").alias("n_points"), F.count_distinct("mmsi").alias("n_vessels"), F.count_distinct("day").alias("n_days"))
    return out.withColumn("coverage_ok", (F.col("n_vessels") >= c.cover_vessels) & (F.col("n_days") >= c.cover_days))


def signal_gaps(voyages: DataFrame, coverage: DataFrame, c: TrackConfig = TrackConfig()) -> DataFrame:
    """One row for each silence of signal_gap_hours or more between a vessel's points, with what it says.

    MISSING where the middle of the gap lies in weak coverage; else CONFLICT if the vessel was under way before it; else MISSING_MOORED.
    """
    w = track()
    before = lambda x: F.lag(x).over(w)
    gaps = voyages.select(
        "mmsi",
        before("voyage_id").alias("voyage_id_before"),
        F.col("voyage_id").alias("voyage_id_after"),
        before("ts").alias("gap_start"),
        F.col("ts").alias("gap_end"),
        "gap_hours",
        ((before("lat") + F.col("lat")) / 2).alias("lat_mid"),
        ((before("lon") + F.col("lon")) / 2).alias("lon_mid"),
        before("sog").alias("sog_before"),
    ).where(F.col("gap_hours") >= c.signal_gap_hours)
    gaps = gaps.withColumns({"ci": cell("lat_mid", c.grid), "cj": cell("lon_mid", c.grid)})
    known = coverage.select("ci", "cj", "coverage_ok", "n_vessels")
    out = gaps.join(known, ["ci", "cj"], "left").withColumns({
        "coverage_ok": F.coalesce("coverage_ok", F.lit(False)),
        "n_vessels": F.coalesce("n_vessels", F.lit(0).cast("long")),
        "was_underway": above("sog_before", c.underway_sog),
        "was_stopped": below("sog_before", c.stopped_sog),
    })
    verdict = F.when(~F.col("coverage_ok"), "MISSING").when(F.col("was_underway"), "CONFLICT").otherwise("MISSING_MOORED")
    return out.withColumn("signal_class", verdict)


def gap_rollup(gaps: DataFrame) -> DataFrame:
    """By the voyage before the gap: n_signal_conflict, max_gap_hours, n_gaps."""
    return gaps.groupBy(F.col("voyage_id_before").alias("voyage_id")).agg(
        F.count_if(F.col("signal_class") == "CONFLICT").alias("n_signal_conflict"), F.max("gap_hours").alias("max_gap_hours"), F.count("*").alias("n_gaps")
    )


def draft_features(voyages: DataFrame, c: TrackConfig = TrackConfig()) -> DataFrame:
    """One row a voyage: draft statistics over reported drafts, whether the vessel's draft ever changes, and the class of evidence."""
    stats = voyages.groupBy("voyage_id").agg(F.first("mmsi").alias("mmsi"), *draft_columns())
    return with_draft_class(stats.join(reliable_vessels(voyages, c), "mmsi", "left"), c).drop("mmsi")


def reliable_vessels(voyages: DataFrame, c: TrackConfig) -> DataFrame:
    return voyages.where("draft is not null").groupBy("mmsi").agg((F.count_distinct("draft") >= c.draft_min_values).alias("draft_reliable_vessel"))


def draft_columns() -> list[Column]:
    return [
        F.count("draft").alias("draft_n"), F.min("draft").alias("draft_min"), F.max("draft").alias("draft_max"), F.avg("draft").alias("draft_mean"), F.stddev_samp("draft").alias("draft_std"),
    ]


def with_draft_class(df: DataFrame, c: TrackConfig) -> DataFrame:
    df = df.withColumns({
        "draft_range": F.col("draft_max") - F.col("draft_min"),
        "draft_reliable_vessel": F.coalesce("draft_reliable_vessel", F.lit(False)),
    })
    verdict = (
        F.when(F.col("draft_n") == 0, "NO_DRAFT")
        .when(~F.col("draft_reliable_vessel"), "STATIC_DRAFT")
        .when(F.col("draft_range") > c.draft_change, "CHANGED")
        .otherwise("UNCHANGED")
    )
    return df.withColumn("draft_class", verdict)


def build_features(points: DataFrame, c: TrackConfig = TrackConfig()) -> DataFrame:
    """The voyage feature table of one period; the steps in `plans.pipeline` unite several.

    Kinematics, turns and drafts are one aggregate over the windows that find the voyages; a turn is taken between points of one voyage. Whether a
    vessel's draft ever changes follows from its voyages' drafts.
    """
    voyages = split_voyages(points, c)
    gaps = signal_gaps(voyages, coverage_grid(points, c), c)
    zero = F.lit(0).cast("long")
    before = lambda x: F.lag(x).over(track())
    turn = F.when(before("voyage_seq") == F.col("voyage_seq"), wrapped_degrees(F.col("cog") - before("cog")))
    df = voyages.withColumn("turn", turn).groupBy("voyage_id").agg(
        *kinematic_columns(c), F.stddev_samp("turn").alias("course_std"), *draft_columns()
    )
    if c.draft_min_values == 2:
        vessel = Window.partitionBy("mmsi")
        df = df.withColumn("draft_reliable_vessel", F.min("draft_min").over(vessel) < F.max("draft_max").over(vessel))
    else:
        df = df.join(reliable_vessels(voyages, c), "mmsi", "left")
    df = with_draft_class(df, c)
    return df.join(gap_rollup(gaps), "voyage_id", "left").withColumns({"n_signal_conflict": F.coalesce("n_signal_conflict", zero), "n_gaps": F.coalesce("n_gaps", zero)})


def track_of(points: DataFrame, vessel: int | Column) -> DataFrame:
    return points.where(F.col("mmsi") == vessel).orderBy("ts")
