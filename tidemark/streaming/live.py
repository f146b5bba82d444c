"""Streaming forms of cells and voyages; beyond what a batch run needs, for points that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import PairConfig, TrackConfig
from tidemark.functions.core import above, below, cell, has_prefix


def live_cells(points: DataFrame, late: str = "2 hours", c: PairConfig = PairConfig()) -> DataFrame:
    """Vessels (approximate, within about 5 %), stopped and moving counts of each hour and grid cell, of points at most `late` behind."""
    return (
        points.withWatermark("ts", late)
        .where(~has_prefix("mmsi", c.exclude_prefixes))
        .groupBy(F.window("ts", f"{c.bin_hours} hour"), cell("lat", c.cell).alias("ci"), cell("lon", c.cell).alias("cj"))
        .agg(F.approx_count_distinct("mmsi").alias("n_vessels"), F.count_if(below("sog", c.stopped_sog)).alias("n_stopped"), F.count_if(above("sog", c.moving_sog)).alias("n_moving"))
    )


def live_voyages(points: DataFrame, late: str = "2 hours", c: TrackConfig = TrackConfig()) -> DataFrame:
    """Voyages as session windows: they end when a vessel is silent for voyage_gap_hours, where a batch voyage goes on at a gap of just that."""
    gap = f"{int(c.voyage_gap_hours * 3600)} seconds"
    return points.withWatermark("ts", late).groupBy("mmsi", F.session_window("ts", gap).alias("session")).agg(
        F.count("*").alias("n_points"), F.avg("sog").alias("avg_sog"), F.max("sog").alias("max_sog")
    )
