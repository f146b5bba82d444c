"""Tables behind the exploratory charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import grouped_quantiles

EVIDENCE_ORDER = ("High", "Good", "Some", "No obvious evidence")


def value_counts(df: DataFrame, column: str, first: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(first) if first else out


def counts_in_order(df: DataFrame, column: str, order: tuple[str, ...] = EVIDENCE_ORDER) -> DataFrame:
    """A row for each of the order's values, 0 where there is none."""
    there = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(v).alias("value")) for i, v in enumerate(order)]))
    base = df.sparkSession.range(1).select(there.alias("x")).select("x.*")
    return base.join(value_counts(df, column), "value", "left").select("pos", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def showcase(incidents: DataFrame, n: int = 4, evidence: str = EVIDENCE_ORDER[0]) -> DataFrame:
    """Rows of n incidents to show, of strongest evidence and with both times: half of them meetings of two vessels, then one of a single vessel for each type, then
    more meetings; each kind by number."""
    df = incidents.where((F.col("evidence") == evidence) & F.col("t_start").isNotNull() & F.col("t_end").isNotNull())
    size = df.groupBy("incident_num").agg(F.count("*").alias("k"), F.min("incident_type").alias("kind"))
    two = size.where("k = 2").select("incident_num")
    first = two.orderBy("incident_num").limit(max(1, n // 2))
    one = size.where("k = 1").groupBy("kind").agg(F.min("incident_num").alias("incident_num")).select("incident_num")
    turns = [first, one, two.join(first, "incident_num", "left_anti")]
    picked = turns[0].withColumn("turn", F.lit(0))
    for i, more in enumerate(turns[1:], 1):
        picked = picked.unionByName(more.withColumn("turn", F.lit(i)))
    return df.join(picked.orderBy("turn", "incident_num").limit(n), "incident_num", "left_semi")


def fill_rates(df: DataFrame, column: str, by: str) -> DataFrame:
    """Share of rows with a value, in all (value 'all') and by group."""
    rate = F.avg(F.col(column).isNotNull().cast("double")).alias("rate")
    return df.groupBy(F.col(by).alias("value")).agg(rate, F.count("*").alias("n")).unionByName(df.agg(rate, F.count("*").alias("n")).select(F.lit("all").alias("value"), "rate", "n"))


def quantiles(df: DataFrame, column: str, qs: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Exact quantiles, linear between values."""
    return grouped_quantiles(df, [column], qs).select("q", "value").orderBy("q")


def overview(points: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: points, vessels, first and last time, incidents, incident vessels."""
    p = points.agg(F.count("*").alias("n_points"), F.count_distinct("mmsi").alias("n_vessels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    i = incidents.agg(F.count_distinct("incident_num").alias("n_incidents"), F.count_distinct("mmsi").alias("n_incident_vessels"))
    return p.crossJoin(i)  # one row each
