"""Exact quantiles of many columns in many groups at once, by counts of values and places in ranges: no task holds a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import sums_before

FEW_GROUPS = 10_000  # (group, column) pairs whose places are broadcast: three numbers each


def grouped_quantiles(df: DataFrame, columns: list[str], qs: tuple[float, ...] = (0.5,), by: tuple[str, ...] = (), n: Column | None = None) -> DataFrame:
    """(by..., column, q, value): for each group, column and q the exact quantile, linear between values, as a double. Null values don't count; a column without values in a group has no row.

    Values are counted first; the distinct ones of all groups and columns are dealt by ranges of (group, column, value), whose counts become places. NaN is above all
    numbers, and null is a group like any other. n: how many rows a row stands for, by default one.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    keys = [*by, "column"]
    values = df.select(*by, each.alias("_v"), (F.lit(1).cast("long") if n is None else n).alias("_n")).select(*by, "_v.*", "_n").where("x is not null").groupBy(*keys, "x").agg(F.sum("_n").alias("n"))
    placed = sums_before(values, [*keys, "x"], {"below": F.col("n")})
    spans = placed.groupBy(*keys).agg(F.min("below").alias("base"), F.sum("n").alias("size"))
    at = F.col("q") * (F.col("size") - 1)
    wanted = spans.select(*keys, "base", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "size").select(*keys, "base", "q", at.alias("at"))
    x, y = placed.alias("x"), wanted.alias("y")
    place = F.col("x.below") - F.col("y.base")
    holds = lambda k: (place <= k) & (place + F.col("x.n") > k)
    low, high = F.floor("y.at"), F.ceil("y.at")
    joined = x.join(F.broadcast(y) if spans.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else y, reduce(lambda u, v: u & v, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys]))
    ends = joined.where(holds(low) | holds(high)).groupBy(*[F.col(f"y.{c}").alias(c) for c in keys], F.col("y.q").alias("q"), F.col("y.at").alias("at")).agg(F.min("x.x").alias("lo"), F.max("x.x").alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    return ends.select(*keys, "q", value.alias("value"))


def medians(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), n: Column | None = None) -> DataFrame:
    """A row a group with the median of each column under its name; null where a group has no value of it. A group without any value has no row, but without by there is always one row."""
    found = grouped_quantiles(df, columns, (0.5,), by, n)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])
