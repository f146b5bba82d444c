"""Moments and spans of time dealt to common buckets, so that a join of both isn't one key for all of an object's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import HOUR_US, micros

PIECES = 16  # buckets that a long span covers, about: at most this and one more


def _bucket(at: Column, level: Column) -> Column:
    return F.floor(at / (F.lit(HOUR_US) * F.pow(F.lit(2.0), level))).cast("long")


def deal_spans(spans: DataFrame, lo: str, hi: str, pieces: int = PIECES) -> DataFrame:
    """spans with _level and _bucket, a row for each bucket that the span touches, both ends included.

    Buckets of level n are 2^n hours long; a span takes the least level at which it touches at most `pieces` buckets and one more. Spans without one of both ends, or that end before they start, go.
    """
    length = (micros(hi) - micros(lo)) / F.lit(HOUR_US * pieces)
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log2(F.greatest(length, F.lit(1.0))))).cast("int")
    df = spans.where(F.col(lo) <= F.col(hi)).withColumn("_level", level)
    return df.withColumn("_bucket", F.explode(F.sequence(_bucket(micros(lo), F.col("_level")), _bucket(micros(hi), F.col("_level")))))


def deal_moments(moments: DataFrame, at: str, dealt: DataFrame) -> DataFrame:
    """moments with _level and _bucket, a row for each level that a dealt span has (64 at most, one row of an array), so a moment meets a span that it lies in once; a moment of no time goes."""
    levels = dealt.agg(F.collect_set("_level").alias("_levels"))
    df = moments.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    return df.withColumn("_bucket", _bucket(micros(at), F.col("_level")))


def in_bucket(left: DataFrame, right: DataFrame, where: Column, how: str = "inner") -> DataFrame:
    """Rows of two dealt tables that meet in a bucket and fulfil `where`, which holds the equality of their objects."""
    right = right.withColumnsRenamed({"_level": "_level_r", "_bucket": "_bucket_r"})
    return left.join(right, where & (F.col("_level") == F.col("_level_r")) & (F.col("_bucket") == F.col("_bucket_r")), how)
