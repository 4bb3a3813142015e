"""Interval coverage: gaps, union duration, complete ratio, contiguity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Maximal covered stretches per key; intervals that touch are one. Rows with a null bound or end < start are left out."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = df.filter(F.col(end) >= F.col(start))
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")
    numbered = whole.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, first: int, last: int) -> DataFrame:
    """Uncovered stretches of [first, last] per key: gap_start, gap_end."""
    clipped = df.select(*keys, F.greatest(F.col(start), F.lit(first)).alias(start), F.least(F.col(end), F.lit(last)).alias(end))
    covered = islands(clipped, keys, start, end)
    order = Window.partitionBy(*keys).orderBy(start)
    inner = covered.select(*keys, F.coalesce(F.lag(end).over(order), F.lit(first)).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = covered.groupBy(*keys).agg(F.max(end).alias("gap_start")).withColumn("gap_end", F.lit(last))
    return inner.unionByName(tail).filter("gap_end > gap_start")


def covered_ratio(df: DataFrame, keys: Sequence[str], start: str, end: str, first: int, last: int) -> DataFrame:
    """Seconds of [first, last] that any interval covers, and their share."""
    clipped = df.select(*keys, F.greatest(F.col(start), F.lit(first)).alias(start), F.least(F.col(end), F.lit(last)).alias(end))
    total = islands(clipped, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))
    return total.withColumn("ratio", F.col("covered") / F.lit(last - first))


def contiguous(df: DataFrame, keys: Sequence[str], start: str, end: str, step: int = 1) -> DataFrame:
    """Per key whether each slice begins `step` after the one before ends: no gap, no overlap."""
    order = Window.partitionBy(*keys).orderBy(start)
    ok = F.coalesce(F.lag(end).over(order) + step == F.col(start), F.lit(True))
    return df.withColumn("__ok", ok).groupBy(*keys).agg(F.bool_and("__ok").alias("contiguous"), F.count(F.lit(1)).alias("slices"))
