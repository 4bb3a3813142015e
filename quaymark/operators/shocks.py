"""Belief shocks: moves of log-odds against the recent past of the same market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import logit
from quaymark.operators.ranks import sliced


def belief_shocks(ticks: DataFrame, market: str, at: str, tie: str, price: str = "price", window: int = 12, limit: float = 2.5, slice_rows: int = 2_000_000) -> DataFrame:
    """Adds shock (change of log-odds, clipped at 0.001), mean and sample deviation of the `window` shocks before it (null
    until there are so many; a market of more than `slice_rows` ticks is cut into stretches headed by the ticks before), score ((shock - mean) / deviation, a deviation of 0 or null counting as 0.01) and anomaly."""
    order = Window.partitionBy(market, "__slice").orderBy(at, tie)
    past = order.rowsBetween(-window, -1)
    df = sliced(ticks, [market], F.unix_micros(at), [at, tie], window + 1, slice_rows).withColumn("logit", logit(F.col(price), 1e-3))
    df = df.withColumn("shock", F.col("logit") - F.lag("logit").over(order))
    full = F.count("shock").over(past) >= window
    df = df.withColumn("past_mean", F.when(full, F.avg("shock").over(past))).withColumn("past_std", F.when(full, F.stddev_samp("shock").over(past)))
    score = (F.col("shock") - F.col("past_mean")) / F.coalesce(F.nullif(F.col("past_std"), F.lit(0.0)), F.lit(0.01))
    df = df.filter(~F.col("__head")).drop("__slice", "__head")
    return df.withColumn("score", score).withColumn("anomaly", F.coalesce(F.abs(F.col("score")) > limit, F.lit(False)))
