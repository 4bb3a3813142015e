"""The surveillance relations, read from the data folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.dedup import deduplicate
from quaymark.sources.tables import table

KINDS = ("last_trade", "midpoint", "best_bid", "best_ask", "platform_snapshot")


def _event_base(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("value") / (F.col("value") + 50)
    market = F.concat(F.lit("ev:"), F.col("event_type"))
    return table(spark, folder, "events").select(
        "event_id", "user_id", market.alias("market_uid"), F.concat(market, F.lit("-yes")).alias("outcome_uid"), F.lit("ev").alias("platform"), price.alias("price"), F.col("ts").alias("event_time"), F.timestamp_micros(F.unix_micros("ts") + F.pmod("event_id", F.lit(7)) * 1_000_000).alias("ingested_at"), "props"
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Price observations: five kinds, one market an event type."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return _event_base(spark, folder).select(F.concat(F.lit("ev:obs-"), F.col("event_id")).alias("observation_uid"), "market_uid", "outcome_uid", "platform", "price", kind.alias("kind"), "event_time", "ingested_at")


def event_fills(spark: SparkSession, folder: str) -> DataFrame:
    """Fills of the same markets as `observations`."""
    side = F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")
    return _event_base(spark, folder).select(
        F.concat(F.lit("ev:fill-"), F.col("event_id")).alias("fill_uid"), "market_uid", "outcome_uid", "platform", "price", (F.col("event_id") % 97 + 1).cast("double").alias("size"), side.alias("side"), F.concat(F.lit("ev:user-"), F.col("user_id")).alias("actor_uid"), "event_time", "ingested_at"
    )


def books(spark: SparkSession, folder: str) -> DataFrame:
    """Two-level order books around the price, one an event."""
    def levels(sign: int):
        return F.array(*[F.struct(F.round(F.col("price") + sign * 0.01 * i, 6).alias("price"), (F.col("event_id") % (10 * i) + i).cast("double").alias("size")) for i in (1, 2)])

    return _event_base(spark, folder).select(F.concat(F.lit("ev:book-"), F.col("event_id")).alias("snapshot_uid"), "market_uid", "outcome_uid", levels(-1).alias("bids"), levels(1).alias("asks"), "event_time", "ingested_at")


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """Trade fills, one copy of each."""
    return deduplicate(table(spark, folder, "fills"), ["fill_uid"], ["ingested_at", "delivery_id"])
