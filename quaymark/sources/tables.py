"""Named tables of a data folder, read with column types the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; zone-less clocks hold UTC and become instants, for which the session must be in UTC as well."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`") for f in df.schema.fields])
