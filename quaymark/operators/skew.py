"""A few keys holding most records: exact per-key results from value frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHT = "weight"


def compress(df: DataFrame, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Distinct (key, value) with the number of their rows. The counts are added up before the shuffle and a key's rows
    spread over as many groups as it has values, so no task holds a whole key."""
    return df.groupBy(*key, *value).agg(F.count(F.lit(1)).alias(WEIGHT))


def profile(compressed: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: n_rows, n_values (distinct, nulls not counted), mode_value and mode_rows (of non-null values; of equal
    counts the smallest value). Keys may be null and form one group; a key whose values are all null has no mode."""
    per = compressed.groupBy(key, value).agg(F.sum(WEIGHT).alias(WEIGHT)) if set(compressed.columns) != {key, value, WEIGHT} else compressed
    seen = F.col(value).isNotNull()
    best = F.max(F.when(seen, F.col(WEIGHT)))
    totals = per.groupBy(key).agg(
        F.sum(WEIGHT).alias("n_rows"),
        F.count(F.when(seen, F.lit(1))).alias("n_values"),
        best.alias("mode_rows"),
        F.min_by(F.col(value), F.when(seen, F.struct((-F.col(WEIGHT)).alias("w"), F.col(value).alias("v")))).alias("mode_value"),
    )
    return totals.select(key, "n_rows", "n_values", "mode_value", "mode_rows")


def hot_keys(compressed: DataFrame, key: str, one_in: int) -> DataFrame:
    """Non-null keys that hold at least one in `one_in` of all rows, with n_rows."""
    total = compressed.agg(F.sum(WEIGHT)).scalar()
    sums = compressed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(WEIGHT).alias("n_rows"))
    return sums.filter(F.col("n_rows") * one_in >= total)


def weighted_percentiles(compressed: DataFrame, key: str, value: str, fractions: Sequence[float], cells: int = 64) -> DataFrame:
    """Exact lower percentiles per key: for fraction p the smallest value whose cumulative weight reaches p of the key.

    A key's distinct values can themselves be too many for one task, so they are cut into `cells` value ranges by an
    approximate sketch (bounded in size, combined before the shuffle). Range totals tell which range holds each rank;
    only those ranges are then sorted, each in a group of its own. The sketch moves no result: any cut gives the same
    ranks. Null values are left out; a key without values has no row. Columns: key, fraction, value_at.
    """
    rows = compressed.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(WEIGHT).alias(WEIGHT))
    cuts = rows.groupBy(key).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(1000)).alias("__cuts"))
    same = _same(key)
    placed = rows.join(cuts.withColumnRenamed(key, "__k"), same, "left").withColumn("__cell", F.size(F.filter("__cuts", lambda c: c < F.col(value).cast("double")))).drop("__cuts", "__k")
    per_cell = placed.groupBy(key, "__cell").agg(F.sum(WEIGHT).alias("__w"))
    over_cells = Window.partitionBy(key).orderBy("__cell")
    bounds = per_cell.select(key, "__cell", (F.sum("__w").over(over_cells) - F.col("__w")).alias("__before"), F.col("__w"), F.sum("__w").over(Window.partitionBy(key)).alias("__all"))
    wanted = bounds.withColumn("fraction", F.explode(F.array(*[F.lit(float(p)) for p in fractions])))
    wanted = wanted.withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("__all")))).filter("__rank > __before and __rank <= __before + __w")
    hit = wanted.select(F.col(key).alias("__k"), F.col("__cell").alias("__c"), "fraction", "__rank", "__before")
    cells_hit = placed.join(hit.select("__k", "__c", "__before").distinct(), same & (F.col("__cell") == F.col("__c"))).drop("__k", "__c")
    run = cells_hit.withColumn("__upto", F.col("__before") + F.sum(WEIGHT).over(Window.partitionBy(key, "__cell").orderBy(value)))
    return run.join(hit.drop("__before"), same & (F.col("__cell") == F.col("__c")) & (F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col(WEIGHT))).select(key, "fraction", F.col(value).alias("value_at"))


def _same(key: str) -> Column:
    return F.col(key).eqNullSafe(F.col("__k"))
