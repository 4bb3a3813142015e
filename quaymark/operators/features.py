"""Per-entity feature tables: one row per entity, columns for every event type of a fixed list."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More types than this make a wide table unreadable for Parquet; the list is refused, never cut.
MAX_TYPES = 2000
#: Types whose expressions are compiled together: with four columns each they stay below the limits of generated code.
BLOCK = 16


def column_name(kind: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", kind.lower()).strip("_")


def feature_table(events: DataFrame, entity: str, kind: str, at: str, totals: Mapping[str, Column], kinds: Sequence[str]) -> DataFrame:
    """One row per non-null entity: n_all, last_all, <total>_all, and for each type of `kinds` n_<type>, last_<type>,
    <total>_<type>. Counts of absent types are 0, their times and totals null. Events of a null or unlisted type
    count in the _all columns only. Null values are left out of totals. An empty table has no entities.

    One scan. Rows are first reduced to one per (entity, type) with a partial aggregate before the shuffle, so a hot
    entity leaves at most as many rows as there are types, and a wide row is never shuffled. Those narrow rows are brought
    together by entity once. Conditional count, sum and maximum-time expressions then run over BLOCK types at a time, few
    enough to be compiled, and an entity's blocks are laid side by side; neither step shuffles again.
    """
    if len(kinds) > MAX_TYPES or len({column_name(k) for k in kinds}) < len(kinds):
        raise ValueError("the type list must have distinct column names and at most %d types" % MAX_TYPES)
    codes = {k: i for i, k in enumerate(kinds)}
    narrow = events.filter(F.col(entity).isNotNull()).groupBy(entity, F.col(kind).alias("__kind")).agg(
        F.count(F.lit(1)).alias("__n"), F.max(at).alias("__last"), *[F.sum(v).alias(f"__{n}") for n, v in totals.items()]
    )
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else F.lit(None)
    code = F.element_at(lookup, F.col("__kind")) if codes else F.lit(None).cast("int")
    together = narrow.withColumn("__code", code).repartition(entity)
    parts = {"n": "__n", "last": "__last", **{n: f"__{n}" for n in totals}}
    cells = [F.max(F.when(F.pmod("__code", F.lit(BLOCK)) == i, F.col(c))).alias(f"{part}{i}") for i in range(min(BLOCK, len(kinds))) for part, c in parts.items()]
    whole = {part: (F.max if part == "last" else F.sum)(c) for part, c in parts.items()}
    blocks = together.groupBy(entity, F.floor(F.col("__code") / BLOCK).cast("int").alias("__block")).agg(*[x.alias(f"__all_{part}") for part, x in whole.items()], *cells)
    row = F.struct(*[f"`{part}{i}`" for i in range(min(BLOCK, len(kinds))) for part in parts]) if kinds else F.lit(None)
    side = blocks.groupBy(entity).agg(
        *[(F.max if part == "last" else F.sum)(f"__all_{part}").alias(f"{part}_all") for part in parts],
        *[F.first(F.when(F.col("__block") == b, row), ignorenulls=True).alias(f"__block{b}") for b in range(-(-len(kinds) // BLOCK))],
    )
    out = [F.col(entity), *[f"{part}_all" for part in parts]]
    for k, i in codes.items():
        for part in parts:
            value = F.col(f"__block{i // BLOCK}").getField(f"{part}{i % BLOCK}")
            out.append((F.coalesce(value, F.lit(0)) if part == "n" else value).alias(f"{part}_{column_name(k)}"))
    return side.select(*out)
