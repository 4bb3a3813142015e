"""Attributes as known at event time: independent change histories, last-known matches, attributes pivoted back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.session import materialise, small_side, write_once

#: Rows of one entity beyond which its time line is cut into slices, and the number of slices.
SLICE_ROWS, SLICES = 2_000_000, 64


def history(df: DataFrame, entity: str, known_at: str, attribute: str, first_known: bool = False) -> DataFrame:
    """The change history of one attribute: entity, attribute, known_at, value (as string).

    Rows without entity or known_at were never known and are left out; a null value is a known "no value". With
    `first_known` each value counts once, from the smallest known_at of its rows, whenever it is seen again.
    """
    rows = df.filter(F.col(entity).isNotNull() & F.col(known_at).isNotNull()).select(
        F.col(entity).alias("entity"), F.lit(attribute).alias("attribute"), F.col(known_at).alias("known_at"), F.col(attribute).cast("string").alias("value")
    )
    if first_known:
        return rows.groupBy("entity", "attribute", "value").agg(F.min("known_at").alias("known_at")).select("entity", "attribute", "known_at", "value")
    return rows.groupBy("entity", "attribute", "known_at").agg(F.max("value").alias("value"))


def histories(df: DataFrame, entity: str, known_at: str, attributes: Mapping[str, bool]) -> DataFrame:
    """The histories of several attributes in one narrow table; each changes at its own times. attribute -> first_known."""
    out = None
    for name, first_known in attributes.items():
        one = history(df, entity, known_at, name, first_known)
        out = one if out is None else out.unionByName(one)
    return out


class AttributeHistories:
    """The stored change histories of an entity's attributes, each by itself.

    Folder: <attribute>/part=i, appended by every update and never rewritten. Updates may come in any order and repeat;
    attributes may be updated at different times. A part that a failed update left is replaced.
    """

    def __init__(self, spark: SparkSession, path: str, attributes: Mapping[str, bool]):
        self.spark, self.path, self.attributes, self.parts = spark, path.rstrip("/"), dict(attributes), {a: 0 for a in attributes}

    def update(self, df: DataFrame, entity: str, known_at: str, attributes: Sequence[str] | None = None) -> None:
        """Appends what `df` says of `attributes` (all by default); each is read as a narrow column of its own."""
        for name in self.attributes if attributes is None else attributes:
            write_once(history(df, entity, known_at, name, self.attributes[name]), f"{self.path}/{name}/part={self.parts[name]}", "overwrite")
            self.parts[name] += 1

    def past(self) -> DataFrame:
        """entity, attribute, known_at, value of all attributes that were ever updated, parts put together."""
        out = None
        for name, n in self.parts.items():
            if n:
                rows = self.spark.read.parquet(*[f"{self.path}/{name}/part={i}" for i in range(n)]).drop("part")
                one = rows if n == 1 else history(rows.withColumnRenamed("value", name), "entity", "known_at", name, self.attributes[name])
                out = one.select("entity", "attribute", "known_at", "value") if out is None else out.unionByName(one.select("entity", "attribute", "known_at", "value"))
        return out


def known_attributes(events: DataFrame, past: DataFrame, entity: str, at: str, attributes: Sequence[str], slice_rows: int = SLICE_ROWS, slices: int = SLICES) -> DataFrame:
    """Each event with the value of every attribute that was known last at or before its time, and since when.

    Adds <attribute> and <attribute>_known_at; both null if nothing was known yet. Events without entity or time keep
    null attributes. Of values known from the same time the largest holds. An event column of an attribute's name is
    replaced. Repeated events stay repeated.

    Only the distinct (entity, time) of the events are matched, on a time line per entity and attribute: each attribute's
    last known value is found by itself, then the attributes are pivoted back to one row per (entity, time) and joined to
    the events. No version is as wide as the entity and no event's payload is sorted. An entity with more than
    `slice_rows` rows is cut into `slices` stretches of time, each a group of its own that starts with what earlier
    stretches knew, so no entity is one task's work.
    """
    taken = {"__at", "__entity", *[f"__{i}" for i in range(len(attributes))]}
    keep = [c for c in events.columns if c not in {x for a in attributes for x in (a, f"{a}_known_at")}]
    assert not taken & set(keep), "column names with two leading underscores are reserved"
    asked = events.select(F.col(entity).alias("__entity"), F.col(at).alias("__at")).filter(F.col("__entity").isNotNull() & F.col("__at").isNotNull())
    asked = materialise(asked.distinct(), "asked")
    names = F.explode(F.array(*[F.lit(a) for a in attributes]))
    left = asked.select("*", F.lit(1).alias("__kind"), names.alias("__attribute"))
    right = past.filter(F.col("attribute").isin(list(attributes))).select(
        F.col("entity").alias("__entity"), F.col("known_at").alias("__at"), F.lit(0).alias("__kind"), F.col("attribute").alias("__attribute"), F.struct(F.col("value").alias("v"), F.col("known_at").alias("t")).alias("__value")
    )
    sizes = asked.select("__entity").unionByName(right.select("__entity")).groupBy("__entity").count()
    hot = materialise(sizes.filter(F.col("count") > slice_rows).select("__entity"), "hot")
    line, group = left.unionByName(right, allowMissingColumns=True), ["__entity", "__attribute"]
    if not hot.isEmpty():
        line, group = _sliced(line, hot, attributes, slices), [*group, "__slice"]
    else:
        line = line.repartition("__entity")  # serves the match and the pivot alike
    upto = Window.partitionBy(*group).orderBy("__at", "__kind", F.col("__value.v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("__known", F.last("__value", ignorenulls=True).over(upto)).filter("__kind = 1")
    wide = found.groupBy("__entity", "__at").agg(*[F.first(F.when(F.col("__attribute") == a, F.col("__known")), ignorenulls=True).alias(f"__{i}") for i, a in enumerate(attributes)])
    own = events.select(*keep)
    out = own.join(wide, (own[entity] == wide["__entity"]) & (own[at] == wide["__at"]), "left")
    return out.select(*keep, *[x for i, a in enumerate(attributes) for x in (F.col(f"__{i}.v").alias(a), F.col(f"__{i}.t").alias(f"{a}_known_at"))])


def _sliced(line: DataFrame, hot: DataFrame, attributes: Sequence[str], slices: int) -> DataFrame:
    """`line` with __slice: 0 for usual entities, stretches of nearly equal rows for those of `hot`, each stretch headed
    by the values known at its start."""
    micros = F.unix_micros("__at")
    parts = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = line.join(small_side(hot), "__entity", "left_semi").groupBy("__entity").agg(F.percentile_approx(micros, parts, F.lit(10_000)).alias("__cuts"))
    cut = line.join(small_side(cuts), "__entity", "left").withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda c: c < micros)), F.lit(0)))
    known = cut.filter("__kind = 0 and __cuts is not null")
    last = known.groupBy("__entity", "__attribute", "__slice").agg(F.max_by("__value", F.struct("__at", F.col("__value.v"))).alias("__last"))
    names = F.array(*[F.lit(a) for a in attributes])
    grid = cuts.select("__entity", F.explode(names).alias("__attribute")).select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__slice"))
    before = Window.partitionBy("__entity", "__attribute").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = grid.join(last, ["__entity", "__attribute", "__slice"], "left").withColumn("__value", F.last("__last", ignorenulls=True).over(before)).filter("__value is not null")
    heads = heads.select("__entity", F.lit("0001-01-01").cast("timestamp").alias("__at"), F.lit(0).alias("__kind"), "__attribute", "__value", "__slice")
    return cut.drop("__cuts").unionByName(heads, allowMissingColumns=True)


def late_knowledge(events: DataFrame, at: str, attributes: Sequence[str]) -> Column:
    """True where an attribute's known_at lies after the event: never, in results of `known_attributes`."""
    bad = F.lit(False)
    for a in attributes:
        bad = bad | F.coalesce(F.col(f"{a}_known_at") > F.col(at), F.lit(False))
    return bad
