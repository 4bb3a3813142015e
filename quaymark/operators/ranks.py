"""Ranks, tails and order statistics over whole tables without a task that sorts all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.session import materialise

#: Ranges of values that are sorted apart; their cuts come from a sketch of bounded size and move no result.
RANGES = 64


def running_counts(values: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds upto_<c> for each of `sums` and upto_values: what this and all values before it come to, per `by`. `values` has one
    row a value; null values are left out.

    Values are cut into RANGES stretches, each a group of its own, and the totals of earlier stretches are added.
    """
    rows = materialise(values.filter(F.col(value).isNotNull()), "values")
    rows = rows if by else rows.withColumn("__key", F.lit(0))
    keys = list(by) or ["__key"]
    number = F.col(value).cast("double")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(number, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("__cuts"))
    names = [f"__c{i}" for i in range(len(keys))]
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    rename = lambda df: df.withColumnsRenamed(dict(zip(keys, names)))
    placed = rows.join(rename(cuts), same, "left").withColumn("__cell", F.size(F.filter("__cuts", lambda c: c < number)) * (-1 if descending else 1)).drop("__cuts", *names)
    counted = [*sums, "__one"]
    placed = placed.withColumn("__one", F.lit(1))
    totals = placed.groupBy(*keys, "__cell").agg(*[F.sum(c).alias(f"__t_{c}") for c in counted])
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__cell", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in counted])
    here = Window.partitionBy(*keys, "__cell").orderBy(F.col(value).desc() if descending else F.col(value).asc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(rename(before).withColumnRenamed("__cell", "__c"), same & (F.col("__cell") == F.col("__c"))).drop("__c", *names)
    out = joined.withColumns({f"upto_{'values' if c == '__one' else c}": F.sum(c).over(here) + F.col(f"__b_{c}") for c in counted})
    return out.drop("__cell", "__key", "__one", *[f"__b_{c}" for c in counted])


def order_values(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact percentiles of a column, interpolated between neighbours: a fixed number of facts for the driver."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return [None for _ in shares]
    places = [s * (n - 1) for s in shares]
    run = running_counts(counts, value, ["n"])
    wanted = sorted({int(p) + 1 for p in places} | {min(n, int(p) + 2) for p in places})
    found = run.agg(*[F.min(F.when(F.col("upto_n") >= r, F.col(value))).alias(f"r{r}") for r in wanted]).first()
    low, high = [found[f"r{int(p) + 1}"] for p in places], [found[f"r{min(n, int(p) + 2)}"] for p in places]
    return [a if a == b else a + (b - a) * (p - int(p)) for a, b, p in zip(low, high, places)]


def upper_tails(df: DataFrame, uid: str, features: Sequence[str]) -> DataFrame:
    """`df` with tail_<feature>: leave-one-out upper tail (1 + others at least as large) / (1 + others); null for null values.

    All features at once and over their distinct values; rows take their values' tails."""
    df = materialise(df, "features")
    long = df.select(uid, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))).filter("value is not null")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    run = running_counts(counts, "value", ["n"], ["feature"], descending=True)
    whole = counts.groupBy("feature").agg(F.sum("n").alias("all")).withColumnRenamed("feature", "f")
    tails = run.join(F.broadcast(whole), F.col("feature") == F.col("f")).select("feature", "value", (F.col("upto_n") / F.col("all")).alias("tail"))
    wide = long.join(tails, ["feature", "value"]).groupBy(uid).agg(*[F.max(F.when(F.col("feature") == c, F.col("tail"))).alias(f"tail_{c}") for c in features])
    return df.join(wide, uid, "left")


def placed(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds, by descending score within `by`: rank (1 + larger), tie_group (dense), ties, and percentile (less + equal others
    / 2 + 1/2) / n. Rows without score have none of them and do not count."""
    df = materialise(df, "scored")
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("ties"))
    run = running_counts(counts, score, ["ties"], by, descending=True)
    names = {c: f"__p_{c}" for c in [*by, score]}
    ranks = run.select(*[F.col(c).alias(n) for c, n in names.items()], "ties", (F.col("upto_ties") - F.col("ties") + 1).alias("rank"), F.col("upto_values").alias("tie_group"))
    sizes = counts.groupBy(*[F.col(c).alias(f"__q_{c}") for c in by]).agg(F.sum("ties").alias("__all"))
    same, own = F.lit(True), F.lit(True)
    for c, n in names.items():
        same = same & (F.col(c) == F.col(n) if c == score else F.col(c).eqNullSafe(F.col(n)))
    for c in by:
        own = own & F.col(c).eqNullSafe(F.col(f"__q_{c}"))
    out = df.join(ranks, same, "left").join(F.broadcast(sizes) if not by else sizes, own, "left")
    percentile = (F.col("__all") - F.col("rank") + 1 - F.col("ties") + (F.col("ties") - 1) / 2 + 0.5) / F.col("__all")
    return out.withColumn("percentile", percentile).drop(*names.values(), "__all", *[f"__q_{c}" for c in by])


def sliced(df: DataFrame, keys: Sequence[str], at: Column, order: Sequence[str], overlap: int, most: int = 2_000_000, slices: int = 64) -> DataFrame:
    """`df` with __slice and __head: keys of more than `most` rows are cut into stretches of `at` (a number), each headed by
    the `overlap` rows before it (__head true), so that windows over few rows before can be taken per key and slice."""
    plain = df.withColumn("__slice", F.lit(0)).withColumn("__head", F.lit(False))
    sizes = df.groupBy(*keys).count().filter(F.col("count") > most)
    hot = sizes.collect()  # at most rows / most keys
    if not hot:
        return plain
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    few = F.broadcast(df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], df.select(*keys).schema))
    cuts = df.withColumn("__at", at).alias("d").join(few.alias("h"), same("d", "h"), "left_semi").groupBy(*keys).agg(F.percentile_approx("__at", F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(10_000)).alias("__cuts"))
    cut = plain.withColumn("__at", at).alias("d").join(F.broadcast(cuts).alias("c"), same("d", "c"), "left").select("d.*", "c.__cuts")
    cut = cut.withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__at"))), F.lit(0)))
    last = cut.filter("__cuts is not null").withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("__k") <= overlap)
    later = last.withColumn("__to", F.explode(F.sequence(F.col("__slice") + 1, F.lit(slices)))).filter(F.col("__to") < slices)
    heads = later.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__to").orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("__k") <= overlap)
    heads = heads.withColumn("__slice", F.col("__to")).withColumn("__head", F.lit(True))
    return cut.drop("__at", "__cuts").unionByName(heads.select(*cut.drop("__at", "__cuts").columns))


def two_sided_tails(df: DataFrame, uid: str, value: str) -> DataFrame:
    """`df` with tail_<value>: leave-one-out two-sided tail (1 + others at least as far from the others' median) / (1 + others);
    1 at the median itself, null for null values.

    A median without one row is one of at most three numbers, told by the row's side; the tails around each are upper tails
    of the distance to it, so nothing but distinct values is sorted."""
    df = materialise(df, "values")
    n = df.filter(F.col(value).isNotNull()).count()
    if n < 2:
        return df.withColumn(f"tail_{value}", F.when(F.col(value).isNotNull(), F.lit(None).cast("double")))
    v, h = F.col(value).cast("double"), n // 2
    at = lambda *ranks: [float(x) for x in order_values(df.select(v.alias("v")), "v", [min(max(r, 0), n - 1) / (n - 1) for r in ranks])]
    if n % 2:
        a, b, c = at(h - 1, h, h + 1)
        center = F.when(v < b, (b + c) / 2).when(v == b, (a + c) / 2).when(v > b, (a + b) / 2)
        centers = sorted({(b + c) / 2, (a + c) / 2, (a + b) / 2})
    else:
        a, b = at(h - 1, h)
        center = F.when(v <= a, F.lit(b)).when(v > a, F.lit(a))
        centers = sorted({a, b})
    away = df.select(uid, *[F.abs(v - F.lit(c)).alias(f"d{i}") for i, c in enumerate(centers)])
    tails = upper_tails(away, uid, [f"d{i}" for i in range(len(centers))]).drop(*[f"d{i}" for i in range(len(centers))])
    both = df.join(tails, uid, "left").withColumn("__center", center)
    chosen = F.coalesce(*[F.when(F.col("__center") == F.lit(c), F.when(v == F.lit(c), 1.0).otherwise(F.col(f"tail_d{i}"))) for i, c in enumerate(centers)])
    return both.withColumn(f"tail_{value}", chosen).select(*df.columns, f"tail_{value}")
