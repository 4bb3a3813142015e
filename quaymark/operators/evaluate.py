"""Label-gated evaluation: unknown is never a negative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.operators.graph import components
from quaymark.operators.ranks import order_values, running_counts


def _known() -> Column:
    return F.col("label").isin("positive", "negative")


def core_metrics(rows: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Per slice: rows, positives, negatives, labelled share, precision and recall at `k` (of labelled rows among the first k
    by score, uid), mean delay of detections in seconds."""
    scored, hit, known = rows.filter("score is not null"), F.col("label") == "positive", _known()
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "row_uid")
    best = scored.select(*by, "score", "row_uid", "label").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)  # cut before the shuffle
    top = best.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count_if(hit).alias("top_hits"), F.count_if(known).alias("top_known"))
    every = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("positives"), F.count_if(F.col("label") == "negative").alias("negatives"), F.count_if(known).alias("known"), F.avg("delay").alias("mean_delay"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return every.join(top, same, "left").select(
        *by, "rows", "positives", "negatives", (F.col("known") / F.col("rows")).alias("labeled_fraction"), F.try_divide("top_hits", "top_known").alias("precision_at_k"), F.try_divide("top_hits", "positives").alias("recall_at_k"), "mean_delay"
    )


def average_precision(rows: DataFrame) -> DataFrame:
    """Mean of precision at each positive over labelled rows. Equal scores are one step, so order among ties is moot; the
    running sums run over ranges of distinct scores."""
    steps = rows.filter(_known() & F.col("score").isNotNull()).groupBy("score").agg(F.count_if(F.col("label") == "positive").alias("p"), F.count(F.lit(1)).alias("n"))
    run = running_counts(steps, "score", ["p", "n"], descending=True)
    return run.agg(F.try_divide(F.sum(F.col("p") * F.col("upto_p") / F.col("upto_n")), F.sum("p")).alias("average_precision"))


def calibration(rows: DataFrame, bins: int) -> DataFrame:
    """Expected calibration error over equal-width bins (the last one closed) and the Brier score, of labelled rows."""
    hit = F.when(F.col("label") == "positive", 1.0).otherwise(0.0)
    cell = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = rows.filter(_known() & F.col("score").isNotNull()).groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(hit).alias("rate"), F.sum(F.pow(F.col("score") - hit, F.lit(2.0))).alias("sq"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("labeled"))


def bootstrap(rows: DataFrame, cluster: str, draws: int, seed: int = 7) -> DataFrame:
    """Cluster bootstrap of the labelled hit rate: 2.5 and 97.5 per cent order statistics of `draws` resamples.

    Every cluster gets a Poisson(1) weight per draw from a hash, so draws need no random state and no task holds all
    clusters; clusters are reduced to their counts first.
    """
    per = rows.filter(_known()).groupBy(cluster).agg(F.count_if(F.col("label") == "positive").alias("p"), F.count(F.lit(1)).alias("n"))
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col(cluster)), F.lit(1 << 40)) / float(1 << 40)
    bounds, total, term = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += term
        bounds.append(total)
        term /= i + 1
    weight = sum((F.when(u >= b, 1).otherwise(0) for b in bounds[1:]), F.when(u >= bounds[0], 1).otherwise(0))
    rates = drawn.withColumn("w", weight).groupBy("draw").agg(F.try_divide(F.sum(F.col("p") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("rate"))
    return rates.agg(F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("draws"))


def disjoint_split(rows: DataFrame, at: str, group: str, share: float) -> DataFrame:
    """Adds part: train up to the time by which `share` of the rows have happened, test after it; test rows of a group that
    train has seen are dropped as leaks."""
    (cut,) = order_values(rows.select(F.unix_micros(at).alias("at")), "at", [share])
    parted = rows.withColumn("part", F.when(F.unix_micros(at) <= F.lit(cut), "train").otherwise("test"))
    seen = parted.filter("part = 'train'").select(F.col(group).alias("__g")).distinct()
    leak = parted.filter("part = 'test'").join(seen, F.col(group) == F.col("__g"), "left_anti")
    return parted.filter("part = 'train'").unionByName(leak)


def component_split(rows: DataFrame, uid: str, links: Sequence[str], at: str, shares: tuple[float, float]) -> DataFrame:
    """A forward three-way split in which no component of rows that share any of `links` lies in two parts: uid, component,
    part by the component's last time."""
    edges = None
    for c in links:
        one = rows.filter(F.col(c).isNotNull()).select(F.concat(F.lit("row:"), F.col(uid).cast("string")).alias("a"), F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    member = components(edges).filter(F.col("id").startswith("row:")).select(F.substring(F.col("id"), 5, 1 << 20).alias("__uid"), "component")
    joined = rows.join(member, rows[uid].cast("string") == member["__uid"])
    last = joined.groupBy("component").agg(F.max(at).alias("last"))
    cuts = order_values(rows.select(F.unix_micros(at).alias("at")), "at", shares)
    part = F.when(F.unix_micros("last") <= F.lit(cuts[0]), "train").when(F.unix_micros("last") <= F.lit(cuts[1]), "validation").otherwise("test")
    return joined.join(last, "component").select(uid, "component", part.alias("part"))


def conformal_threshold(feedback: DataFrame, by: str, level: float, keep: int = 200) -> DataFrame:
    """Per `by` the smallest score that `level` of the last `keep` feedbacks reach, in order of feedback time, then uid."""
    newest = Window.partitionBy(by).orderBy(F.col("feedback_time").desc(), F.col("uid").desc())
    recent = feedback.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= keep)
    place = F.row_number().over(Window.partitionBy(by).orderBy("score", "uid"))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    ranked = recent.withColumn("__p", place).withColumn("__all", n)
    return ranked.filter(F.col("__p") == F.least(F.col("__all"), F.ceil((F.col("__all") + 1) * level))).select(by, F.col("score").alias("threshold"), F.col("__all").alias("used"))


def fuse(evidence: DataFrame, entity: str, now: Column, half_life: float) -> DataFrame:
    """Late fusion: the freshest value per entity and modality, weighted by reliability and half-life decay; mean and
    disagreement min(1, 2 * weighted deviation)."""
    fresh = evidence.groupBy(entity, "modality").agg(F.max(F.struct("at", "uid", "value", "reliability")).alias("r")).select(entity, "modality", "r.*")
    age = F.unix_seconds(now) - F.unix_seconds("at")
    w = fresh.withColumn("w", F.col("reliability") * F.pow(F.lit(2.0), -age / half_life))
    sums = w.groupBy(entity).agg(F.count(F.lit(1)).alias("modalities"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("value")).alias("sx"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("sxx"))
    mean = F.try_divide("sx", "sw")
    spread = F.sqrt(F.greatest(F.try_divide("sxx", "sw") - mean * mean, F.lit(0.0)))
    return sums.select(entity, "modalities", mean.alias("fused"), F.least(F.lit(1.0), 2 * spread).alias("disagreement"))
