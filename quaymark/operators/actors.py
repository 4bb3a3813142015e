"""Actor positions, features, peer-relative ranks and watches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import surprise
from quaymark.operators.asof import ordered_reason
from quaymark.operators.ranks import placed, two_sided_tails, upper_tails
from quaymark.session import materialise


def _money() -> Column:
    """Exact: decimal(12,10) by decimal(24,10), so sums don't depend on the order of rows."""
    return F.col("price") * F.col("size")


def _buy() -> Column:
    return F.lower("side") == "buy"


def positions(fills: DataFrame) -> DataFrame:
    """Per actor, visibility and outcome: bought, sold, net, cashflow, notional, n."""
    size, money, none = F.col("size"), _money(), F.lit(0).cast("decimal(24,10)")
    return fills.groupBy("actor_uid", "actor_visibility", "outcome_uid").agg(
        F.sum(F.when(_buy(), size).otherwise(none)).alias("bought"), F.sum(F.when(_buy(), none).otherwise(size)).alias("sold"), F.sum(F.when(_buy(), size).otherwise(-size)).alias("net"),
        F.sum(F.when(_buy(), -money).otherwise(money)).alias("cashflow"), F.sum(money).alias("notional"), F.count(F.lit(1)).alias("n"),
    )


def actor_features(fills: DataFrame) -> DataFrame:
    """Per actor: fills, markets, outcomes, gross, directional concentration (largest net outcome position over gross)."""
    size = F.col("size").cast("double")
    per = fills.filter("actor_uid is not null").groupBy("actor_uid", "market_uid", "outcome_uid").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("gross"), F.sum(F.when(_buy(), size).otherwise(-size)).alias("net"))
    markets = per.groupBy("actor_uid", "market_uid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("outcomes"), F.sum("gross").alias("gross"), F.max(F.abs("net")).alias("net"))
    return markets.groupBy("actor_uid").agg(F.sum("n").alias("fills"), F.count(F.lit(1)).alias("markets"), F.sum("outcomes").alias("outcomes"), F.sum("gross").alias("gross"), F.try_divide(F.max("net"), F.sum("gross")).alias("concentration"))


def event_features(fills: DataFrame, focus_market: str | None = None, focus_outcome: str | None = None, burst: int = 3600, long_shot: float = 0.1) -> DataFrame:
    """Nineteen features of each actor's fills of known time; sums are exact, shares are null where their whole is zero, those
    of a focus that is not given are zero (market) or null (outcome).

    One pass to the grain actor x market x outcome x window, aggregated before the shuffle, so a hot actor's rows spread over
    its grains; then per market, outcome and window, and per actor.
    """
    none = F.lit(0).cast("decimal(38,20)")
    rows = fills.filter("actor_uid is not null and event_time is not null").select("actor_uid", "market_uid", "outcome_uid", F.floor(F.unix_seconds("event_time") / burst).alias("slot"), _money().alias("m"), (F.col("price") <= F.lit(long_shot).cast("decimal(12,10)")).alias("shot"), _buy().alias("buy"), F.unix_micros("event_time").alias("t"))
    bought = F.when(F.col("buy"), F.col("m"))
    grain = rows.groupBy("actor_uid", "market_uid", "outcome_uid", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.coalesce(F.sum(bought), none).alias("b"), F.coalesce(F.sum(F.when(F.col("shot"), bought)), none).alias("shots"), F.max("m").alias("top"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    by_market = grain.groupBy("actor_uid", "market_uid").agg(F.sum("m").alias("mm")).groupBy("actor_uid").agg(F.max("mm").alias("dominant"), F.count(F.lit(1)).alias("market_count"))
    by_outcome = grain.groupBy("actor_uid", "outcome_uid").agg((2 * F.sum("b") - F.sum("m")).alias("net")).groupBy("actor_uid").agg(F.max(F.abs("net")).alias("direction"), F.count(F.lit(1)).alias("outcome_count"))
    by_slot = grain.groupBy("actor_uid", "slot").agg(F.sum("n").alias("sn"), F.sum("m").alias("sm")).groupBy("actor_uid").agg(F.max("sn").alias("burst_n"), F.max("sm").alias("burst_m"))
    here, there = F.col("market_uid") == F.lit(focus_market), F.col("outcome_uid") == F.lit(focus_outcome)
    on = lambda where, c: F.coalesce(F.sum(F.when(where, F.col(c))), none)
    total = grain.groupBy("actor_uid").agg(
        F.sum("n").alias("fill_count"), F.sum("m").alias("gross"), F.sum("b").alias("buy"), F.sum("shots").alias("shots"), F.max("top").alias("top"), (F.max("t1") - F.min("t0")).alias("span"),
        on(here, "m").alias("focus_m"), on(here, "b").alias("focus_b"), on(there, "m").alias("outcome_m"), on(there, "b").alias("outcome_b"),
    )
    out = total.join(by_market, "actor_uid").join(by_outcome, "actor_uid").join(by_slot, "actor_uid")
    d = lambda c: F.col(c).cast("double")
    share = lambda c, whole: F.try_divide(d(c), d(whole))
    outcome = lambda c: c if focus_outcome is not None else F.lit(None).cast("double")
    return out.select(
        "actor_uid", "fill_count", d("gross").alias("gross_notional"), d("buy").alias("buy_notional"), (F.col("gross") - F.col("buy")).cast("double").alias("sell_notional"), "market_count", "outcome_count",
        share("buy", "gross").alias("buy_notional_share"), share("direction", "gross").alias("directional_concentration"), share("dominant", "gross").alias("dominant_market_share"), share("top", "gross").alias("max_fill_share"),
        (F.col("span") / 1_000_000).alias("active_span_seconds"), share("burst_m", "gross").alias("burst_notional_share"), (F.col("burst_n") / F.col("fill_count")).alias("burst_fill_share"), share("shots", "buy").alias("long_shot_buy_notional_share"),
        d("focus_b").alias("focus_buy_notional"), (2 * F.col("focus_b") - F.col("focus_m")).cast("double").alias("focus_net_notional"), share("focus_m", "gross").alias("focus_gross_notional_share"),
        outcome(d("outcome_b")).alias("focus_outcome_buy_notional"), outcome((2 * F.col("outcome_b") - F.col("outcome_m")).cast("double")).alias("focus_outcome_net_notional"),
    )


#: Features of the cohort's ranking and whether one tail or both are unusual.
RANKED = {
    "fill_count": "high", "gross_notional": "high", "buy_notional_share": "high", "directional_concentration": "high", "dominant_market_share": "high", "max_fill_share": "high", "active_span_seconds": "two_sided",
    "burst_notional_share": "high", "burst_fill_share": "high", "long_shot_buy_notional_share": "high", "focus_buy_notional": "high", "focus_net_notional": "high", "focus_gross_notional_share": "high",
}


@dataclass(frozen=True)
class CohortPolicy:
    least_peers: int = 200
    least_features: int = 6
    top: int = 5
    clip: float = 3.0
    high: float = 0.99
    elevated: float = 0.95


def cohort_scores(features: DataFrame, policy: CohortPolicy = CohortPolicy()) -> DataFrame:
    """actor_uid, peers, supported (features with enough peers) and composite: the mean of the largest clipped surprises, null
    with too few supported features. `features`: a row an actor, rounded as they are to be compared."""
    high, both = [c for c, tail in RANKED.items() if tail == "high"], [c for c, tail in RANKED.items() if tail != "high"]
    df = upper_tails(features, "actor_uid", high)
    for c in both:
        df = two_sided_tails(df, "actor_uid", c)
    df = materialise(df, "tails")
    counts = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(c).alias(c) for c in RANKED]).first()  # one row
    known = [F.when(F.lit(counts[c] - 1 >= policy.least_peers), surprise(F.col(f"tail_{c}"))) for c in RANKED]
    score = composite(F.array(*known), policy.top, policy.least_features, policy.clip)
    return df.select("actor_uid", F.lit(counts["all"] - 1).cast("long").alias("peers"), F.size(F.array_compact(F.array(*known))).cast("long").alias("supported"), score.alias("composite"))


def cohort_ranking(candidates: DataFrame, scores: DataFrame, policy: CohortPolicy = CohortPolicy()) -> DataFrame:
    """Every candidate: available with percentile, rank and class among all scored actors, or abstained with the first reason."""
    ranked = placed(scores, "composite")
    n = scores.agg(F.count("composite")).scalar()
    rows = candidates.select("actor_uid").distinct().join(ranked, "actor_uid", "left")
    reason = ordered_reason(
        [("candidate_activity_unavailable", F.col("peers").isNull()), ("peer_count_below_minimum", F.col("peers") < policy.least_peers), ("insufficient_supported_features", F.col("composite").isNull()), ("cohort_calibration_support_insufficient", n - 1 < policy.least_peers)], "none"
    )
    out = rows.withColumn("reason", F.nullif(reason, F.lit("none")))
    ok, p = F.col("reason").isNull(), F.col("percentile")
    kind = F.when(~ok, "insufficient_data").when(p >= policy.high, "high").when(p >= policy.elevated, "elevated").otherwise("routine")
    return out.select("actor_uid", F.when(ok, "available").otherwise("abstain").alias("status"), "reason", F.when(ok, F.col("composite")).alias("composite"), F.when(ok, p).alias("percentile"), F.when(ok, F.col("rank")).alias("rank"), kind.alias("classification"))


def grouped_two_sided_tails(df: DataFrame, group: str, uid: str, value: str) -> DataFrame:
    """Leave-one-out two-sided tail around the leave-one-out median, per group. Rows of equal value have equal results, so
    rows are first counted per value; positions come from the cumulative counts, and a group holds its distinct values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        v, upto = pdf[value].to_numpy(float), np.cumsum(pdf["__n"].to_numpy())
        n, none = int(upto[-1]), np.full(len(v), np.nan)
        m, below = n - 1, np.concatenate([[0], upto])
        if not m:
            return pd.DataFrame({group: pdf[group], value: v, "loo_median": none, "tail": none})
        at = lambda k: v[np.searchsorted(upto, np.where(k < below[:-1], k, k + 1), "right")]  # the k-th of the others
        middle = (at((m - 1) // 2) + at(m // 2)) / 2
        away = np.abs(v - middle) - 1e-12  # what differs by rounding only is as extreme
        extreme = below[np.searchsorted(v, middle - away, "right")] + n - below[np.searchsorted(v, middle + away, "left")]
        return pd.DataFrame({group: pdf[group], value: v, "loo_median": middle, "tail": np.where(away > 0, extreme, n) / n})

    rows = df.filter(F.col(value).isNotNull()).select(group, uid, F.col(value).cast("double").alias(value))
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    tails = counts.groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, {value} double, loo_median double, tail double")
    both = rows.alias("r").join(tails.alias("t"), F.col(f"r.{group}").eqNullSafe(F.col(f"t.{group}")) & (F.col(f"r.{value}") == F.col(f"t.{value}")))
    return both.select(f"r.{group}", f"r.{uid}", "loo_median", "tail")


def composite(surprises: Column, top: int = 5, least: int = 6, clip: float = 6.0) -> Column:
    """Mean of the `top` largest clipped surprises of an array; null with fewer than `least` known ones."""
    known = F.array_compact(surprises)
    best = F.slice(F.reverse(F.array_sort(F.transform(known, lambda s: F.least(s, F.lit(clip))))), 1, top)
    return F.when(F.size(known) >= least, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best))


def nearest(df: DataFrame, uid: str, features: Sequence[str], k: int, group: str, furthest: float) -> DataFrame:
    """The `k` nearest peers of every row within its group by Euclid over `features` scaled by their deviation; ties by uid.
    reason is null with support, else nuisance_peer_support_insufficient (fewer than `k` peers; one row even without any)
    or nuisance_support_ood (the k-th lies beyond `furthest`).

    Rows of equal features have equal distances: distinct points are paired, each standing for its first k + 1 uids, and
    the k + 1 nearest of a point hold the `k` nearest of each of its rows. Rows are never paired."""
    spread = df.select(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(c) for c in features]).first()
    place = F.row_number().over(Window.partitionBy(group, *features).orderBy(uid))
    points = df.select(uid, group, *features).withColumn("__place", place).filter(F.col("__place") <= k + 1).groupBy(group, *features).agg(F.collect_list(uid).alias("__uids"))
    peers = points.select(group, F.col("__uids").alias("__peers"), *[F.col(c).alias(f"p_{c}") for c in features])
    distance = F.sqrt(sum((F.pow((F.col(c) - F.col(f"p_{c}")) / spread[c], F.lit(2.0)) for c in features), F.lit(0.0)))
    point = Window.partitionBy(group, *features)
    pairs = points.drop("__uids").join(peers, group).select(group, *features, distance.alias("distance"), "__peers")
    upto = F.sum(F.size("__peers")).over(point.orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(F.size("__peers")).over(Window.partitionBy(group, *features, "distance"))
    close = pairs.withColumn("__closer", upto - same).filter(F.col("__closer") <= k)
    near = close.select(group, *features, "distance", F.explode("__peers").alias("peer"))
    near = near.withColumn("__place", F.row_number().over(point.orderBy("distance", "peer"))).filter(F.col("__place") <= k + 1).drop("__place")
    a, b = df.select(uid, group, *features).alias("a"), near.alias("b")
    on = F.col(f"a.{uid}") != F.col("b.peer")
    for c in [group, *features]:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    own = Window.partitionBy(uid)
    met = a.join(b, on, "left").select(f"a.{uid}", "b.peer", "b.distance").withColumn("place", F.row_number().over(own.orderBy("distance", "peer"))).filter(F.col("place") <= k)
    reason = F.when(F.count("peer").over(own) < k, "nuisance_peer_support_insufficient").when(F.max("distance").over(own) > furthest, "nuisance_support_ood")
    return met.select(uid, "peer", "distance", F.when(F.col("peer").isNotNull(), F.col("place")).alias("place"), reason.alias("reason"))


def enroll(top: DataFrame, registered: DataFrame, now: Column, cooldown: int) -> DataFrame:
    """Watch decisions: active_duplicate, cooldown or enrolled, from each actor's latest registration."""
    latest = registered.groupBy("actor_uid").agg(F.max("expires_at").alias("expires_at"))
    both = top.join(latest, "actor_uid", "left")
    left = F.unix_seconds(now) - F.unix_seconds("expires_at")
    return both.withColumn("decision", F.when(left < 0, "active_duplicate").when(left < cooldown, "cooldown").otherwise("enrolled"))
