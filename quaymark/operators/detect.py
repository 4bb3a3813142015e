"""Causal activity detection in five-minute buckets, as stages from observations to incidents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import bucket_end, logit, two_sided_tail
from quaymark.operators.asof import reasons
from quaymark.operators.ranks import sliced
from quaymark.session import small_side

SERIES = ("market_uid", "outcome_uid")
#: Fixed value: the median absolute deviation of a standard normal.
MAD_TO_SIGMA = 0.6744897501960817


@dataclass(frozen=True)
class Rules:
    width: int = 300
    carry: int = 600
    baseline: int = 7 * 86_400
    least_buckets: int = 288
    least_elapsed: int = 86_400
    least_values: int = 288
    least_tail: int = 100
    alpha: float = 0.05
    cooldown: int = 1800
    scheduled: int = 3600
    near_close: int = 3600
    thin: float = 100.0
    sibling_ratio: float = 0.25


def bucket_prices(obs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One price per series and bucket: the latest last trade, else the latest midpoint, else the middle of the latest bid and
    ask, else the latest snapshot; ties by uid. Five conditional maxima in one partial aggregate."""
    latest = F.struct("event_time", "observation_uid")
    pick = {k: F.max_by("price", F.when(F.col("kind") == k, latest)).alias(k) for k in ("last_trade", "midpoint", "best_bid", "best_ask", "platform_snapshot")}
    rows = obs.groupBy(*SERIES, bucket_end(F.col("event_time"), rules.width).alias("bucket")).agg(*pick.values(), F.max("event_time").alias("source_time"))
    return rows.select(*SERIES, "bucket", F.coalesce("last_trade", "midpoint", (F.col("best_bid") + F.col("best_ask")) / 2, "platform_snapshot").alias("price"), F.unix_seconds("source_time").alias("source_time"))


def bucket_fills(fills: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """volume, notional, imbalance (signed share), actors and concentration (sum of squared notional shares) per series and
    bucket. Actors are added up first, so a busy bucket is spread over its actors."""
    signed = F.when(F.upper("side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    money = F.col("price").cast("double") * F.col("size").cast("double")
    per = fills.groupBy(*SERIES, bucket_end(F.col("event_time"), rules.width).alias("bucket"), "actor_uid").agg(F.sum(F.col("size").cast("double")).alias("volume"), F.sum(money).alias("notional"), F.sum(signed.cast("double")).alias("signed"), F.count(F.lit(1)).alias("n"))
    seen = F.when(F.col("actor_uid").isNotNull(), F.col("notional"))
    return per.groupBy(*SERIES, "bucket").agg(
        F.sum("volume").alias("volume"), F.sum("notional").alias("notional"), F.try_divide(F.sum("signed"), F.sum("volume")).alias("imbalance"), F.count("actor_uid").alias("actors"), F.sum("n").alias("fills"),
        F.try_divide(F.sum(seen * seen), F.sum(seen) * F.sum(seen)).alias("concentration"),
    )


def dense_grid(prices: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every bucket from a series' first to its last observation; a missing price is carried forward while its source is
    at most `carry` seconds old at the bucket's end."""
    span = prices.groupBy(*SERIES).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = span.select(*SERIES, F.explode(F.sequence("lo", "hi", F.lit(rules.width).cast("long"))).alias("bucket"))
    order = Window.partitionBy(*SERIES).orderBy("bucket")
    filled = grid.join(prices, [*SERIES, "bucket"], "left").withColumn("__last", F.last(F.when(F.col("price").isNotNull(), F.struct("price", "source_time")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.col("bucket") - F.col("__last.source_time") <= rules.carry
    return filled.select(*SERIES, "bucket", F.col("price").isNotNull().alias("observed"), F.when(fresh, F.col("__last.price")).alias("price"))


def moves(grid: DataFrame) -> DataFrame:
    """Log-odds and their changes over one and six buckets of the dense grid."""
    order = Window.partitionBy(*SERIES).orderBy("bucket")
    df = grid.withColumn("logit", logit(F.col("price")))
    return df.withColumn("move_5", F.col("logit") - F.lag("logit", 1).over(order)).withColumn("move_30", F.col("logit") - F.lag("logit", 6).over(order))


def sibling_residual(df: DataFrame, events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """residual = move less the median move of other markets of the same event in the bucket; null without siblings.

    The moves of an event's bucket are gathered once, not paired; an event has at most some hundreds of markets."""
    joined = df.join(events.select("market_uid", "event_uid"), "market_uid", "left")
    group = Window.partitionBy("event_uid", "bucket")
    moved = joined.withColumn("__all", F.collect_list(F.when(F.col("move_5").isNotNull(), F.struct("market_uid", F.col("move_5").alias("m")))).over(group))
    others = F.array_sort(F.transform(F.filter("__all", lambda x: x["market_uid"] != F.col("market_uid")), lambda x: x["m"]))
    n = F.size("__others")
    middle = (F.get("__others", F.floor((n - 1) / 2).cast("int")) + F.get("__others", F.floor(n / 2).cast("int"))) / 2
    known = F.col("event_uid").isNotNull() & F.col("move_5").isNotNull() & (n > 0)
    out = moved.withColumn("__others", others).withColumn("__middle", F.when(known, middle))
    out = out.withColumn("siblings", F.when(F.col("event_uid").isNotNull(), n).otherwise(0).cast("long")).withColumn("residual", F.col("move_5") - F.col("__middle"))
    repriced = (F.col("move_5") * F.col("__middle") > 0) & (F.abs("residual") <= rules.sibling_ratio * F.greatest(F.abs("move_5"), F.lit(1e-12)))
    return out.withColumn("sibling_repricing", F.coalesce(repriced, F.lit(False))).drop("__all", "__others", "__middle")


def control_tags(at: Column, controlled: Column, live: Column, scheduled: Column, closes: Column, liquidity: Column, rules: Rules = Rules()) -> Column:
    """What may explain a move at `at` (seconds): sorted tags; one tag alone if the market has no control row."""
    left = F.unix_micros(closes) / 1e6 - at
    tags = {
        "live_event": live, "scheduled_announcement_window": F.abs(F.unix_micros(scheduled) / 1e6 - at) <= rules.scheduled, "time_to_close_lt_1h": left.between(0, rules.near_close),
        "liquidity_unknown": liquidity.isNull(), "thin_liquidity": liquidity < rules.thin,
    }
    return F.when(controlled, reasons(tags)).otherwise(F.array(F.lit("control_metadata_unavailable")))


def trailing_scores(df: DataFrame, value: str = "value", rules: Rules = Rules()) -> DataFrame:
    """Each bucket's `value` against the values of the `baseline` seconds before it (itself excluded).

    Adds n_buckets, n_values, median, mad, method (normal, tail or none), score and tail_p. A group is one series on a fixed
    grid: its size depends on the length of time, not on trades, so it fits a task at any volume. Null values are in the
    bucket count but not in the values. method is none where the baseline has fewer buckets, values or elapsed time
    than the rules ask; with a MAD of 0 the smoothed empirical tail (1 + as extreme) / (1 + n) is used instead.
    """
    names = ["n_buckets", "n_values", "median", "mad", "method", "score", "tail_p"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", n_buckets long, n_values long, median double, mad double, method string, score double, tail_p double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket").reset_index(drop=True)
        t, v = pdf["bucket"].to_numpy(), pdf[value].to_numpy(float)
        low = np.searchsorted(t, t - rules.baseline, "left")
        rows = []
        for i, start in enumerate(low):
            past = v[start:i]
            past = past[~np.isnan(past)]
            n = i - start
            if n < rules.least_buckets or t[i] - t[start] < rules.least_elapsed or len(past) < rules.least_values or np.isnan(v[i]):
                rows.append((n, len(past), None, None, "none", None, None))
                continue
            middle = float(np.median(past))
            away = np.abs(past - middle)
            mad = float(np.median(away))
            if mad > 0:
                rows.append((n, len(past), middle, mad, "normal", abs(MAD_TO_SIGMA * (v[i] - middle) / mad), None))
            elif len(past) >= rules.least_tail:
                p = (1 + int((away >= abs(v[i] - middle)).sum())) / (1 + len(past))
                rows.append((n, len(past), middle, mad, "tail", -np.log10(p), p))
            else:
                rows.append((n, len(past), middle, mad, "none", None, None))
        return pdf.join(pd.DataFrame(rows, columns=names))

    scored = df.groupBy(*SERIES).applyInPandas(run, schema)
    return scored.withColumn("p", F.when(F.col("method") == "normal", two_sided_tail(F.col("score"))).otherwise(F.col("tail_p")))


def benjamini_hochberg(df: DataFrame, group: str, p: str, tie: list[str]) -> DataFrame:
    """q per row among all rows of `group` with a p: the smallest p * m / rank of this and all higher ranks, at most 1."""
    has = df.filter(F.col(p).isNotNull())
    order = Window.partitionBy(group).orderBy(p, *tie)
    ranked = has.withColumn("bh_rank", F.row_number().over(order)).withColumn("bh_m", F.count(F.lit(1)).over(Window.partitionBy(group)))
    q = F.min(F.col(p) * F.col("bh_m") / F.col("bh_rank")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("q", F.least(F.lit(1.0), q))


def sessions(df: DataFrame, keys: list[str], at: str, gap: int, slice_rows: int = 2_000_000) -> DataFrame:
    """Adds session: a new one begins where more than `gap` seconds passed since the row before. A key of more than
    `slice_rows` rows is cut into stretches, which are counted apart and added up."""
    cut = sliced(df, keys, F.col(at), [at], 1, slice_rows)
    order = Window.partitionBy(*keys, "__slice").orderBy(at, F.col("__head").desc())
    fresh = F.coalesce(F.col(at) - F.lag(at).over(order) > gap, F.lit(True)).cast("int")
    marked = cut.withColumn("__new", fresh).filter(~F.col("__head")).drop("__head")
    own = marked.withColumn("session", F.sum("__new").over(Window.partitionBy(*keys, "__slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    per = marked.groupBy(*keys, "__slice").agg(F.sum("__new").alias("__n"))
    before = per.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    hot = cut.select("__slice").filter("__slice > 0").isEmpty()
    if hot:  # nothing was cut
        return own.drop("__new", "__slice")
    same = F.col("a.__slice") == F.col("b.__slice")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return own.alias("a").join(before.alias("b"), same).select("a.*", "b.__before").withColumn("session", F.col("session") + F.col("__before")).drop("__new", "__slice", "__before")


def incidents(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Abnormal signals of a series, joined while at most `cooldown` seconds apart; peak is the highest score, earliest on ties."""
    marked = sessions(signals, list(SERIES), "bucket", rules.cooldown)
    peak = F.struct(F.col("score").alias("s"), (-F.col("bucket")).alias("b"))
    return marked.groupBy(*SERIES, "session").agg(F.min("bucket").alias("started"), F.max("bucket").alias("ended"), F.count(F.lit(1)).alias("signals"), F.max("score").alias("peak_score"), (-F.max(peak)["b"]).alias("peak_bucket"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


CONTROLS = {"live_event": "boolean", "scheduled_announcement_at": "timestamp", "closes_at": "timestamp", "liquidity": "double"}


def detect(obs: DataFrame, fills: DataFrame, controls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """From observations and fills to incidents: prices, dense grid, moves, sibling residuals, trailing baselines,
    false-discovery control at each instant, sessions. `controls`: market_uid, event_uid and any of CONTROLS, a row a market;
    columns it lacks count as null."""
    known = controls.select("market_uid", F.lit(True).alias("controlled"), *[F.col(c) if c in controls.columns else F.lit(None).cast(t).alias(c) for c, t in CONTROLS.items()])
    sided = sibling_residual(moves(dense_grid(bucket_prices(obs, rules), rules)), controls, rules)
    volume = bucket_fills(fills, rules).select(*SERIES, "bucket", "volume")
    rows = sided.join(volume, [*SERIES, "bucket"], "left").withColumn("value", F.abs(F.coalesce("residual", "move_5")))
    scored = trailing_scores(rows.select(*SERIES, "bucket", "value", "sibling_repricing", "volume"), "value", rules)
    judged = benjamini_hochberg(scored, "bucket", "p", list(SERIES)).filter(F.col("q") <= rules.alpha).join(small_side(known), "market_uid", "left")
    tags = control_tags(F.col("bucket"), F.coalesce("controlled", F.lit(False)), *[F.col(c) for c in CONTROLS], rules)
    more = F.array_compact(F.array(F.when(F.col("sibling_repricing"), "sibling_repricing"), F.when(F.col("volume").isNull(), "no_fills")))
    return incidents(judged.withColumn("tags", F.array_sort(F.concat(tags, more))), rules)
