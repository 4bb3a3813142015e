"""Queries over actors: positions, features, ranks, cohorts and watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import surprise
from quaymark.operators.actors import RANKED, actor_features, cohort_ranking, cohort_scores, enroll, event_features, grouped_two_sided_tails, nearest, positions
from quaymark.operators.asof import admit, instant, ordered_reason, reasons
from quaymark.operators.ranks import running_counts
from quaymark.plans.market import FLT09, admission_reason, r6
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import FILLS, with_
from quaymark.sources.domain import fills
from quaymark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_M = "price * size"
_S = "CAST(size AS DOUBLE)"


@query("agg07_positions", with_(FILLS) + f"SELECT actor_uid, actor_visibility, outcome_uid, round(sum(CASE WHEN lower(side) = 'buy' THEN size ELSE 0 END), 4) AS bought, round(sum(CASE WHEN lower(side) = 'buy' THEN 0 ELSE size END), 4) AS sold, round(sum(CASE WHEN lower(side) = 'buy' THEN -{_M} ELSE {_M} END), 4) AS cashflow, count(*) AS n FROM f GROUP BY ALL")
def agg07(spark: SparkSession, folder: str) -> DataFrame:
    df = positions(fills(spark, folder))
    return df.select("actor_uid", "actor_visibility", "outcome_uid", F.round("bought", 4).alias("bought"), F.round("sold", 4).alias("sold"), F.round("cashflow", 4).alias("cashflow"), "n")


_AF = f"""po AS (SELECT actor_uid, market_uid, outcome_uid, count(*) AS n, sum({_S}) AS g, sum(CASE WHEN lower(side) = 'buy' THEN {_S} ELSE -{_S} END) AS net FROM f WHERE actor_uid IS NOT NULL GROUP BY ALL),
 af AS (SELECT actor_uid, CAST(sum(n) AS BIGINT) AS fills, count(DISTINCT market_uid) AS markets, count(*) AS outcomes, sum(g) AS gross, CASE WHEN sum(g) <> 0 THEN max(abs(net)) / sum(g) END AS concentration FROM po GROUP BY actor_uid)"""


@query("agg08_actor_features", with_(FILLS, _AF) + "SELECT actor_uid, fills, markets, outcomes, round(gross, 4) AS gross, round(concentration, 6) AS concentration FROM af")
def agg08(spark: SparkSession, folder: str) -> DataFrame:
    return actor_features(fills(spark, folder)).select("actor_uid", "fills", "markets", "outcomes", F.round("gross", 4).alias("gross"), r6("concentration"))


#: The market with the most fills is in focus, of its outcomes the one with the most.
_FOCUS = "fm AS (SELECT market_uid AS fm FROM f WHERE actor_uid IS NOT NULL AND event_time IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), fo AS (SELECT outcome_uid AS fo FROM f, fm WHERE market_uid = fm AND actor_uid IS NOT NULL AND event_time IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _features_sql(where: str = "true") -> str:
    """CTEs to ef: the nineteen features of the actors of f that meet `where`."""
    d = lambda c: f"CAST({c} AS DOUBLE)"
    share = lambda c, whole: f"CASE WHEN {whole} <> 0 THEN {d(c)} / {d(whole)} END"
    return f"""{_FOCUS}, ro AS (SELECT actor_uid, market_uid, outcome_uid, epoch_us(event_time) AS t, CAST(floor(epoch(event_time) / 3600) AS BIGINT) AS slot, {_M} AS m, price <= 0.1 AS shot, lower(side) = 'buy' AS b, market_uid = fm AS hm, outcome_uid = fo AS ho FROM f, fm, fo WHERE actor_uid IS NOT NULL AND event_time IS NOT NULL AND {where}),
 e0 AS (SELECT actor_uid, count(*) AS n, sum(m) AS g, coalesce(sum(m) FILTER (b), 0) AS buy, coalesce(sum(m) FILTER (b AND shot), 0) AS shots, max(m) AS top, max(t) - min(t) AS span, coalesce(sum(m) FILTER (hm), 0) AS fm_, coalesce(sum(m) FILTER (hm AND b), 0) AS fb, coalesce(sum(m) FILTER (ho), 0) AS om, coalesce(sum(m) FILTER (ho AND b), 0) AS ob FROM ro GROUP BY actor_uid),
 mb AS (SELECT actor_uid, max(m) AS dominant, count(*) AS markets FROM (SELECT actor_uid, market_uid, sum(m) AS m FROM ro GROUP BY ALL) GROUP BY actor_uid), ou AS (SELECT actor_uid, max(abs(m)) AS direction, count(*) AS outcomes FROM (SELECT actor_uid, outcome_uid, sum(CASE WHEN b THEN m ELSE -m END) AS m FROM ro GROUP BY ALL) GROUP BY actor_uid), sb AS (SELECT actor_uid, max(m) AS bm, max(n) AS bn FROM (SELECT actor_uid, slot, sum(m) AS m, count(*) AS n FROM ro GROUP BY ALL) GROUP BY actor_uid),
 ef AS (SELECT actor_uid, n AS fill_count, {d('g')} AS gross_notional, {d('buy')} AS buy_notional, {d('(g - buy)')} AS sell_notional, markets AS market_count, outcomes AS outcome_count, {share('buy', 'g')} AS buy_notional_share, {share('direction', 'g')} AS directional_concentration, {share('dominant', 'g')} AS dominant_market_share, {share('top', 'g')} AS max_fill_share, span / 1000000 AS active_span_seconds,
  {share('bm', 'g')} AS burst_notional_share, bn / n AS burst_fill_share, {share('shots', 'buy')} AS long_shot_buy_notional_share, {d('fb')} AS focus_buy_notional, {d('(2 * fb - fm_)')} AS focus_net_notional, {share('fm_', 'g')} AS focus_gross_notional_share, {d('ob')} AS focus_outcome_buy_notional, {d('(2 * ob - om)')} AS focus_outcome_net_notional FROM e0 JOIN mb USING (actor_uid) JOIN ou USING (actor_uid) JOIN sb USING (actor_uid))"""


_ROUNDED = ["gross_notional", "buy_notional", "sell_notional", "buy_notional_share", "directional_concentration", "dominant_market_share", "max_fill_share", "active_span_seconds", "burst_notional_share", "burst_fill_share", "long_shot_buy_notional_share", "focus_buy_notional", "focus_net_notional", "focus_gross_notional_share", "focus_outcome_buy_notional", "focus_outcome_net_notional"]
_COUNTS = ["fill_count", "market_count", "outcome_count"]


def _features(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Features with the focus on the busiest market and outcome of `whole`: two facts."""
    live = whole.filter("actor_uid is not null and event_time is not null")
    busiest = lambda df, c: (df.groupBy(c).count().orderBy(F.col("count").desc(), c).first() or [None])[0]
    market = busiest(live, "market_uid")
    return event_features(rows, market, busiest(live.filter(F.col("market_uid") == F.lit(market)), "outcome_uid"))


@query("agg10_event_features", with_(FILLS, _features_sql()) + f"SELECT actor_uid, {', '.join(_COUNTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM ef")
def agg10(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder)
    return _features(rows, rows).select("actor_uid", *_COUNTS, *[r6(c) for c in _ROUNDED])


@query("agg11_descriptive_rank", with_(FILLS, _AF) + "SELECT actor_uid, rank() OVER (ORDER BY fills DESC) AS rank, count(*) OVER (PARTITION BY fills) AS ties FROM af")
def agg11(spark: SparkSession, folder: str) -> DataFrame:
    """1 + number of larger ones: from counts per value, so that no task sorts all actors."""
    per = actor_features(fills(spark, folder)).select("actor_uid", "fills")
    values = per.groupBy("fills").agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_counts(values, "fills", ["ties"], descending=True).withColumn("rank", F.col("upto_ties") - F.col("ties") + 1)
    return per.join(ranked, "fills").select("actor_uid", "rank", "ties")


@query("agg12_replay_metrics", with_(FILLS, _AF) + "SELECT po.actor_uid, CAST(sum(n) AS BIGINT) AS fills, round(max(mn) / sum(n), 6) AS dominant_share FROM po JOIN (SELECT actor_uid, max(c) AS mn FROM (SELECT actor_uid, sum(n) AS c FROM po GROUP BY actor_uid, market_uid) GROUP BY actor_uid) USING (actor_uid) GROUP BY po.actor_uid")
def agg12(spark: SparkSession, folder: str) -> DataFrame:
    per = fills(spark, folder).filter("actor_uid is not null").groupBy("actor_uid", "market_uid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("actor_uid").agg(F.sum("n").alias("fills"), r6(F.max("n") / F.sum("n"), "dominant_share"))


@query("flt10_replay_reasons", with_(FILLS) + f"SELECT market_uid, count(*) FILTER (r = 'admitted') AS admitted, count(*) FILTER (r <> 'admitted') AS excluded FROM (SELECT market_uid, {FLT09} AS r FROM f) GROUP BY market_uid")
def flt10(spark: SparkSession, folder: str) -> DataFrame:
    ok = admission_reason() == "admitted"
    return fills(spark, folder).groupBy("market_uid").agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("excluded"))


@query("win13_upper_tail", with_(FILLS, _AF) + "SELECT actor_uid, round((count(*) OVER (ORDER BY fills DESC RANGE UNBOUNDED PRECEDING)) / (SELECT count(*) FROM af), 6) AS tail, round(-log10((count(*) OVER (ORDER BY fills DESC RANGE UNBOUNDED PRECEDING)) / (SELECT count(*) FROM af)), 6) AS surprise FROM af")
def win13(spark: SparkSession, folder: str) -> DataFrame:
    per = actor_features(fills(spark, folder)).select("actor_uid", "fills")
    values = per.groupBy("fills").agg(F.count(F.lit(1)).alias("c"))
    n = values.agg(F.sum("c")).scalar()
    tails = running_counts(values, "fills", ["c"], descending=True).withColumn("tail", F.col("upto_c") / n)
    return per.join(tails, "fills").select("actor_uid", r6("tail"), r6(surprise(F.col("tail")), "surprise"))


_TWO = "t AS (SELECT market_uid, fill_uid, CAST(price AS DOUBLE) AS v FROM f), l AS (SELECT a.market_uid, a.fill_uid, a.v, median(b.v) AS m FROM t a JOIN t b ON a.market_uid = b.market_uid AND a.fill_uid <> b.fill_uid GROUP BY ALL)"


@query("win14_two_sided_tail", with_(FILLS, _TWO) + "SELECT l.fill_uid, round(l.m, 6) AS loo_median, round((1 + count(*) FILTER (abs(b.v - l.m) >= abs(l.v - l.m) - 1e-12)) / (1 + count(*)), 6) AS tail FROM l JOIN t b ON l.market_uid = b.market_uid AND l.fill_uid <> b.fill_uid GROUP BY l.fill_uid, l.m")
def win14(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder).select("market_uid", "fill_uid", F.col("price").cast("double").alias("v"))
    return grouped_two_sided_tails(rows, "market_uid", "fill_uid", "v").filter("tail is not null").select("fill_uid", r6("loo_median"), r6("tail"))


#: What a cohort admits: fills of public wallets that happened and were known by the cut-off, in that order.
_ADMIT = "actor_visibility = 'public_wallet' AND event_time <= TIMESTAMP '2024-03-20' AND ingested_at <= TIMESTAMP '2024-03-20' AND event_time <= ingested_at"


def _composite_sql() -> str:
    """CTEs to cp: composite of each admitted actor."""
    high = [c for c, tail in RANKED.items() if tail == "high"]
    count = lambda c: f"(SELECT count({c}) FROM er)"
    tails = ", ".join(f"CASE WHEN {c} IS NOT NULL AND {count(c)} > 200 THEN -log10((count({c}) OVER (ORDER BY {c} DESC NULLS LAST RANGE UNBOUNDED PRECEDING)) / {count(c)}) END AS s_{c}" for c in high)
    every = ", ".join(f"s_{c}" for c in RANKED)
    return f"""{_features_sql(_ADMIT)}, er AS (SELECT actor_uid, fill_count, {', '.join(f'round({c}, 9) AS {c}' for c in RANKED if c != 'fill_count')} FROM ef), hi AS (SELECT actor_uid, {tails} FROM er),
 lo AS (SELECT a.actor_uid, any_value(a.active_span_seconds) AS v, median(b.active_span_seconds) AS m FROM er a JOIN er b ON a.actor_uid <> b.actor_uid GROUP BY a.actor_uid), ts AS (SELECT lo.actor_uid, CASE WHEN {count('active_span_seconds')} > 200 THEN -log10((1 + count(*) FILTER (abs(b.active_span_seconds - m) >= abs(v - m))) / (1 + count(*))) END AS s_active_span_seconds FROM lo JOIN er b ON lo.actor_uid <> b.actor_uid GROUP BY lo.actor_uid, v, m),
 sp AS (SELECT actor_uid, list_filter([{every}], lambda x: x IS NOT NULL) AS l FROM hi LEFT JOIN ts USING (actor_uid)), cp AS (SELECT actor_uid, (SELECT count(*) - 1 FROM er) AS peers, len(l) AS supported, CASE WHEN len(l) >= 6 THEN round(list_avg(list_slice(list_reverse_sort(list_transform(l, lambda x: least(x, 3.0))), 1, 5)), 6) END AS composite FROM sp)"""


_COMP = _composite_sql()


def _composites(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the actors admitted at the cut-off. Values count as equal to nine places, composites to six."""
    rows, cut = fills(spark, folder), instant("2024-03-20")
    admitted = rows.filter((F.col("actor_visibility") == "public_wallet") & (F.col("event_time") <= cut) & (F.col("ingested_at") <= cut) & (F.col("event_time") <= F.col("ingested_at")))
    features = _features(admitted, rows).select("actor_uid", *[c if c == "fill_count" else F.round(c, 9).alias(c) for c in RANKED])
    return cohort_scores(features).withColumn("composite", F.round("composite", 6))


@query("win15_composite", with_(FILLS, _COMP) + "SELECT actor_uid, supported, composite FROM cp")
def win15(spark: SparkSession, folder: str) -> DataFrame:
    return _composites(spark, folder).select("actor_uid", "supported", "composite")


@query("cmp05_cohort_ranking", with_(FILLS, _COMP) + """, n AS (SELECT count(composite) AS n FROM cp), k AS (SELECT actor_uid, composite, rank() OVER (ORDER BY composite DESC) AS rank, count(*) OVER (PARTITION BY composite) AS ties FROM cp WHERE composite IS NOT NULL), p AS (SELECT k.*, (n - rank + 1 - ties + (ties - 1) / 2 + 0.5) / n AS p FROM k, n),
 c AS (SELECT DISTINCT actor_uid FROM f WHERE actor_uid IS NOT NULL), j AS (SELECT c.actor_uid, CASE WHEN peers IS NULL THEN 'candidate_activity_unavailable' WHEN peers < 200 THEN 'peer_count_below_minimum' WHEN cp.composite IS NULL THEN 'insufficient_supported_features' WHEN (SELECT n FROM n) - 1 < 200 THEN 'cohort_calibration_support_insufficient' END AS reason, p.composite, p, rank FROM c LEFT JOIN cp USING (actor_uid) LEFT JOIN p USING (actor_uid))
 SELECT actor_uid, CASE WHEN reason IS NULL THEN 'available' ELSE 'abstain' END AS status, reason, CASE WHEN reason IS NULL THEN composite END AS composite, CASE WHEN reason IS NULL THEN round(p, 6) END AS percentile, CASE WHEN reason IS NULL THEN rank END AS rank, CASE WHEN reason IS NOT NULL THEN 'insufficient_data' WHEN p >= 0.99 THEN 'high' WHEN p >= 0.95 THEN 'elevated' ELSE 'routine' END AS classification FROM j""")
def cmp05(spark: SparkSession, folder: str) -> DataFrame:
    """Every actor ranked against the admitted cohort, or abstained from with a reason."""
    candidates = table(spark, folder, "fills").filter("actor_uid is not null")
    return cohort_ranking(candidates, _composites(spark, folder)).withColumn("percentile", F.round("percentile", 6))


@query("win18_priority_queue", with_(FILLS, _AF) + "SELECT actor_uid, row_number() OVER (ORDER BY fills DESC, concentration IS NULL, concentration DESC, actor_uid) AS place FROM (SELECT actor_uid, fills, round(concentration, 6) AS concentration FROM af) QUALIFY place <= 25")
def win18(spark: SparkSession, folder: str) -> DataFrame:
    """A budget of 25: the top is taken before places are numbered."""
    per = actor_features(fills(spark, folder)).select("actor_uid", "fills", r6("concentration"))
    order = [F.col("fills").desc(), F.col("concentration").desc_nulls_last(), F.col("actor_uid")]
    return per.orderBy(*order).limit(25).select("actor_uid", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("jn13_nearest_peers", with_(FILLS, _AF, "n AS (SELECT actor_uid, CASE WHEN markets > 3 THEN 'wide' ELSE 'narrow' END AS style, CAST(fills AS DOUBLE) AS x, CAST(markets AS DOUBLE) AS y FROM af), sd AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM n), d AS (SELECT a.actor_uid, n.actor_uid AS peer, sqrt(pow((a.x - n.x) / sx, 2) + pow((a.y - n.y) / sy, 2)) AS distance FROM n a LEFT JOIN n ON a.style = n.style AND a.actor_uid <> n.actor_uid, sd), p AS (SELECT *, row_number() OVER (PARTITION BY actor_uid ORDER BY distance, peer) AS place FROM d), q AS (SELECT actor_uid, CASE WHEN count(peer) < 20 THEN 'nuisance_peer_support_insufficient' WHEN max(distance) > 4 THEN 'nuisance_support_ood' END AS reason FROM p WHERE place <= 20 GROUP BY actor_uid)") + "SELECT actor_uid, round(distance, 6) AS distance, CASE WHEN peer IS NOT NULL THEN place END AS place, reason FROM p JOIN q USING (actor_uid) WHERE place <= 20")
def jn13(spark: SparkSession, folder: str) -> DataFrame:
    rows = actor_features(fills(spark, folder)).select("actor_uid", F.when(F.col("markets") > 3, "wide").otherwise("narrow").alias("style"), F.col("fills").cast("double").alias("x"), F.col("markets").cast("double").alias("y"))
    return nearest(rows, "actor_uid", ["x", "y"], 20, "style", 4.0).select("actor_uid", r6("distance"), F.col("place").cast("long").alias("place"), "reason")


@query("cmp07_dual_clock_replay", with_(FILLS) + "SELECT actor_uid, count(*) FILTER (event_time <= TIMESTAMP '2024-03-10') AS retrospective, count(*) FILTER (event_time <= TIMESTAMP '2024-03-10' AND ingested_at <= TIMESTAMP '2024-03-10') AS prospective FROM f WHERE actor_uid IS NOT NULL GROUP BY actor_uid")
def cmp07(spark: SparkSession, folder: str) -> DataFrame:
    past, known = F.col("event_time") <= instant("2024-03-10"), F.col("ingested_at") <= instant("2024-03-10")
    return fills(spark, folder).filter("actor_uid is not null").groupBy("actor_uid").agg(F.count_if(past).alias("retrospective"), F.count_if(past & known).alias("prospective"))


@query("cmp09_watch_enrolment", with_(FILLS, "r AS (SELECT actor_uid, max(event_time) + INTERVAL 2 DAY AS expires_at FROM f WHERE actor_uid IS NOT NULL AND event_time < TIMESTAMP '2024-03-10' GROUP BY actor_uid), t AS (SELECT actor_uid FROM f WHERE actor_uid IS NOT NULL AND event_time >= TIMESTAMP '2024-03-10' AND event_time < TIMESTAMP '2024-03-12' GROUP BY actor_uid ORDER BY count(*) DESC, actor_uid LIMIT 20)") + "SELECT actor_uid, CASE WHEN 1710201600 - floor(epoch(expires_at)) < 0 THEN 'active_duplicate' WHEN 1710201600 - floor(epoch(expires_at)) < 86400 THEN 'cooldown' ELSE 'enrolled' END AS decision FROM t LEFT JOIN r USING (actor_uid)")
def cmp09(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder).filter("actor_uid is not null")
    two = rows.filter((F.col("event_time") >= instant("2024-03-10")) & (F.col("event_time") < instant("2024-03-12")))
    top = two.groupBy("actor_uid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "actor_uid").limit(20)
    held = rows.filter(F.col("event_time") < instant("2024-03-10")).groupBy("actor_uid").agg((F.max("event_time") + F.expr("interval 2 days")).alias("expires_at"))
    return enroll(top, held, instant("2024-03-12"), 86_400).select("actor_uid", "decision")


@query("ctr01_population_coverage", "WITH g AS (SELECT fill_uid, count(*) AS n, count(DISTINCT (price, size, market_uid)) AS m FROM fills GROUP BY fill_uid) SELECT CAST(sum(n) AS BIGINT) AS raw, count(*) AS canonical, CAST(sum(CASE WHEN m = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN m > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS conflicts, CAST([] AS VARCHAR[]) AS reasons FROM g")
def ctr01(spark: SparkSession, folder: str) -> DataFrame:
    meaning = F.struct("price", "size", "market_uid")
    per = table(spark, folder, "fills").groupBy("fill_uid").agg(F.count(F.lit(1)).alias("n"), (F.min(meaning) == F.max(meaning)).alias("same"))
    one = per.agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("canonical"), F.sum(F.when(F.col("same"), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(F.col("same"), 0).otherwise(F.col("n") - 1)).alias("conflicts"))
    return one.withColumn("reasons", reasons({"counts_do_not_reconcile": F.col("raw") != F.col("canonical") + F.col("duplicates") + F.col("conflicts"), "empty_population": F.col("raw") == 0}))


@query("ctr02_longitudinal_states", with_(FILLS) + "SELECT actor_uid, CASE WHEN n_old = 0 THEN 'missing' WHEN n_known = 0 THEN 'unavailable' WHEN n_known < 3 THEN 'ineligible' ELSE 'available' END AS state FROM (SELECT actor_uid, count(*) FILTER (event_time < TIMESTAMP '2024-03-05') AS n_old, count(*) FILTER (event_time < TIMESTAMP '2024-03-05' AND ingested_at < TIMESTAMP '2024-03-05') AS n_known FROM f WHERE actor_uid IS NOT NULL GROUP BY actor_uid)")
def ctr02(spark: SparkSession, folder: str) -> DataFrame:
    old, known = F.col("event_time") < instant("2024-03-05"), F.col("ingested_at") < instant("2024-03-05")
    per = fills(spark, folder).filter("actor_uid is not null").groupBy("actor_uid").agg(F.count_if(old).alias("n_old"), F.count_if(old & known).alias("n_known"))
    return per.select("actor_uid", ordered_reason([("missing", F.col("n_old") == 0), ("unavailable", F.col("n_known") == 0), ("ineligible", F.col("n_known") < 3)], "available").alias("state"))


@query("agg31_risk_prior", with_(FILLS, _AF) + "SELECT actor_uid, round(1 / (1 + exp(-(-2 + 0.01 * fills + 0.1 * markets + 1.5 * concentration))), 6) AS prior FROM af WHERE concentration IS NOT NULL")
def agg31(spark: SparkSession, folder: str) -> DataFrame:
    from quaymark.functions.scalars import sigmoid

    df = actor_features(fills(spark, folder)).filter("concentration is not null")
    return df.select("actor_uid", r6(sigmoid(-2 + 0.01 * F.col("fills") + 0.1 * F.col("markets") + 1.5 * F.col("concentration")), "prior"))
