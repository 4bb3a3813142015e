"""Queries over ticks, prices, fills and books: scans, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import ERF_NEAR, ERFC_FAR, ERFC_MIDDLE, bucket_end, depth, feature_bucket_end, level_order_ok
from quaymark.operators.asof import admit, asof_join, available_at, classify_append, extreme_row, in_window, instant, keyset_page, ordered_reason, reasons
from quaymark.operators.coverage import contiguous, covered_ratio, gaps
from quaymark.operators.detect import MAD_TO_SIGMA, SERIES, Rules, benjamini_hochberg, bucket_fills, bucket_prices, control_tags, dense_grid, detect, moves, sessions, sibling_residual, trailing_scores
from quaymark.operators.shocks import belief_shocks
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import BOOKS, EFILLS, FILLS, OBS, with_
from quaymark.session import small_side
from quaymark.sources.domain import books, event_fills, fills, observations
from quaymark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
CUTOFF = "2024-01-15 00:00:00"
FILL_CUTOFF = "2024-03-10 00:00:00"


def us(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or (c if isinstance(c, str) else "value"))


# --- scans -----------------------------------------------------------------------------------------------------------
@query("src01_tick_scan", with_(OBS) + "SELECT market_uid, epoch_us(event_time) AS event_time, round(price, 6) AS price, NULL::VARCHAR AS actor_uid FROM obs UNION ALL SELECT market_uid, epoch_us(event_time), round(CAST(price AS DOUBLE), 6), actor_uid FROM fills WHERE event_time IS NOT NULL")
def src01(spark: SparkSession, folder: str) -> DataFrame:
    """Two tick files of different columns, united by name."""
    a = observations(spark, folder).select("market_uid", us("event_time"), r6("price"))
    b = table(spark, folder, "fills").filter("event_time is not null").select("market_uid", us("event_time"), r6(F.col("price").cast("double"), "price"), "actor_uid")
    return a.unionByName(b, allowMissingColumns=True)


@query("src02_columns")
def src02(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that a table has, of those a caller may use."""
    have = set(table(spark, folder, "fills").columns)
    return spark.createDataFrame([(c, c in have) for c in ("actor_uid", "maker", "taker", "wallet", "size")], "name string, present boolean")


@query("src04_complete_ticks", "SELECT market_uid, actor_uid, epoch_us(event_time) AS event_time, transaction_uid FROM fills WHERE actor_uid IS NOT NULL AND event_time IS NOT NULL AND transaction_uid IS NOT NULL AND market_uid IS NOT NULL")
def src04(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fills").select("market_uid", "actor_uid", us("event_time"), "transaction_uid").na.drop()


# --- admission -------------------------------------------------------------------------------------------------------
@query("flt01_as_of", with_(OBS) + f"SELECT observation_uid, epoch_us(event_time) AS event_time, epoch_us(ingested_at) AS ingested_at FROM obs WHERE event_time <= TIMESTAMP '{CUTOFF}' AND ingested_at <= TIMESTAMP '{CUTOFF}'")
def flt01(spark: SparkSession, folder: str) -> DataFrame:
    return admit(observations(spark, folder), CUTOFF).select("observation_uid", us("event_time"), us("ingested_at"))


@query("flt02_available_at", "SELECT evidence_uid AS uid, 'document' AS modality, epoch_us(first_seen_at) AS available_at FROM evidence UNION ALL SELECT 'fill-' || delivery_id, 'fill', epoch_us(ingested_at) FROM fills")
def flt02(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "evidence").select(F.col("evidence_uid").alias("uid"), F.lit("document").alias("modality"), "first_seen_at", F.col("retrieved_at").alias("ingested_at"))
    trades = table(spark, folder, "fills").select(F.concat(F.lit("fill-"), F.col("delivery_id")).alias("uid"), F.lit("fill").alias("modality"), F.lit(None).cast("timestamp").alias("first_seen_at"), "ingested_at")
    both = docs.unionByName(trades)
    return both.select("uid", "modality", F.unix_micros(available_at(F.col("modality"), F.col("first_seen_at"), F.col("ingested_at"))).alias("available_at"))


@query("flt03_evidence_as_of", f"SELECT evidence_uid FROM evidence WHERE first_seen_at <= TIMESTAMP '{FILL_CUTOFF}' AND source IN ('wire-aldor', 'desk-lumen', 'gazette-esk')")
def flt03(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence").filter((F.col("first_seen_at") <= instant(FILL_CUTOFF)) & F.col("source").isin("wire-aldor", "desk-lumen", "gazette-esk")).select("evidence_uid")


@query("flt04_revisions", f"SELECT document_uid, count(DISTINCT revision_uid) AS revisions, epoch_us(min(first_seen_at)) AS first_seen, epoch_us(max(first_seen_at)) AS last_seen FROM evidence WHERE first_seen_at <= TIMESTAMP '{FILL_CUTOFF}' GROUP BY document_uid")
def flt04(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "evidence").filter(F.col("first_seen_at") <= instant(FILL_CUTOFF))
    return known.groupBy("document_uid").agg(F.count_distinct("revision_uid").alias("revisions"), F.unix_micros(F.min("first_seen_at")).alias("first_seen"), F.unix_micros(F.max("first_seen_at")).alias("last_seen"))


@query("flt05_feature_window", with_(OBS) + "SELECT observation_uid FROM obs WHERE event_time > TIMESTAMP '2024-01-10' AND event_time <= TIMESTAMP '2024-01-12' AND ingested_at <= TIMESTAMP '2024-01-12'")
def flt05(spark: SparkSession, folder: str) -> DataFrame:
    return in_window(observations(spark, folder), "2024-01-10", "2024-01-12", "2024-01-12").select("observation_uid")


@query("flt06_last_context", with_("m AS (SELECT match_uid, market_uid, document_uid, as_of, lexical_score FROM match_results WHERE as_of <= TIMESTAMP '2024-03-15')") + "SELECT DISTINCT market_uid, document_uid, epoch_us(as_of) AS as_of, match_uid FROM (SELECT *, row_number() OVER (PARTITION BY market_uid ORDER BY as_of DESC, match_uid DESC) AS k FROM m) WHERE k = 1")
def flt06(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "match_results").filter(F.col("as_of") <= instant("2024-03-15")).select("market_uid", "as_of", "match_uid", "document_uid")
    return extreme_row(known, ["market_uid"], ["as_of", "match_uid"], last=True).select("market_uid", "document_uid", us("as_of"), "match_uid")


FLT07_RULES = """CASE WHEN n = 0 THEN 'missing' WHEN n_known = 0 THEN 'late' WHEN n_past = 0 THEN 'future_event' WHEN n_kinds > 4 THEN 'mixed_kinds' WHEN last < TIMESTAMP '2024-01-14 18:00:00' THEN 'stale' ELSE 'admitted' END"""


@query("flt07_reference_admission", with_(OBS) + f"SELECT market_uid, {FLT07_RULES} AS status FROM (SELECT market_uid, count(*) AS n, count(*) FILTER (ingested_at <= TIMESTAMP '{CUTOFF}') AS n_known, count(*) FILTER (ingested_at <= TIMESTAMP '{CUTOFF}' AND event_time <= TIMESTAMP '{CUTOFF}') AS n_past, count(DISTINCT kind) FILTER (event_time > TIMESTAMP '2024-01-14 20:00:00' AND event_time <= TIMESTAMP '{CUTOFF}') AS n_kinds, max(event_time) FILTER (event_time <= TIMESTAMP '{CUTOFF}') AS last FROM obs GROUP BY market_uid)")
def flt07(spark: SparkSession, folder: str) -> DataFrame:
    """A strict cascade: the first status whose test holds."""
    known, past = F.col("ingested_at") <= instant(CUTOFF), F.col("event_time") <= instant(CUTOFF)
    per = observations(spark, folder).groupBy("market_uid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_known"), F.count_if(known & past).alias("n_past"),
        F.count_distinct(F.when((F.col("event_time") > instant("2024-01-14 20:00:00")) & past, F.col("kind"))).alias("n_kinds"), F.max(F.when(past, F.col("event_time"))).alias("last"),
    )
    status = ordered_reason([("missing", F.col("n") == 0), ("late", F.col("n_known") == 0), ("future_event", F.col("n_past") == 0), ("mixed_kinds", F.col("n_kinds") > 4), ("stale", F.col("last") < instant("2024-01-14 18:00:00"))], "admitted")
    return per.select("market_uid", status.alias("status"))


FLT09 = "CASE WHEN actor_uid IS NULL THEN 'actor_unavailable' WHEN event_time IS NULL THEN 'event_time_missing' WHEN event_time > TIMESTAMP '2024-03-10' THEN 'after_cutoff' WHEN ingested_at > TIMESTAMP '2024-03-10' THEN 'late' WHEN size = 0 THEN 'zero_size' WHEN lower(side) NOT IN ('buy', 'sell') THEN 'side_unknown' ELSE 'admitted' END"


def admission_reason():
    return ordered_reason(
        [("actor_unavailable", F.col("actor_uid").isNull()), ("event_time_missing", F.col("event_time").isNull()), ("after_cutoff", F.col("event_time") > instant(FILL_CUTOFF)), ("late", F.col("ingested_at") > instant(FILL_CUTOFF)), ("zero_size", F.col("size") == 0), ("side_unknown", ~F.lower("side").isin("buy", "sell"))], "admitted"
    )


@query("flt08_eligible_fills", with_(FILLS) + "SELECT fill_uid FROM f WHERE actor_uid IS NOT NULL AND actor_visibility <> 'not_available' AND event_time <= TIMESTAMP '2024-03-10' AND ingested_at <= TIMESTAMP '2024-03-10'")
def flt08(spark: SparkSession, folder: str) -> DataFrame:
    return admit(fills(spark, folder), FILL_CUTOFF).filter("actor_uid is not null and actor_visibility <> 'not_available'").select("fill_uid")


@query("flt09_population_reasons", with_(FILLS) + f"SELECT {FLT09} AS reason, count(*) AS n FROM f GROUP BY ALL")
def flt09(spark: SparkSession, folder: str) -> DataFrame:
    return fills(spark, folder).groupBy(admission_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt11_incident_fills", with_(FILLS) + "SELECT market_uid, count(*) FILTER (ingested_at > event_time + INTERVAL 10 MINUTE) AS late, count(*) FILTER (actor_uid IS NULL) AS no_actor, count(*) FILTER (actor_uid IS NOT NULL AND ingested_at <= event_time + INTERVAL 10 MINUTE) AS eligible FROM f WHERE event_time >= TIMESTAMP '2024-03-10' AND event_time < TIMESTAMP '2024-03-11' GROUP BY market_uid")
def flt11(spark: SparkSession, folder: str) -> DataFrame:
    late = F.unix_micros("ingested_at") > F.unix_micros("event_time") + 600_000_000
    day = fills(spark, folder).filter((F.col("event_time") >= instant("2024-03-10")) & (F.col("event_time") < instant("2024-03-11")))
    return day.groupBy("market_uid").agg(F.count_if(late).alias("late"), F.count_if(F.col("actor_uid").isNull()).alias("no_actor"), F.count_if(F.col("actor_uid").isNotNull() & ~late).alias("eligible"))


@query("flt12_watch_history", with_(FILLS) + "SELECT actor_uid, count(*) FILTER (event_time <= TIMESTAMP '2024-03-05') AS trigger_eligible, count(*) FILTER (event_time > TIMESTAMP '2024-03-05') AS follow_up_only, count(*) FILTER (ingested_at > TIMESTAMP '2024-03-10') AS late FROM f WHERE actor_uid IS NOT NULL AND event_time <= TIMESTAMP '2024-03-10' GROUP BY actor_uid")
def flt12(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder).filter(F.col("actor_uid").isNotNull() & (F.col("event_time") <= instant(FILL_CUTOFF)))
    first = F.col("event_time") <= instant("2024-03-05")
    return rows.groupBy("actor_uid").agg(F.count_if(first).alias("trigger_eligible"), F.count_if(~first).alias("follow_up_only"), F.count_if(F.col("ingested_at") > instant(FILL_CUTOFF)).alias("late"))


@query("flt16_contains", "SELECT market_uid, question FROM markets WHERE contains(lower(question), 'bank') OR contains(lower(category), 'bank')")
def flt16(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "markets").filter(F.lower("question").contains("bank") | F.lower("category").contains("bank")).select("market_uid", "question")


@query("flt17_domain_rules", with_(BOOKS) + "SELECT snapshot_uid, (bids[1].price + asks[1].price) / 2 < 0 OR (bids[1].price + asks[1].price) / 2 > 1 AS price_out_of_range, bids[1].price > bids[2].price AND asks[1].price < asks[2].price AND bids[1].price < asks[1].price AS levels_ordered, instr(market_uid, 'ev:') <> 1 AS prefix_wrong FROM books")
def flt17(spark: SparkSession, folder: str) -> DataFrame:
    middle = (F.get("bids", F.lit(0))["price"] + F.get("asks", F.lit(0))["price"]) / 2
    return books(spark, folder).select("snapshot_uid", ((middle < 0) | (middle > 1)).alias("price_out_of_range"), level_order_ok(F.col("bids"), F.col("asks")).alias("levels_ordered"), (~F.col("market_uid").startswith("ev:")).alias("prefix_wrong"))


@query("flt18_tick_quality", "SELECT count(*) AS n, count(*) FILTER (event_time IS NULL) AS missing, count(*) FILTER (size = 0) AS invalid, count(*) - count(DISTINCT (market_uid, event_time, price)) AS duplicates FROM fills")
def flt18(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct keys are counted by a partial aggregate, not by one task's distinct."""
    per = table(spark, folder, "fills").groupBy("market_uid", "event_time", "price").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("size") == 0).alias("zero"))
    return per.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("event_time").isNull(), F.col("c")).otherwise(0)).alias("missing"), F.sum("zero").alias("invalid"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates"))


@query("flt19_quality_gate", "SELECT list_sort(list_filter([CASE WHEN missing > 0.001 THEN 'missing_rate' END, CASE WHEN zero > 0.05 THEN 'invalid_rate' END, CASE WHEN hidden > 0.05 THEN 'actor_visibility' END], lambda x: x IS NOT NULL)) AS reasons FROM (SELECT avg(CASE WHEN event_time IS NULL THEN 1.0 ELSE 0 END) AS missing, avg(CASE WHEN size = 0 THEN 1.0 ELSE 0 END) AS zero, avg(CASE WHEN actor_uid IS NULL THEN 1.0 ELSE 0 END) AS hidden FROM fills)")
def flt19(spark: SparkSession, folder: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    one = table(spark, folder, "fills").agg(share(F.col("event_time").isNull()).alias("missing"), share(F.col("size") == 0).alias("zero"), share(F.col("actor_uid").isNull()).alias("hidden"))
    return one.select(reasons({"missing_rate": F.col("missing") > 0.001, "invalid_rate": F.col("zero") > 0.05, "actor_visibility": F.col("hidden") > 0.05}).alias("reasons"))


@query("flt20_timeline", with_(OBS) + "SELECT market_uid, epoch_us(event_time) AS event_time, round(price, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY market_uid, event_time ORDER BY observation_uid DESC) AS k FROM obs WHERE price BETWEEN 0 AND 1) WHERE k = 1")
def flt20(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder).filter("price between 0 and 1").select("market_uid", "event_time", "observation_uid", "price")
    return extreme_row(rows, ["market_uid", "event_time"], ["observation_uid"], last=True).select("market_uid", us("event_time"), r6("price"))


# --- joins -----------------------------------------------------------------------------------------------------------
@query("jn01_ticks_markets", "SELECT f.fill_uid, f.market_uid, m.question, epoch_us(f.event_time) AS event_time FROM fills f JOIN markets m USING (market_uid)")
def jn01(spark: SparkSession, folder: str) -> DataFrame:
    ticks = table(spark, folder, "fills").select("fill_uid", "market_uid", "event_time")
    named = ticks.join(small_side(table(spark, folder, "markets").select("market_uid", "question")), "market_uid")
    return named.select("fill_uid", "market_uid", "question", us("event_time"))


@query("jn02_recent_feed", "SELECT f.delivery_id, m.question, epoch_us(f.event_time) AS event_time FROM fills f LEFT JOIN markets m USING (market_uid) ORDER BY f.event_time DESC NULLS LAST, f.delivery_id LIMIT 60")
def jn02(spark: SparkSession, folder: str) -> DataFrame:
    top = table(spark, folder, "fills").select("delivery_id", "market_uid", "event_time").orderBy(F.col("event_time").desc_nulls_last(), "delivery_id").limit(60)
    return top.join(small_side(table(spark, folder, "markets").select("market_uid", "question")), "market_uid", "left").select("delivery_id", "question", us("event_time"))


@query("jn03_signal_metadata", "SELECT match_uid, coalesce(question, 'unknown market') AS question, coalesce(category, 'none') AS category, coalesce(liquidity, 0) AS liquidity FROM (SELECT DISTINCT match_uid, market_uid FROM match_results) LEFT JOIN markets USING (market_uid)")
def jn03(spark: SparkSession, folder: str) -> DataFrame:
    signals = table(spark, folder, "match_results").select("match_uid", "market_uid").distinct()
    meta = small_side(table(spark, folder, "markets").select("market_uid", "question", "category", "liquidity"))
    return signals.join(meta, "market_uid", "left").select("match_uid", F.coalesce("question", F.lit("unknown market")).alias("question"), F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"))


@query("jn04_book_as_of", with_(EFILLS, BOOKS, "b AS (SELECT market_uid, event_time, max(snapshot_uid) AS snapshot_uid FROM books GROUP BY ALL)") + "SELECT f.fill_uid, CASE WHEN f.event_time - INTERVAL 1 SECOND - b.event_time <= INTERVAL 10 MINUTE THEN b.snapshot_uid END AS snapshot_uid FROM efills f ASOF LEFT JOIN b ON f.market_uid = b.market_uid AND f.event_time - INTERVAL 1 SECOND >= b.event_time")
def jn04(spark: SparkSession, folder: str) -> DataFrame:
    """The last book at or before a second ahead of the fill, unless older than ten minutes."""
    trades = event_fills(spark, folder).select("fill_uid", "market_uid", F.timestamp_micros(F.unix_micros("event_time") - 1_000_000).alias("before"))
    return asof_join(trades, books(spark, folder), ["market_uid"], "before", "event_time", ["snapshot_uid"], 600).select("fill_uid", "snapshot_uid")


@query("jn06_siblings", "SELECT a.market_uid, count(DISTINCT b.market_uid) AS siblings FROM markets a JOIN markets b ON a.event_uid = b.event_uid AND a.market_uid <> b.market_uid GROUP BY a.market_uid")
def jn06(spark: SparkSession, folder: str) -> DataFrame:
    """Other markets of the same event: group size less one, without pairing the group."""
    rows = table(spark, folder, "markets").filter("event_uid is not null").select("market_uid", "event_uid").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("event_uid"))
    return rows.select("market_uid", (n - 1).alias("siblings")).filter("siblings > 0")


_SLICES = "s AS (SELECT day, TIMESTAMP '2024-02-26' + to_days(CAST(day AS INTEGER)) AS lo, TIMESTAMP '2024-02-26' + to_days(CAST(day AS INTEGER)) + INTERVAL 20 HOUR AS hi FROM range(30) t(day))"


@query("jn07_coverage_slice", with_(FILLS, _SLICES) + "SELECT fill_uid, max(day) AS slice, count(day) AS n_slices FROM f LEFT JOIN s ON f.event_time BETWEEN s.lo AND s.hi GROUP BY fill_uid")
def jn07(spark: SparkSession, folder: str) -> DataFrame:
    """Each fill's coverage slice; slices start daily, so a fill can only lie in its day's slice: an equi-join."""
    day0 = F.unix_seconds(instant("2024-02-26"))
    slices = spark.range(30).select(F.col("id").alias("slice"), (day0 + F.col("id") * 86_400).alias("lo"), (day0 + F.col("id") * 86_400 + 72_000).alias("hi"))
    rows = fills(spark, folder).select("fill_uid", F.unix_micros("event_time").alias("t")).withColumn("slice", F.floor((F.col("t") / 1_000_000 - day0) / 86_400))
    inside = (F.col("t") >= F.col("lo") * 1_000_000) & (F.col("t") <= F.col("hi") * 1_000_000)
    out = rows.join(F.broadcast(slices), "slice", "left")
    return out.select("fill_uid", F.when(inside, F.col("slice")).alias("slice"), F.when(inside, 1).otherwise(0).cast("long").alias("n_slices"))


@query("jn08_exact_match", "WITH l AS (SELECT delivery_id, transaction_uid, outcome_uid FROM fills WHERE transaction_uid IS NOT NULL), c AS (SELECT transaction_uid, outcome_uid, count(DISTINCT fill_uid) AS n FROM fills WHERE transaction_uid IS NOT NULL GROUP BY ALL) SELECT delivery_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'corroborated' ELSE 'ambiguous' END AS status FROM l LEFT JOIN c USING (transaction_uid, outcome_uid)")
def jn08(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "fills").filter("transaction_uid is not null").select("delivery_id", "transaction_uid", "outcome_uid", "fill_uid")
    counts = logs.select("transaction_uid", "outcome_uid", "fill_uid").distinct().groupBy("transaction_uid", "outcome_uid").agg(F.count(F.lit(1)).alias("n"))
    return logs.join(counts, ["transaction_uid", "outcome_uid"], "left").select("delivery_id", ordered_reason([("unmatched", F.col("n").isNull()), ("corroborated", F.col("n") == 1)], "ambiguous").alias("status"))


@query("jn09_clock_gate", with_(FILLS) + f"SELECT fill_uid, CASE WHEN m.closes_at <= TIMESTAMP '{FILL_CUTOFF}' THEN epoch_us(m.closes_at) END AS resolved_at FROM f LEFT JOIN markets m USING (market_uid)")
def jn09(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "markets").filter(F.col("closes_at") <= instant(FILL_CUTOFF)).select("market_uid", us("closes_at", "resolved_at"))
    return fills(spark, folder).select("fill_uid", "market_uid").join(small_side(known), "market_uid", "left").select("fill_uid", "resolved_at")


@query("jn10_exclusions", "SELECT m.match_uid, CASE WHEN e.document_uid IS NULL THEN 'event_not_admissible_as_of' ELSE 'admitted' END AS status FROM (SELECT DISTINCT match_uid, document_uid FROM match_results) m LEFT JOIN (SELECT DISTINCT document_uid FROM evidence WHERE first_seen_at <= TIMESTAMP '2024-03-10') e USING (document_uid)")
def jn10(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "evidence").filter(F.col("first_seen_at") <= instant(FILL_CUTOFF)).select("document_uid").distinct().withColumn("hit", F.lit(True))
    rows = table(spark, folder, "match_results").select("match_uid", "document_uid").distinct().join(facts, "document_uid", "left")
    return rows.select("match_uid", F.when(F.col("hit"), "admitted").otherwise("event_not_admissible_as_of").alias("status"))


@query("jn11_semi", "SELECT market_uid, category FROM markets WHERE market_uid IN (SELECT market_uid FROM match_results WHERE relevant)")
def jn11(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "markets").select("market_uid", "category").join(table(spark, folder, "match_results").filter("relevant").select("market_uid"), "market_uid", "left_semi")


@query("jn12_anti", "SELECT DISTINCT document_uid FROM match_results m WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.document_uid = m.document_uid)")
def jn12(spark: SparkSession, folder: str) -> DataFrame:
    """References without a document."""
    return table(spark, folder, "match_results").select("document_uid").distinct().join(table(spark, folder, "evidence").select("document_uid"), "document_uid", "left_anti")


@query("jn15_controls", with_(FILLS) + "SELECT f.market_uid, count(*) AS fills, any_value(m.live_event) AS live_event, any_value(m.liquidity) AS liquidity, any_value(m.market_uid) IS NULL AS control_missing FROM f LEFT JOIN markets m USING (market_uid) GROUP BY f.market_uid")
def jn15(spark: SparkSession, folder: str) -> DataFrame:
    per = fills(spark, folder).groupBy("market_uid").agg(F.count(F.lit(1)).alias("fills"))
    control = small_side(table(spark, folder, "markets").select("market_uid", "live_event", "liquidity", F.lit(False).alias("none")))
    return per.join(control, "market_uid", "left").select("market_uid", "fills", "live_event", "liquidity", F.coalesce("none", F.lit(True)).alias("control_missing"))


@query("jn16_pair_up", with_(OBS) + "SELECT market_uid, bucket, bid, ask, CASE WHEN bid IS NULL OR ask IS NULL THEN 'incomplete' ELSE 'paired' END AS status FROM (SELECT market_uid, CAST(floor(epoch(event_time) / 3600) AS BIGINT) AS bucket, round(max(price) FILTER (kind = 'best_bid'), 6) AS bid, round(min(price) FILTER (kind = 'best_ask'), 6) AS ask FROM obs WHERE kind IN ('best_bid', 'best_ask') GROUP BY ALL)")
def jn16(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder).filter("kind in ('best_bid', 'best_ask')")
    per = rows.groupBy("market_uid", F.floor(F.unix_seconds("event_time") / 3600).alias("bucket")).agg(F.max(F.when(F.col("kind") == "best_bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("kind") == "best_ask", F.col("price"))).alias("ask"))
    return per.select("market_uid", "bucket", r6("bid"), r6("ask"), F.when(F.col("bid").isNull() | F.col("ask").isNull(), "incomplete").otherwise("paired").alias("status"))


@query("jn17_map_diff", "WITH a AS (SELECT document_uid, arg_max(title, (first_seen_at, evidence_uid)) AS title FROM evidence WHERE first_seen_at <= TIMESTAMP '2024-03-05' GROUP BY document_uid), b AS (SELECT document_uid, arg_max(title, (first_seen_at, evidence_uid)) AS title FROM evidence WHERE first_seen_at <= TIMESTAMP '2024-03-15' GROUP BY document_uid) SELECT document_uid, a.title AS before, b.title AS after FROM a FULL JOIN b USING (document_uid) WHERE a.title IS DISTINCT FROM b.title")
def jn17(spark: SparkSession, folder: str) -> DataFrame:
    def state(at: str, name: str) -> DataFrame:
        rows = table(spark, folder, "evidence").filter(F.col("first_seen_at") <= instant(at))
        return rows.groupBy("document_uid").agg(F.max_by("title", F.struct("first_seen_at", "evidence_uid")).alias(name))

    both = state("2024-03-05", "before").join(state("2024-03-15", "after"), "document_uid", "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


# --- aggregates ------------------------------------------------------------------------------------------------------
@query("agg01_overview", "SELECT (SELECT count(*) FROM fills) AS ticks, (SELECT epoch_us(max(event_time)) FROM fills) AS last, (SELECT count(*) FROM markets) AS markets, (SELECT count(DISTINCT platform) FROM markets) AS platforms")
def agg01(spark: SparkSession, folder: str) -> DataFrame:
    ticks = table(spark, folder, "fills").agg(F.count(F.lit(1)).alias("ticks"), F.unix_micros(F.max("event_time")).alias("last"))
    known = table(spark, folder, "markets").agg(F.count(F.lit(1)).alias("markets"), F.count_distinct("platform").alias("platforms"))
    return ticks.withColumn("one", F.lit(1)).join(known.withColumn("one", F.lit(1)), "one").drop("one")


@query("agg02_hourly_histogram", "SELECT CAST(epoch(event_time) / 3600 AS BIGINT) * 3600 AS hour, count(*) AS n FROM fills WHERE event_time IS NOT NULL GROUP BY 1")
def agg02(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest hour, half-way to the even one: that is what the histogram has always shown."""
    hour = F.bround(F.unix_micros("event_time") / 1_000_000 / 3600, 0).cast("long") * 3600
    return table(spark, folder, "fills").filter("event_time is not null").groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


_BUCKET = "CAST(floor(epoch(event_time) / 300) AS BIGINT) * 300 + 300"


@query("agg03_fill_buckets", with_(EFILLS, f"a AS (SELECT market_uid, {_BUCKET} AS bucket, actor_uid, sum(size) AS v, sum(price * size) AS m, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS s, count(*) AS n FROM efills GROUP BY ALL)") + "SELECT market_uid, bucket, round(sum(v), 6) AS volume, round(sum(m), 6) AS notional, round(sum(s) / sum(v), 6) AS imbalance, count(actor_uid) AS actors, CAST(sum(n) AS BIGINT) AS fills, round(sum(m * m) / (sum(m) * sum(m)), 6) AS concentration FROM a GROUP BY ALL")
def agg03(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_fills(event_fills(spark, folder)).select("market_uid", "bucket", r6("volume"), r6("notional"), r6("imbalance"), "actors", "fills", r6("concentration"))


_PRICE = f"""bp AS (SELECT market_uid, outcome_uid, {_BUCKET} AS bucket, coalesce(arg_max(price, (event_time, observation_uid)) FILTER (kind = 'last_trade'), arg_max(price, (event_time, observation_uid)) FILTER (kind = 'midpoint'),
 (arg_max(price, (event_time, observation_uid)) FILTER (kind = 'best_bid') + arg_max(price, (event_time, observation_uid)) FILTER (kind = 'best_ask')) / 2, arg_max(price, (event_time, observation_uid)) FILTER (kind = 'platform_snapshot')) AS price, max(event_time) AS source_time FROM obs GROUP BY ALL)"""


@query("agg04_bucket_prices", with_(OBS, _PRICE) + "SELECT market_uid, bucket, round(price, 6) AS price, CAST(floor(epoch(source_time)) AS BIGINT) AS source_time FROM bp")
def agg04(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_prices(observations(spark, folder)).select("market_uid", "bucket", r6("price"), "source_time")


@query("agg05_book_features", with_(BOOKS) + "SELECT snapshot_uid, round(asks[1].price - bids[1].price, 6) AS spread, list_sum(list_transform(bids[1:5], lambda x: x.size)) AS bid_depth, list_sum(list_transform(asks[1:5], lambda x: x.size)) AS ask_depth FROM books")
def agg05(spark: SparkSession, folder: str) -> DataFrame:
    spread = F.get("asks", F.lit(0))["price"] - F.get("bids", F.lit(0))["price"]
    return books(spark, folder).select("snapshot_uid", r6(spread, "spread"), depth(F.col("bids")).alias("bid_depth"), depth(F.col("asks")).alias("ask_depth"))


@query("agg06_feature_snapshot", with_(OBS, EFILLS) + """, p AS (SELECT market_uid, event_time, observation_uid AS uid, price, NULL::DOUBLE AS size FROM obs UNION ALL SELECT market_uid, event_time, fill_uid, price, size FROM efills)
 SELECT market_uid, bucket, round(arg_min(price, (event_time, uid)), 6) AS open, round(arg_max(price, (event_time, uid)), 6) AS close, round(sum(price * size), 6) AS notional, round(avg(size), 6) AS mean_size, count(*) AS points, count(size) AS fills, epoch_us(max(event_time)) AS watermark
 FROM (SELECT *, CAST(ceil(epoch(event_time) / 300) AS BIGINT) * 300 AS bucket FROM p) GROUP BY market_uid, bucket""")
def agg06(spark: SparkSession, folder: str) -> DataFrame:
    """Features of (start, end] buckets over observations and fills together."""
    a = observations(spark, folder).select("market_uid", "event_time", F.col("observation_uid").alias("uid"), "price")
    b = event_fills(spark, folder).select("market_uid", "event_time", F.col("fill_uid").alias("uid"), "price", "size")
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("bucket", F.ceil(F.unix_micros("event_time") / 300_000_000) * 300)
    at = F.struct("event_time", "uid")
    return rows.groupBy("market_uid", "bucket").agg(r6(F.min_by("price", at), "open"), r6(F.max_by("price", at), "close"), r6(F.sum(F.col("price") * F.col("size")), "notional"), r6(F.avg("size"), "mean_size"), F.count(F.lit(1)).alias("points"), F.count("size").alias("fills"), F.unix_micros(F.max("event_time")).alias("watermark"))


@query("agg13_quality_rates", "SELECT source_uid, count(*) AS n, round(avg(CASE WHEN event_time IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_rate, round(avg(CASE WHEN actor_uid IS NULL THEN 1.0 ELSE 0 END), 6) AS hidden_rate FROM fills GROUP BY source_uid")
def agg13(spark: SparkSession, folder: str) -> DataFrame:
    share = lambda c, name: r6(F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)), name)
    return table(spark, folder, "fills").groupBy("source_uid").agg(F.count(F.lit(1)).alias("n"), share("event_time", "missing_rate"), share("actor_uid", "hidden_rate"))


@query("agg14_watermarks", "SELECT map_from_entries(list((source_uid, w) ORDER BY source_uid)) AS watermarks FROM (SELECT source_uid, epoch_us(max(event_time)) AS w FROM fills GROUP BY source_uid)")
def agg14(spark: SparkSession, folder: str) -> DataFrame:
    per = table(spark, folder, "fills").groupBy("source_uid").agg(F.unix_micros(F.max("event_time")).alias("w"))  # sources: a bounded list
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_uid", "w")))).alias("watermarks"))


_MEANING = "(market_uid, outcome_uid, price, size, side, actor_uid, transaction_uid, event_time)"


@query("agg15_dedup_counts", f"WITH g AS (SELECT fill_uid, count(*) AS n, count(DISTINCT {_MEANING}) AS meanings FROM fills GROUP BY fill_uid) SELECT CAST(sum(n) AS BIGINT) AS raw, count(*) AS unique_uids, CAST(sum(n) - count(*) AS BIGINT) AS repeated, count(*) FILTER (meanings > 1) AS conflicting FROM g")
def agg15(spark: SparkSession, folder: str) -> DataFrame:
    meaning = F.struct("market_uid", "outcome_uid", "price", "size", "side", "actor_uid", "transaction_uid", "event_time")
    per = table(spark, folder, "fills").groupBy("fill_uid").agg(F.count(F.lit(1)).alias("n"), F.min(meaning).alias("a"), F.max(meaning).alias("b"))
    return per.agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("unique_uids"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("conflicting"))


_COVER = "c AS (SELECT source, CAST(floor(epoch(first_seen_at)) AS BIGINT) AS lo, CAST(floor(epoch(first_seen_at)) AS BIGINT) + 1800 AS hi FROM evidence), k AS (SELECT source, greatest(lo, 1709251200) AS lo, least(hi, 1710460800) AS hi FROM c WHERE least(hi, 1710460800) >= greatest(lo, 1709251200)), o AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY source ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS fresh FROM k), g AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM o), i AS (SELECT source, island, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY ALL)"


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    lo = F.unix_seconds("first_seen_at")
    return table(spark, folder, "evidence").select("source", lo.alias("lo"), (lo + 1800).alias("hi"))


@query("agg25_covered_ratio", with_(_COVER) + "SELECT source, CAST(sum(hi - lo) AS BIGINT) AS covered, round(sum(hi - lo) / 1209600, 6) AS ratio FROM i GROUP BY source")
def agg25(spark: SparkSession, folder: str) -> DataFrame:
    return covered_ratio(_coverage(spark, folder), ["source"], "lo", "hi", 1709251200, 1710460800).select("source", "covered", r6("ratio"))


@query("agg26_coverage_gaps", with_(_COVER) + "SELECT source, gap_start, gap_end FROM (SELECT source, coalesce(lag(hi) OVER (PARTITION BY source ORDER BY lo), 1709251200) AS gap_start, lo AS gap_end FROM i UNION ALL SELECT source, max(hi), 1710460800 FROM i GROUP BY source) WHERE gap_end > gap_start")
def agg26(spark: SparkSession, folder: str) -> DataFrame:
    return gaps(_coverage(spark, folder), ["source"], "lo", "hi", 1709251200, 1710460800)


@query("set05_contiguous", "WITH d AS (SELECT source, CAST(floor(epoch(first_seen_at) / 86400) AS BIGINT) AS day FROM evidence GROUP BY ALL) SELECT source, bool_and(ok) AS contiguous, count(*) AS slices FROM (SELECT source, coalesce(lag(day) OVER (PARTITION BY source ORDER BY day) + 1 = day, true) AS ok FROM d) GROUP BY source")
def set05(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "evidence").select("source", F.floor(F.unix_seconds("first_seen_at") / 86_400).alias("lo")).distinct().withColumn("hi", F.col("lo"))
    return contiguous(days, ["source"], "lo", "hi")


# --- windows ---------------------------------------------------------------------------------------------------------
_SHOCK = "l AS (SELECT market_uid, event_time, observation_uid, CASE WHEN price IS NOT NULL THEN ln(greatest(least(price, 0.999), 0.001) / (1 - greatest(least(price, 0.999), 0.001))) END AS x FROM obs), s AS (SELECT *, x - lag(x) OVER w AS shock FROM l WINDOW w AS (PARTITION BY market_uid ORDER BY event_time, observation_uid)), z AS (SELECT *, CASE WHEN count(shock) OVER w >= 12 THEN avg(shock) OVER w END AS m, CASE WHEN count(shock) OVER w >= 12 THEN stddev_samp(shock) OVER w END AS d FROM s WINDOW w AS (PARTITION BY market_uid ORDER BY event_time, observation_uid ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), y AS (SELECT *, (shock - m) / coalesce(nullif(d, 0), 0.01) AS score FROM z)"


@query("win04_belief_shocks", with_(OBS, _SHOCK) + "SELECT observation_uid, round(shock, 6) AS shock, round(m, 6) AS past_mean, round(d, 6) AS past_std, round(score, 6) AS score, coalesce(abs(score) > 2.5, false) AS anomaly FROM y")
def win04(spark: SparkSession, folder: str) -> DataFrame:
    df = belief_shocks(observations(spark, folder), "market_uid", "event_time", "observation_uid")
    return df.select("observation_uid", r6("shock"), r6("past_mean"), r6("past_std"), r6("score"), "anomaly")


@query("top02_top_anomalies", with_(OBS, _SHOCK) + "SELECT observation_uid, market_uid, round(score, 6) AS score FROM y WHERE abs(score) > 2.5 ORDER BY abs(score) DESC, observation_uid")
def top02(spark: SparkSession, folder: str) -> DataFrame:
    df = belief_shocks(observations(spark, folder), "market_uid", "event_time", "observation_uid").filter("anomaly")
    return df.orderBy(F.abs("score").desc(), "observation_uid").select("observation_uid", "market_uid", r6("score"))


_GRID = "g AS (SELECT market_uid, outcome_uid, unnest(generate_series(lo, hi, 300)) AS bucket FROM (SELECT market_uid, outcome_uid, min(bucket) AS lo, max(bucket) AS hi FROM bp GROUP BY ALL)), c AS (SELECT g.market_uid, g.bucket, bp.price IS NOT NULL AS observed, last_value(bp.price IGNORE NULLS) OVER w AS p, last_value(CASE WHEN bp.price IS NOT NULL THEN CAST(floor(epoch(bp.source_time)) AS BIGINT) END IGNORE NULLS) OVER w AS t FROM g LEFT JOIN bp USING (market_uid, outcome_uid, bucket) WINDOW w AS (PARTITION BY g.market_uid ORDER BY g.bucket)), d AS (SELECT market_uid, bucket, observed, CASE WHEN bucket - t <= 600 THEN p END AS price FROM c), mv AS (SELECT *, CASE WHEN price IS NOT NULL THEN ln(greatest(least(price, 1 - 1e-6), 1e-6) / (1 - greatest(least(price, 1 - 1e-6), 1e-6))) END AS x FROM d), m2 AS (SELECT *, x - lag(x, 1) OVER w AS move_5, x - lag(x, 6) OVER w AS move_30 FROM mv WINDOW w AS (PARTITION BY market_uid ORDER BY bucket))"


@query("win09_carry_forward", with_(OBS, _PRICE, _GRID) + "SELECT market_uid, bucket, observed, round(price, 6) AS price FROM d")
def win09(spark: SparkSession, folder: str) -> DataFrame:
    return dense_grid(bucket_prices(observations(spark, folder))).select("market_uid", "bucket", "observed", r6("price"))


@query("win10_moves", with_(OBS, _PRICE, _GRID) + "SELECT market_uid, bucket, round(move_5, 6) AS move_5, round(move_30, 6) AS move_30 FROM m2 WHERE move_5 IS NOT NULL OR move_30 IS NOT NULL")
def win10(spark: SparkSession, folder: str) -> DataFrame:
    df = moves(dense_grid(bucket_prices(observations(spark, folder))))
    return df.filter("move_5 is not null or move_30 is not null").select("market_uid", "bucket", r6("move_5"), r6("move_30"))


#: A trailing week, of which 288 buckets, a day and 288 values must be there, 100 for the empirical tail.
SURVEYED = Rules()


def _event_of(df: DataFrame) -> DataFrame:
    """Siblings: the markets of click, view and search events belong to one event, the rest to another."""
    return df.select("market_uid").distinct().withColumn("event_uid", F.when(F.col("market_uid").isin("ev:click", "ev:view", "ev:search"), "event:browse").otherwise("event:buy"))


@query("jn06b_sibling_residual", with_(OBS, _PRICE, _GRID, "e AS (SELECT *, CASE WHEN market_uid IN ('ev:click', 'ev:view', 'ev:search') THEN 'event:browse' ELSE 'event:buy' END AS event_uid FROM m2 WHERE move_5 IS NOT NULL)") + "SELECT a.market_uid, a.bucket, count(b.move_5) AS siblings, round(any_value(a.move_5) - median(b.move_5), 6) AS residual FROM e a JOIN e b ON a.event_uid = b.event_uid AND a.bucket = b.bucket AND a.market_uid <> b.market_uid GROUP BY a.market_uid, a.bucket")
def jn06b(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder)
    df = sibling_residual(moves(dense_grid(bucket_prices(obs))), _event_of(obs))
    return df.filter("siblings > 0 and move_5 is not null").select("market_uid", "bucket", "siblings", r6("residual"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder)
    grid = moves(dense_grid(bucket_prices(obs)))
    return trailing_scores(grid.select(*SERIES, "bucket", F.abs("move_5").alias("value")), "value", SURVEYED)


@query("win05_baseline_gate", with_(OBS, _PRICE, _GRID) + "SELECT market_uid, bucket, CASE WHEN n_buckets < 288 OR elapsed < 86400 THEN 'none' ELSE 'ready' END AS gate, n_buckets, n_values FROM (SELECT market_uid, bucket, count(*) OVER w AS n_buckets, count(move_5) OVER w AS n_values, bucket - min(bucket) OVER w AS elapsed FROM m2 WINDOW w AS (PARTITION BY market_uid ORDER BY bucket RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING))")
def win05(spark: SparkSession, folder: str) -> DataFrame:
    grid = moves(dense_grid(bucket_prices(observations(spark, folder))))
    past = Window.partitionBy(*SERIES).orderBy("bucket").rangeBetween(-SURVEYED.baseline, -1)
    df = grid.select("market_uid", "bucket", F.count(F.lit(1)).over(past).alias("n_buckets"), F.count("move_5").over(past).alias("n_values"), (F.col("bucket") - F.min("bucket").over(past)).alias("elapsed"))
    return df.select("market_uid", "bucket", F.when((F.col("n_buckets") < SURVEYED.least_buckets) | (F.col("elapsed") < SURVEYED.least_elapsed), "none").otherwise("ready").alias("gate"), "n_buckets", "n_values")


def _ratio_sql(x: str, top, bottom) -> str:
    a, b = f"CAST({top[-1]!r} AS DOUBLE) * {x}", x
    for p, q in zip(top[:-2], bottom[:-1]):
        a, b = f"({a} + CAST({p!r} AS DOUBLE)) * {x}", f"({b} + CAST({q!r} AS DOUBLE)) * {x}"
    return f"(({a} + CAST({top[-2]!r} AS DOUBLE)) / ({b} + CAST({bottom[-1]!r} AS DOUBLE)))"


def _trailing_sql(source: str) -> str:
    """CTEs from a relation (market_uid, bucket, v) to sc: method, n_values, median, mad, score and p by the default rules."""
    tail = f"CASE WHEN x <= 0.46875 THEN 1 - x * {_ratio_sql('(x * x)', *ERF_NEAR)} WHEN x <= 4 THEN exp(-x * x) * {_ratio_sql('x', *ERFC_MIDDLE)} ELSE exp(-x * x) / x * (1 / sqrt(pi()) - (1 / (x * x)) * {_ratio_sql('(1 / (x * x))', *ERFC_FAR)}) END"
    return f"""b0 AS (SELECT market_uid, bucket, v, count(*) OVER w AS n_buckets, bucket - min(bucket) OVER w AS elapsed, list(v) FILTER (v IS NOT NULL) OVER w AS past FROM {source} WINDOW w AS (PARTITION BY market_uid ORDER BY bucket RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)),
 b1 AS (SELECT *, len(past) AS n_values, list_median(past) AS m FROM b0 WHERE v IS NOT NULL AND n_buckets >= 288 AND elapsed >= 86400 AND len(past) >= 288),
 b2 AS (SELECT *, list_transform(past, lambda y: abs(y - m)) AS away FROM b1), b3 AS (SELECT *, list_median(away) AS mad FROM b2),
 b4 AS (SELECT *, CASE WHEN mad > 0 THEN abs({MAD_TO_SIGMA!r} * (v - m) / mad) END AS z, (1 + len(list_filter(away, lambda y: y >= abs(v - m)))) / (1 + n_values) AS tail FROM b3), b5 AS (SELECT *, greatest(z, 0) / sqrt(2) AS x FROM b4),
 sc AS (SELECT market_uid, bucket, v, CASE WHEN mad > 0 THEN 'normal' ELSE 'tail' END AS method, n_values, m AS median, mad, CASE WHEN mad > 0 THEN z ELSE -log10(tail) END AS score, CASE WHEN mad > 0 THEN {tail} ELSE tail END AS p FROM b5)"""


def r9(c: str):
    """Nine significant digits of a probability, however small."""
    return F.when(F.col(c) > 0, F.round(F.log10(F.col(c)), 6)).alias(f"log10_{c}")


@query("win06_robust_scores", with_(OBS, _PRICE, _GRID, "vs AS (SELECT market_uid, bucket, abs(move_5) AS v FROM m2)", _trailing_sql("vs")) + "SELECT market_uid, bucket, method, n_values, round(median, 6) AS median, round(mad, 6) AS mad, round(score, 6) AS score, CASE WHEN p > 0 THEN round(log10(p), 6) END AS log10_p FROM sc")
def win06(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter("method <> 'none'").select("market_uid", "bucket", "method", "n_values", r6("median"), r6("mad"), r6("score"), r9("p"))


@query("win08_benjamini_hochberg", "WITH m AS (SELECT DISTINCT match_uid, market_uid, 1 - round(lexical_score, 4) AS p FROM match_results WHERE lexical_score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY market_uid ORDER BY p, match_uid) AS k, count(*) OVER (PARTITION BY market_uid) AS m FROM m) SELECT match_uid, k AS bh_rank, round(least(1, min(p * m / k) OVER (PARTITION BY market_uid ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def win08(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "match_results").filter("lexical_score is not null").select("match_uid", "market_uid", (1 - F.round("lexical_score", 4)).alias("p")).distinct()
    return benjamini_hochberg(rows, "market_uid", "p", ["match_uid"]).select("match_uid", F.col("bh_rank").cast("long").alias("bh_rank"), r6("q"))


@query("win11_sessions", with_(EFILLS) + "SELECT actor_uid, session, count(*) AS n, min(t) AS started, max(t) AS ended FROM (SELECT *, sum(fresh) OVER (PARTITION BY actor_uid ORDER BY t, fill_uid ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT actor_uid, fill_uid, CAST(floor(epoch(event_time)) AS BIGINT) AS t, CASE WHEN CAST(floor(epoch(event_time)) AS BIGINT) - lag(CAST(floor(epoch(event_time)) AS BIGINT)) OVER (PARTITION BY actor_uid ORDER BY event_time, fill_uid) <= 1800 THEN 0 ELSE 1 END AS fresh FROM efills)) GROUP BY ALL")
def win11(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_fills(spark, folder).select("actor_uid", F.unix_seconds("event_time").alias("t"))
    per = sessions(rows.groupBy("actor_uid", "t").agg(F.count(F.lit(1)).alias("c")), ["actor_uid"], "t", 1800)
    return per.groupBy("actor_uid", "session").agg(F.sum("c").alias("n"), F.min("t").alias("started"), F.max("t").alias("ended"))


@query("win19_semantic_dedup", f"SELECT min(fill_uid) AS fill_uid, count(*) AS n FROM fills GROUP BY {_MEANING[1:-1]}")
def win19(spark: SparkSession, folder: str) -> DataFrame:
    """Fills of equal meaning: the smallest uid stands for all."""
    return table(spark, folder, "fills").groupBy("market_uid", "outcome_uid", "price", "size", "side", "actor_uid", "transaction_uid", "event_time").agg(F.min("fill_uid").alias("fill_uid"), F.count(F.lit(1)).alias("n")).select("fill_uid", "n")


_BROWSE = "CASE WHEN market_uid IN ('ev:click', 'ev:view', 'ev:search') THEN 'event:browse' ELSE 'event:buy' END"
_DETECT = with_(
    OBS, EFILLS, _PRICE, _GRID, f"e AS (SELECT *, {_BROWSE} AS event_uid FROM m2)",
    "si AS (SELECT a.market_uid, a.bucket, any_value(a.move_5) AS own, median(b.move_5) AS other FROM e a JOIN e b ON a.event_uid = b.event_uid AND a.bucket = b.bucket AND a.market_uid <> b.market_uid WHERE a.move_5 IS NOT NULL AND b.move_5 IS NOT NULL GROUP BY a.market_uid, a.bucket)",
    "vs AS (SELECT e.market_uid, e.bucket, abs(coalesce(own - other, move_5)) AS v, coalesce(own * other > 0 AND abs(own - other) <= 0.25 * greatest(abs(own), 1e-12), false) AS repriced FROM e LEFT JOIN si USING (market_uid, bucket))",
    _trailing_sql("vs"),
    "fv AS (SELECT DISTINCT market_uid, (CAST(floor(epoch(event_time) / 300) AS BIGINT) + 1) * 300 AS bucket FROM efills)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p, market_uid) AS k, count(*) OVER (PARTITION BY bucket) AS m FROM sc)",
    "q AS (SELECT k.*, least(1, min(p * m / k) OVER (PARTITION BY k.bucket ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)",
    "t AS (SELECT q.market_uid, q.bucket, score, vs.repriced, fv.bucket IS NULL AS silent FROM q JOIN vs USING (market_uid, bucket) LEFT JOIN fv USING (market_uid, bucket) WHERE q <= 0.05)",
    "u AS (SELECT *, sum(fresh) OVER (PARTITION BY market_uid ORDER BY bucket) AS session FROM (SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY market_uid ORDER BY bucket) <= 1800 THEN 0 ELSE 1 END AS fresh FROM t))",
)


@query("cmp01_causal_detection", _DETECT + "SELECT market_uid, CAST(session AS BIGINT) AS session, min(bucket) AS started, max(bucket) AS ended, count(*) AS signals, round(max(score), 6) AS peak_score, arg_max(bucket, (score, -bucket)) AS peak_bucket, list_sort(list_filter(['liquidity_unknown', CASE WHEN bool_or(repriced) THEN 'sibling_repricing' END, CASE WHEN bool_or(silent) THEN 'no_fills' END], lambda x: x IS NOT NULL)) AS tags FROM u GROUP BY market_uid, session")
def cmp01(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder)
    found = detect(obs, event_fills(spark, folder), _event_of(obs), SURVEYED)
    return found.select("market_uid", "session", "started", "ended", "signals", r6("peak_score"), "peak_bucket", "tags")


# --- top-k and pages -------------------------------------------------------------------------------------------------
@query("top01_ordered_ticks", "SELECT market_uid, epoch_us(event_time) AS event_time, delivery_id FROM fills ORDER BY market_uid, event_time NULLS FIRST, delivery_id LIMIT 100")
def top01(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fills").orderBy("market_uid", "event_time", "delivery_id").limit(100).select("market_uid", us("event_time"), "delivery_id")


@query("top04_top_wallets", with_(FILLS) + "SELECT market_uid, actor_uid, round(m, 6) AS notional, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY market_uid ORDER BY m DESC, actor_uid) AS k FROM (SELECT market_uid, actor_uid, CAST(sum(price * size) AS DOUBLE) AS m FROM f WHERE actor_uid IS NOT NULL GROUP BY ALL)) WHERE k <= 3")
def top04(spark: SparkSession, folder: str) -> DataFrame:
    money = fills(spark, folder).filter("actor_uid is not null").groupBy("market_uid", "actor_uid").agg(F.sum(F.col("price") * F.col("size")).cast("double").alias("notional"))
    place = F.row_number().over(Window.partitionBy("market_uid").orderBy(F.col("notional").desc(), "actor_uid"))
    return money.withColumn("rank", place.cast("long")).filter("rank <= 3").select("market_uid", "actor_uid", r6("notional"), "rank")


@query("top05_keyset_page", with_(FILLS) + "SELECT fill_uid, epoch_us(event_time) AS event_time, true AS has_more FROM f WHERE event_time IS NOT NULL AND (event_time, ingested_at, fill_uid) > (TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-01', '') ORDER BY event_time, ingested_at, fill_uid LIMIT 100")
def top05(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder).filter("event_time is not null").select("event_time", "ingested_at", "fill_uid")
    return keyset_page(rows, ["event_time", "ingested_at", "fill_uid"], [instant("2024-03-01"), instant("2024-03-01"), F.lit("")], 100).select("fill_uid", us("event_time"), "has_more")


@query("top06_actor_range", with_(FILLS) + "SELECT fill_uid, actor_uid FROM f WHERE actor_uid = (SELECT min(actor_uid) FROM fills) AND event_time BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-03-20' ORDER BY event_time, fill_uid LIMIT 10000")
def top06(spark: SparkSession, folder: str) -> DataFrame:
    who = table(spark, folder, "fills").agg(F.min("actor_uid")).scalar()
    rows = fills(spark, folder).filter((F.col("actor_uid") == who) & F.col("event_time").between(instant("2024-03-01"), instant("2024-03-20")))
    return rows.orderBy("event_time", "fill_uid").limit(10_000).select("fill_uid", "actor_uid")


# --- set operations --------------------------------------------------------------------------------------------------
@query("set01_union_pairs", "SELECT actor_uid AS uid, market_uid AS other FROM fills WHERE actor_uid IS NOT NULL UNION SELECT maker.actor_uid, market_uid FROM fills WHERE maker.actor_uid IS NOT NULL")
def set01(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fills")
    a = rows.filter("actor_uid is not null").select(F.col("actor_uid").alias("uid"), F.col("market_uid").alias("other"))
    return a.union(rows.filter("maker.actor_uid is not null").select("maker.actor_uid", "market_uid")).distinct()


@query("set03_price_points", with_(OBS, EFILLS) + "SELECT market_uid, count(*) AS n FROM (SELECT market_uid, price FROM obs UNION ALL SELECT market_uid, price FROM efills) GROUP BY market_uid")
def set03(spark: SparkSession, folder: str) -> DataFrame:
    both = observations(spark, folder).select("market_uid", "price").unionByName(event_fills(spark, folder).select("market_uid", "price"))
    return both.groupBy("market_uid").agg(F.count(F.lit(1)).alias("n"))


@query("set04_key_sets", "SELECT 'both' AS part, market_uid FROM (SELECT market_uid FROM markets INTERSECT SELECT market_uid FROM match_results) UNION ALL SELECT 'unmatched', market_uid FROM (SELECT market_uid FROM markets EXCEPT SELECT market_uid FROM match_results)")
def set04(spark: SparkSession, folder: str) -> DataFrame:
    a, b = table(spark, folder, "markets").select("market_uid"), table(spark, folder, "match_results").select("market_uid")
    return a.intersect(b).select(F.lit("both").alias("part"), "market_uid").unionByName(a.subtract(b).select(F.lit("unmatched").alias("part"), "market_uid"))


# --- stores ----------------------------------------------------------------------------------------------------------
@query("snk02_classify_append", f"WITH h AS (SELECT delivery_id, fill_uid, ingested_at, md5(CAST({_MEANING} AS VARCHAR)) AS m FROM fills), s AS (SELECT *, first_value(m) OVER w AS first_m, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY fill_uid ORDER BY ingested_at, delivery_id)) SELECT delivery_id, CASE WHEN k = 1 THEN 'inserted' WHEN m = first_m THEN 'duplicate' ELSE 'conflict' END AS status FROM s")
def snk02(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fills").select("delivery_id", "fill_uid", "ingested_at", "market_uid", "outcome_uid", "price", "size", "side", "actor_uid", "transaction_uid", "event_time")
    return classify_append(rows, None, "fill_uid", ["ingested_at", "delivery_id"]).select("delivery_id", "status")


@query("snk03_event_memory", "WITH h AS (SELECT evidence_uid, revision_uid, first_seen_at, md5(CAST((document_uid, source, title, body, content_hash) AS VARCHAR)) AS m FROM evidence), s AS (SELECT *, first_value(m) OVER w AS first_m, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY revision_uid ORDER BY first_seen_at, evidence_uid)) SELECT evidence_uid, CASE WHEN k = 1 THEN 'inserted' WHEN m = first_m THEN 'duplicate' ELSE 'conflict' END AS status FROM s")
def snk03(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence").select("evidence_uid", "revision_uid", "first_seen_at", "document_uid", "source", "title", "body", "content_hash")
    return classify_append(rows, None, "revision_uid", ["first_seen_at", "evidence_uid"], ()).select("evidence_uid", "status")


@query("snk04_archive_ingest", "SELECT document_uid, revision_uid, epoch_us(min(first_seen_at)) AS first_seen, count(*) - 1 AS replays, count(DISTINCT content_hash) > 1 AS conflict FROM evidence GROUP BY ALL")
def snk04(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence").groupBy("document_uid", "revision_uid").agg(F.unix_micros(F.min("first_seen_at")).alias("first_seen"), (F.count(F.lit(1)) - 1).alias("replays"), (F.min("content_hash") != F.max("content_hash")).alias("conflict"))


@query("sc05_bucket_ends", with_(OBS) + f"SELECT observation_uid, {_BUCKET} AS bucket_end, CAST(floor(epoch(event_time) / 300) AS BIGINT) * 300 AS feature_bucket_end FROM obs")
def sc05(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select("observation_uid", bucket_end(F.col("event_time")).alias("bucket_end"), feature_bucket_end(F.col("event_time")).alias("feature_bucket_end"))


@query("sc22_control_tags", "WITH u AS (SELECT market_uid FROM markets UNION SELECT market_uid FROM fills UNION SELECT market_uid FROM match_results) SELECT u.market_uid, CASE WHEN m.market_uid IS NULL THEN ['control_metadata_unavailable'] ELSE list_sort(list_filter([CASE WHEN live_event THEN 'live_event' END, CASE WHEN abs(epoch(scheduled_announcement_at) - 1710000000) <= 3600 THEN 'scheduled_announcement_window' END, CASE WHEN epoch(closes_at) - 1710000000 BETWEEN 0 AND 3600 THEN 'time_to_close_lt_1h' END, CASE WHEN liquidity IS NULL THEN 'liquidity_unknown' END, CASE WHEN liquidity < 100 THEN 'thin_liquidity' END], lambda x: x IS NOT NULL)) END AS tags FROM u LEFT JOIN markets m ON m.market_uid = u.market_uid WHERE u.market_uid IS NOT NULL")
def sc22(spark: SparkSession, folder: str) -> DataFrame:
    """Markets of every table, with or without control metadata."""
    every = None
    for name in ("markets", "fills", "match_results"):
        one = table(spark, folder, name).filter("market_uid is not null").select("market_uid").distinct()
        every = one if every is None else every.unionByName(one)
    controls = table(spark, folder, "markets").select("market_uid", "live_event", "scheduled_announcement_at", "closes_at", "liquidity", F.lit(True).alias("controlled"))
    rows = every.distinct().join(small_side(controls), "market_uid", "left")
    tags = control_tags(F.lit(1710000000), F.coalesce("controlled", F.lit(False)), F.col("live_event"), F.col("scheduled_announcement_at"), F.col("closes_at"), F.col("liquidity"))
    return rows.select("market_uid", tags.alias("tags"))
