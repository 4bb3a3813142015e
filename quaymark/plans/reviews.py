"""Queries over claims, assemblies, review cases, queues and the remaining adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import dot, half_life_weight, lead_hours, logit, norm, sigmoid, surprise
from quaymark.operators.actors import actor_features
from quaymark.operators.ranks import placed
from quaymark.operators.asof import admit, instant, ordered_reason, reasons
from quaymark.plans.evaluation import _EDGES, _ROWS, edges, eval_rows
from quaymark.plans.market import CUTOFF, FILL_CUTOFF, r6
from quaymark.plans.people import _AF
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import EFILLS, FILLS, OBS, with_
from quaymark.session import small_side
from quaymark.sources.domain import event_fills, fills, observations
from quaymark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_AGE = "(1712000000 - epoch_us(as_of) / 1000000.0)"


@query("flt14_claim_policy", with_(_ROWS) + f"SELECT row_uid, CASE WHEN as_of IS NULL THEN 'undated' WHEN score IS NULL THEN 'confidence_missing' WHEN score < 0.3 THEN 'confidence_low' WHEN label = 'negative' THEN 'contradicted' ELSE 'accepted' END AS decision, round(greatest(0.10, 1 - {_AGE} / 7776000), 6) AS recency FROM er")
def flt14(spark: SparkSession, folder: str) -> DataFrame:
    decision = ordered_reason([("undated", F.col("as_of").isNull()), ("confidence_missing", F.col("score").isNull()), ("confidence_low", F.col("score") < 0.3), ("contradicted", F.col("label") == "negative")], "accepted")
    age = 1712000000 - F.unix_micros("as_of") / 1_000_000
    return eval_rows(spark, folder).select("row_uid", decision.alias("decision"), r6(F.greatest(F.lit(0.10), 1 - age / 7_776_000), "recency"))


@query("flt15_attachable_links", f"SELECT DISTINCT m.match_uid FROM match_results m WHERE m.relevant AND m.as_of <= TIMESTAMP '{FILL_CUTOFF}' AND EXISTS (SELECT 1 FROM evidence e WHERE e.document_uid = m.document_uid AND e.first_seen_at <= TIMESTAMP '{FILL_CUTOFF}') AND EXISTS (SELECT 1 FROM fills f WHERE f.market_uid = m.market_uid AND f.ingested_at <= TIMESTAMP '{FILL_CUTOFF}')")
def flt15(spark: SparkSession, folder: str) -> DataFrame:
    cut = instant(FILL_CUTOFF)
    links = table(spark, folder, "match_results").filter(F.col("relevant") & (F.col("as_of") <= cut)).select("match_uid", "document_uid", "market_uid").distinct()
    seen = table(spark, folder, "evidence").filter(F.col("first_seen_at") <= cut).select("document_uid")
    traded = table(spark, folder, "fills").filter(F.col("ingested_at") <= cut).select("market_uid").distinct()
    return links.join(seen, "document_uid", "left_semi").join(small_side(traded), "market_uid", "left_semi").select("match_uid").distinct()


@query("flt22_serving_views", with_(OBS) + f"SELECT market_uid, count(*) AS visible, epoch_us(max(event_time)) AS newest FROM obs WHERE event_time <= TIMESTAMP '{CUTOFF}' AND ingested_at <= TIMESTAMP '{CUTOFF}' GROUP BY market_uid")
def flt22(spark: SparkSession, folder: str) -> DataFrame:
    return admit(observations(spark, folder), CUTOFF).groupBy("market_uid").agg(F.count(F.lit(1)).alias("visible"), F.unix_micros(F.max("event_time")).alias("newest"))


@query("flt23_sensitive_urls", "SELECT evidence_uid, coalesce(regexp_matches(lower(url), '(token|secret|password|[.]key)'), false) AS sensitive, coalesce(url, '') = '' AS placeholder FROM evidence")
def flt23(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence").select("evidence_uid", F.coalesce(F.lower("url").rlike("(token|secret|password|[.]key)"), F.lit(False)).alias("sensitive"), (F.coalesce("url", F.lit("")) == "").alias("placeholder"))


@query("jn05_shared_funding", with_(_EDGES) + "SELECT a.src AS funder, a.dst AS wallet, count(*) AS partners, min(b.dst) AS first_partner FROM ed a JOIN ed b ON a.src = b.src AND a.dst <> b.dst GROUP BY ALL")
def jn05(spark: SparkSession, folder: str) -> DataFrame:
    """Wallets that share a funder, each with the number of its partners and the first of them: from the two smallest names
    and the size of each group, without pairing a venue's customers with each other."""
    rows = edges(spark, folder)
    least = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("low"))
    second = rows.join(least, "src").filter("dst <> low").groupBy("src").agg(F.min("dst").alias("next"))
    both = rows.join(least, "src").join(second, "src")
    return both.select(F.col("src").alias("funder"), F.col("dst").alias("wallet"), (F.col("n") - 1).alias("partners"), F.when(F.col("dst") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("first_partner"))


@query("agg09_indexed_features", with_(FILLS) + f"SELECT actor_uid, count(*) AS fills, count(DISTINCT market_uid) AS markets, epoch_us(min(event_time)) AS first, epoch_us(max(event_time)) AS last FROM f WHERE actor_uid IS NOT NULL AND ingested_at <= TIMESTAMP '{FILL_CUTOFF}' GROUP BY actor_uid")
def agg09(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder).filter(F.col("actor_uid").isNotNull() & (F.col("ingested_at") <= instant(FILL_CUTOFF)))
    per = rows.groupBy("actor_uid", "market_uid").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    return per.groupBy("actor_uid").agg(F.sum("n").alias("fills"), F.count(F.lit(1)).alias("markets"), F.unix_micros(F.min("a")).alias("first"), F.unix_micros(F.max("b")).alias("last"))


_AXIS = "CASE WHEN publication_timestamp_status = 'VALID' THEN 3 WHEN publication_timestamp_status = 'MISSING' THEN 2 ELSE 1 END"


@query("agg27_strongest_axis", f"SELECT document_uid, max({_AXIS}) AS strongest, min({_AXIS}) AS weakest, max({_AXIS}) <> min({_AXIS}) AS contradiction FROM evidence GROUP BY document_uid")
def agg27(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("publication_timestamp_status")
    axis = F.when(status == "VALID", 3).when(status == "MISSING", 2).otherwise(1)
    return table(spark, folder, "evidence").groupBy("document_uid").agg(F.max(axis).alias("strongest"), F.min(axis).alias("weakest"), (F.max(axis) != F.min(axis)).alias("contradiction"))


@query("agg28_weakest_axis", f"SELECT source, min({_AXIS}) AS weakest, count(*) AS n FROM evidence GROUP BY source")
def agg28(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("publication_timestamp_status")
    return table(spark, folder, "evidence").groupBy("source").agg(F.min(F.when(status == "VALID", 3).when(status == "MISSING", 2).otherwise(1)).alias("weakest"), F.count(F.lit(1)).alias("n"))


@query("agg30_wallet_kinds", with_(FILLS, _AF) + "SELECT actor_uid, CASE WHEN markets >= 20 THEN 'service' WHEN fills >= 10 THEN 'active' ELSE 'occasional' END AS kind FROM af")
def agg30(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("markets") >= 20, "service").when(F.col("fills") >= 10, "active").otherwise("occasional")
    return actor_features(fills(spark, folder)).select("actor_uid", kind.alias("kind"))


@query("win16_mid_rank", with_(_ROWS) + "SELECT row_uid, round((n - r + 1 - t + (t - 1) / 2 + 0.5) / n, 6) AS percentile, r AS rank, t AS ties FROM (SELECT row_uid, count(*) OVER (PARTITION BY platform) AS n, rank() OVER (PARTITION BY platform ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY platform, s) AS t FROM (SELECT row_uid, platform, round(score, 2) AS s FROM er WHERE score IS NOT NULL))")
def win16(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_rows(spark, folder).filter("score is not null").select("row_uid", "platform", F.round("score", 2).alias("s"))
    return placed(rows, "s", ["platform"]).select("row_uid", r6("percentile"), "rank", "ties")


@query("win17_ranks", with_(_ROWS) + "SELECT row_uid, rank() OVER w AS rank, dense_rank() OVER w AS tie_group, row_number() OVER (PARTITION BY platform ORDER BY round(score, 2) DESC, row_uid) AS display_order FROM er WHERE score IS NOT NULL WINDOW w AS (PARTITION BY platform ORDER BY round(score, 2) DESC)")
def win17(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_rows(spark, folder).filter("score is not null").select("row_uid", "platform", F.round("score", 2).alias("s"))
    within = F.row_number().over(Window.partitionBy("platform", "s").orderBy("row_uid"))
    return placed(rows, "s", ["platform"]).select("row_uid", "rank", "tie_group", (F.col("rank") - 1 + within).cast("long").alias("display_order"))


@query("sc01_log_odds", with_(OBS) + "SELECT observation_uid, CASE WHEN price IS NOT NULL THEN round(ln(greatest(least(price, 1 - 1e-6), 1e-6) / (1 - greatest(least(price, 1 - 1e-6), 1e-6))), 6) END AS log_odds FROM obs")
def sc01(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select("observation_uid", r6(logit(F.col("price")), "log_odds"))


@query("sc03_transforms", with_(OBS) + "SELECT observation_uid, round(-log10(greatest(price, 1e-300)), 6) AS surprise, round(1 / (1 + exp(-price)), 6) AS squashed, round(pow(2, -price / 0.5), 6) AS decay FROM obs WHERE price IS NOT NULL")
def sc03(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("price")
    return observations(spark, folder).filter("price is not null").select("observation_uid", r6(surprise(p), "surprise"), r6(sigmoid(p), "squashed"), r6(half_life_weight(p, 0.5), "decay"))


@query("sc04_exact_notional", "SELECT market_uid, CAST(sum(price * size) AS VARCHAR) AS notional FROM fills GROUP BY market_uid")
def sc04(spark: SparkSession, folder: str) -> DataFrame:
    """Decimal to the last digit: compared as text."""
    return table(spark, folder, "fills").groupBy("market_uid").agg(F.sum(F.col("price") * F.col("size")).cast("string").alias("notional"))


@query("sc08_lead_hours", "SELECT DISTINCT m.match_uid, round((epoch_us(e.first) - epoch_us(m.as_of)) / 3600000000, 6) AS lead, abs(epoch_us(e.first) - epoch_us(m.as_of)) / 3600000000 <= 720 AS valid FROM match_results m JOIN (SELECT document_uid, min(first_seen_at) AS first FROM evidence GROUP BY document_uid) e USING (document_uid) WHERE m.as_of IS NOT NULL")
def sc08(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "evidence").groupBy("document_uid").agg(F.min("first_seen_at").alias("first"))
    rows = table(spark, folder, "match_results").filter("as_of is not null").select("match_uid", "document_uid", "as_of").distinct().join(first, "document_uid")
    lead = lead_hours(F.col("as_of"), F.col("first"))
    return rows.select("match_uid", r6(lead, "lead"), (F.abs(lead) <= 720).alias("valid"))


@query("sc16_vector_tools", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def sc16(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", r6(F.sqrt(dot(v, v)), "length"), r6(F.get(v, F.lit(0)).cast("double") / norm(v), "first"))


@query("top03_actionable", with_(_ROWS) + "SELECT row_uid FROM er WHERE label = 'positive' ORDER BY round(1 - score, 4), score DESC, row_uid")
def top03(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_rows(spark, folder).filter("label = 'positive'")
    return rows.orderBy(F.round(1 - F.col("score"), 4), F.col("score").desc(), "row_uid").select("row_uid")


@query("top09_head_and_tail", "(SELECT 'head' AS part, market_uid FROM markets ORDER BY market_uid LIMIT 10) UNION ALL (SELECT 'tail', market_uid FROM markets ORDER BY market_uid DESC LIMIT 10)")
def top09(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "markets").select("market_uid")
    part = lambda name, order: rows.orderBy(order).limit(10).select(F.lit(name).alias("part"), "market_uid")
    return part("head", F.col("market_uid").asc()).unionByName(part("tail", F.col("market_uid").desc()))


@query("set02_union_by_name", with_(OBS) + "SELECT platform, count(*) AS n, count(actor_uid) AS actors FROM (SELECT platform, NULL::VARCHAR AS actor_uid FROM obs UNION ALL SELECT platform, actor_uid FROM fills) GROUP BY platform")
def set02(spark: SparkSession, folder: str) -> DataFrame:
    both = observations(spark, folder).select("platform").unionByName(table(spark, folder, "fills").select("platform", "actor_uid"), allowMissingColumns=True)
    return both.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count("actor_uid").alias("actors"))


@query("cmp03_gated_pipeline", "WITH g AS (SELECT avg(CASE WHEN event_time IS NULL THEN 1.0 ELSE 0 END) < 0.01 AS open FROM fills) SELECT market_uid, count(*) AS n, (SELECT open FROM g) AS gate FROM fills WHERE (SELECT open FROM g) GROUP BY market_uid")
def cmp03(spark: SparkSession, folder: str) -> DataFrame:
    """A failed gate empties the batch."""
    rows = table(spark, folder, "fills")
    gate = rows.agg((F.avg(F.when(F.col("event_time").isNull(), 1.0).otherwise(0.0)) < 0.01).alias("open")).scalar()
    return rows.groupBy("market_uid").agg(F.count(F.lit(1)).alias("n")).filter(gate).withColumn("gate", gate)


@query("cmp04_event_assembly", "WITH d AS (SELECT market_uid, count(DISTINCT document_uid) AS documents FROM match_results GROUP BY market_uid), t AS (SELECT market_uid, count(*) AS trades, epoch_us(max(event_time)) AS last_trade FROM fills GROUP BY market_uid) SELECT market_uid, coalesce(documents, 0) AS documents, coalesce(trades, 0) AS trades, last_trade, list_sort(list_filter([CASE WHEN documents IS NULL THEN 'document_unavailable' END, CASE WHEN trades IS NULL THEN 'trade_unavailable' END], lambda x: x IS NOT NULL)) AS missing FROM markets LEFT JOIN d USING (market_uid) LEFT JOIN t USING (market_uid)")
def cmp04(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each market by modality; absence is stated, not dropped."""
    documents = table(spark, folder, "match_results").groupBy("market_uid").agg(F.count_distinct("document_uid").alias("documents"))
    trades = table(spark, folder, "fills").groupBy("market_uid").agg(F.count(F.lit(1)).alias("trades"), F.unix_micros(F.max("event_time")).alias("last_trade"))
    both = table(spark, folder, "markets").select("market_uid").join(documents, "market_uid", "left").join(trades, "market_uid", "left")
    missing = reasons({"document_unavailable": F.col("documents").isNull(), "trade_unavailable": F.col("trades").isNull()})
    return both.select("market_uid", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("trades", F.lit(0)).alias("trades"), "last_trade", missing.alias("missing"))


@query("cmp12_review_cases", with_(EFILLS) + "SELECT market_uid, round(arg_min(price, (event_time, fill_uid)), 6) AS first_price, round(arg_max(price, (event_time, fill_uid)), 6) AS last_price, count(*) AS fills, CASE WHEN count(*) < 100 THEN 'abstain' ELSE 'review' END AS routing FROM efills GROUP BY market_uid")
def cmp12(spark: SparkSession, folder: str) -> DataFrame:
    at = F.struct("event_time", "fill_uid")
    per = event_fills(spark, folder).groupBy("market_uid").agg(r6(F.min_by("price", at), "first_price"), r6(F.max_by("price", at), "last_price"), F.count(F.lit(1)).alias("fills"))
    return per.withColumn("routing", F.when(F.col("fills") < 100, "abstain").otherwise("review"))


@query("cmp18_shadow_controls", with_(FILLS) + "SELECT count(*) AS n, count(*) FILTER (CAST(('0x' || substr(sha256('9|' || fill_uid), 1, 16)) AS UBIGINT) / 18446744073709551616.0 < 0.1) AS controls, count(*) FILTER (event_time > ingested_at) AS future FROM f")
def cmp18(spark: SparkSession, folder: str) -> DataFrame:
    from quaymark.functions.scalars import hash_share

    return fills(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_if(hash_share(F.lit("9"), F.col("fill_uid")) < 0.1).alias("controls"), F.count_if(F.col("event_time") > F.col("ingested_at")).alias("future"))


@query("adp04_binary_books", "SELECT event_id, side, round(CASE WHEN side = 'yes' THEN value / (value + 50) ELSE 1 - value / (value + 50) END, 6) AS bid FROM events, (VALUES ('yes'), ('no')) s(side) WHERE value IS NOT NULL")
def adp04(spark: SparkSession, folder: str) -> DataFrame:
    """A binary venue's book as one of each side, bids only."""
    p = F.col("value") / (F.col("value") + 50)
    sides = F.array(F.struct(F.lit("yes").alias("side"), p.alias("bid")), F.struct(F.lit("no").alias("side"), (1 - p).alias("bid")))
    return table(spark, folder, "events").filter("value is not null").select("event_id", F.inline(sides)).select("event_id", "side", r6("bid"))


@query("adp18_coverage_lineage", "WITH d AS (SELECT source, CAST(floor(epoch(retrieved_at) / 86400) AS BIGINT) AS day, count(*) AS n FROM parsed_entries GROUP BY ALL) SELECT source, day, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY day) AS BIGINT) AS lineage, lag(day) OVER (PARTITION BY source ORDER BY day) = day - 1 AS resumed FROM d")
def adp18(spark: SparkSession, folder: str) -> DataFrame:
    per = table(spark, folder, "parsed_entries").groupBy("source", F.floor(F.unix_seconds("retrieved_at") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("day")
    return per.select("source", "day", "n", F.sum("n").over(w).alias("lineage"), (F.lag("day").over(w) == F.col("day") - 1).alias("resumed"))


@query("ctr03_trainable", with_(_ROWS) + "SELECT row_uid, label <> 'unknown' AND delay >= 0 AS trainable FROM er WHERE delay IS NOT NULL")
def ctr03(spark: SparkSession, folder: str) -> DataFrame:
    return eval_rows(spark, folder).filter("delay is not null").select("row_uid", ((F.col("label") != "unknown") & (F.col("delay") >= 0)).alias("trainable"))


@query("ctr07_context_masks", "SELECT market_uid, map {'liquidity': coalesce(liquidity, 0), 'live': CAST(live_event AS DOUBLE), 'liquidity_known': CAST(liquidity IS NOT NULL AS DOUBLE)} AS features FROM markets")
def ctr07(spark: SparkSession, folder: str) -> DataFrame:
    base = F.create_map(F.lit("liquidity"), F.coalesce("liquidity", F.lit(0.0)), F.lit("live"), F.col("live_event").cast("double"))
    mask = F.create_map(F.lit("liquidity_known"), F.col("liquidity").isNotNull().cast("double"))
    return table(spark, folder, "markets").select("market_uid", F.map_concat(base, mask).alias("features"))


@query("prs01_summary", with_(_EDGES) + "SELECT src, count(*) AS paths, max(dst) AS last FROM ed GROUP BY src")
def prs01(spark: SparkSession, folder: str) -> DataFrame:
    return edges(spark, folder).groupBy("src").agg(F.count(F.lit(1)).alias("paths"), F.max("dst").alias("last"))
