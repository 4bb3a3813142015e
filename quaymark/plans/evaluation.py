"""Queries over labels, splits, fusion and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.operators.asof import instant, reasons
from quaymark.operators.evaluate import average_precision, bootstrap, calibration, component_split, conformal_threshold, core_metrics, disjoint_split, fuse
from quaymark.operators.graph import claim_paths, components, degrees, hub_factor, neighbourhood, simple_paths
from quaymark.plans.market import r6
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import FILLS, with_
from quaymark.sources.domain import fills
from quaymark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_ROWS = "er AS (SELECT DISTINCT match_uid AS row_uid, market_uid, document_uid, as_of, lexical_score AS score, CASE WHEN lexical_score IS NULL OR as_of IS NULL THEN 'unknown' WHEN relevant THEN 'positive' ELSE 'negative' END AS label, split_part(market_uid, ':', 1) AS platform, (epoch_us(ingested_at) - epoch_us(as_of)) / 1000000.0 AS delay FROM match_results)"


def eval_rows(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("lexical_score").isNull() | F.col("as_of").isNull(), "unknown").when(F.col("relevant"), "positive").otherwise("negative")
    return table(spark, folder, "match_results").select(
        F.col("match_uid").alias("row_uid"), "market_uid", "document_uid", "as_of", F.col("lexical_score").alias("score"), label.alias("label"), F.split_part("market_uid", F.lit(":"), F.lit(1)).alias("platform"), ((F.unix_micros("ingested_at") - F.unix_micros("as_of")) / 1_000_000).alias("delay")
    ).distinct()


def _core_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}count(*) AS rows, count(*) FILTER (label = 'positive') AS positives, count(*) FILTER (label = 'negative') AS negatives, round(count(*) FILTER (label <> 'unknown') / count(*), 6) AS labeled_fraction,
     round(count(*) FILTER (place <= 50 AND label = 'positive') / nullif(count(*) FILTER (place <= 50 AND label <> 'unknown'), 0), 6) AS precision_at_k, round(count(*) FILTER (place <= 50 AND label = 'positive') / nullif(count(*) FILTER (label = 'positive'), 0), 6) AS recall_at_k, round(avg(delay), 3) AS mean_delay
     FROM (SELECT *, row_number() OVER ({part} ORDER BY score DESC, row_uid) AS place FROM er WHERE score IS NOT NULL) {'GROUP BY ' + by if by else ''}"""


_METRICS = ["labeled_fraction", "precision_at_k", "recall_at_k"]


@query("agg16_evaluation_core", with_(_ROWS) + _core_sql(""))
def agg16(spark: SparkSession, folder: str) -> DataFrame:
    df = core_metrics(eval_rows(spark, folder), 50)
    return df.select("rows", "positives", "negatives", *[r6(c) for c in _METRICS], F.round("mean_delay", 3).alias("mean_delay"))


@query("agg17_average_precision", with_(_ROWS) + "SELECT round(sum(p * tp / n) / sum(p), 6) AS average_precision FROM (SELECT score, p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n FROM (SELECT score, count(*) FILTER (label = 'positive') AS p, count(*) AS c FROM er WHERE label <> 'unknown' AND score IS NOT NULL GROUP BY score))")
def agg17(spark: SparkSession, folder: str) -> DataFrame:
    return average_precision(eval_rows(spark, folder)).select(r6("average_precision"))


@query("agg18_calibration", with_(_ROWS) + "SELECT round(sum(n * abs(s - r)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier, CAST(sum(n) AS BIGINT) AS labeled FROM (SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(score) AS s, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0 END) AS r, sum(pow(score - CASE WHEN label = 'positive' THEN 1.0 ELSE 0 END, 2)) AS sq FROM er WHERE label <> 'unknown' AND score IS NOT NULL GROUP BY 1)")
def agg18(spark: SparkSession, folder: str) -> DataFrame:
    return calibration(eval_rows(spark, folder), 10).select(r6("ece"), r6("brier"), "labeled")


@query("agg19_label_gate", with_(_ROWS) + "SELECT market_uid, list_sort(list_filter([CASE WHEN count(*) FILTER (label = 'positive') < 3 THEN 'too_few_positives' END, CASE WHEN count(*) FILTER (label = 'negative') < 3 THEN 'too_few_negatives' END, CASE WHEN count(*) FILTER (label <> 'unknown') / count(*) < 0.9 THEN 'labels_incomplete' END], lambda x: x IS NOT NULL)) AS reasons FROM er GROUP BY market_uid")
def agg19(spark: SparkSession, folder: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("label") == v)
    per = eval_rows(spark, folder).groupBy("market_uid").agg(n("positive").alias("p"), n("negative").alias("q"), F.count(F.lit(1)).alias("n"))
    return per.select("market_uid", reasons({"too_few_positives": F.col("p") < 3, "too_few_negatives": F.col("q") < 3, "labels_incomplete": (F.col("p") + F.col("q")) / F.col("n") < 0.9}).alias("reasons"))


@query("agg20_slices", with_(_ROWS) + "SELECT platform, label, count(*) AS n FROM er GROUP BY GROUPING SETS ((platform), (label))")
def agg20(spark: SparkSession, folder: str) -> DataFrame:
    return eval_rows(spark, folder).groupingSets([["platform"], ["label"]], "platform", "label").agg(F.count(F.lit(1)).alias("n"))


@query("agg20b_slice_metrics", with_(_ROWS) + _core_sql("platform"))
def agg20b(spark: SparkSession, folder: str) -> DataFrame:
    df = core_metrics(eval_rows(spark, folder), 50, ["platform"])
    return df.select("platform", "rows", "positives", "negatives", *[r6(c) for c in _METRICS], F.round("mean_delay", 3).alias("mean_delay"))


@query("agg21_cluster_bootstrap")
def agg21(spark: SparkSession, folder: str) -> DataFrame:
    return bootstrap(eval_rows(spark, folder), "document_uid", 200)


@query("agg22_timeline_metrics", with_(_ROWS) + "SELECT CAST(floor(epoch(as_of) / 86400) AS BIGINT) AS day, count(*) AS rows, count(*) FILTER (label = 'positive') AS positives, round(median(delay) FILTER (label = 'positive'), 3) AS median_delay FROM er WHERE as_of IS NOT NULL GROUP BY 1")
def agg22(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_rows(spark, folder).filter("as_of is not null")
    hit = F.col("label") == "positive"
    return rows.groupBy(F.floor(F.unix_seconds("as_of") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("positives"), F.round(F.percentile(F.when(hit, F.col("delay")), F.lit(0.5)), 3).alias("median_delay"))


@query("agg23_selective_metrics", with_(_ROWS) + "SELECT platform, count(*) FILTER (score >= 0.5) AS answered, count(*) FILTER (score < 0.5 OR score IS NULL) AS abstained, round(count(*) FILTER (score >= 0.5 AND label = 'positive') / nullif(count(*) FILTER (score >= 0.5 AND label <> 'unknown'), 0), 6) AS selective_precision FROM er GROUP BY platform")
def agg23(spark: SparkSession, folder: str) -> DataFrame:
    on = F.coalesce(F.col("score") >= 0.5, F.lit(False))
    per = eval_rows(spark, folder).groupBy("platform").agg(F.count_if(on).alias("answered"), F.count_if(~on).alias("abstained"), F.try_divide(F.count_if(on & (F.col("label") == "positive")), F.count_if(on & (F.col("label") != "unknown"))).alias("selective_precision"))
    return per.select("platform", "answered", "abstained", r6("selective_precision"))


@query("win20_conformal", with_(_ROWS, "l AS (SELECT * FROM er WHERE label = 'positive' AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY platform ORDER BY as_of DESC, row_uid DESC) <= 200), p AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY score, row_uid) AS k, count(*) OVER (PARTITION BY platform) AS n FROM l)") + "SELECT platform, round(score, 6) AS threshold, n AS used FROM p WHERE k = least(n, CAST(ceil((n + 1) * 0.1) AS BIGINT))")
def win20(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_rows(spark, folder).filter("label = 'positive' and score is not null").select("platform", "score", F.col("as_of").alias("feedback_time"), F.col("row_uid").alias("uid"))
    return conformal_threshold(rows, "platform", 0.1).select("platform", r6("threshold"), "used")


@query("win21_budgeted_routing", with_(_ROWS) + "SELECT row_uid FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY as_of, row_uid) AS k FROM er WHERE score >= 0.6 AND as_of IS NOT NULL) WHERE k <= 20")
def win21(spark: SparkSession, folder: str) -> DataFrame:
    """Eligible rows are admitted in time order until the budget of their platform is used; eligibility does not depend on order."""
    rows = eval_rows(spark, folder).filter("score >= 0.6 and as_of is not null")
    place = F.row_number().over(Window.partitionBy("platform").orderBy("as_of", "row_uid"))
    return rows.withColumn("k", place).filter("k <= 20").select("row_uid")


@query("win22_disjoint_split", with_(_ROWS, "t AS (SELECT * FROM er WHERE as_of IS NOT NULL), c AS (SELECT quantile_cont(epoch_us(as_of), 0.6) AS cut FROM t), p AS (SELECT row_uid, document_uid, CASE WHEN epoch_us(as_of) <= cut THEN 'train' ELSE 'test' END AS part FROM t, c)") + "SELECT row_uid, part FROM p WHERE part = 'train' OR document_uid NOT IN (SELECT document_uid FROM p WHERE part = 'train')")
def win22(spark: SparkSession, folder: str) -> DataFrame:
    return disjoint_split(eval_rows(spark, folder).filter("as_of is not null"), "as_of", "document_uid", 0.6).select("row_uid", "part")


@query("win23_component_split")
def win23(spark: SparkSession, folder: str) -> DataFrame:
    return component_split(eval_rows(spark, folder).filter("as_of is not null"), "row_uid", ["document_uid"], "as_of", (0.6, 0.8)).select("row_uid", "part")


@query("win24_hard_negatives", "SELECT market_uid, kind, CAST(epoch(scheduled_announcement_at) AS BIGINT) + shift AS window_start FROM markets, (VALUES ('same_hour_day_before', -86400), ('same_hour_day_after', 86400), ('week_before', -604800), ('hour_before', -3600)) k(kind, shift) WHERE scheduled_announcement_at IS NOT NULL")
def win24(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).cast("long").alias("shift")) for k, s in (("same_hour_day_before", -86_400), ("same_hour_day_after", 86_400), ("week_before", -604_800), ("hour_before", -3_600))])
    rows = table(spark, folder, "markets").filter("scheduled_announcement_at is not null").select("market_uid", "scheduled_announcement_at", F.inline(kinds))
    return rows.select("market_uid", "kind", (F.unix_seconds("scheduled_announcement_at") + F.col("shift")).alias("window_start"))


@query("agg24_late_fusion", "WITH s AS (SELECT market_uid, 'text' AS modality, as_of AS seen, match_uid AS uid, lexical_score AS value, 0.8 AS reliability FROM match_results WHERE lexical_score IS NOT NULL AND as_of IS NOT NULL UNION ALL SELECT market_uid, 'trade' AS modality, event_time, fill_uid, CAST(price AS DOUBLE), 0.9 FROM fills WHERE event_time IS NOT NULL), r AS (SELECT market_uid, modality, max(seen) AS last_at, arg_max(value, (seen, uid)) AS v, any_value(reliability) AS rel FROM s GROUP BY ALL), w AS (SELECT *, rel * pow(2, -(1712000000 - floor(epoch(last_at))) / 604800) AS w FROM r) SELECT market_uid, count(*) AS modalities, round(sum(w * v) / sum(w), 6) AS fused, round(least(1, 2 * sqrt(greatest(sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2), 0))), 5) AS disagreement FROM w GROUP BY market_uid")
def agg24(spark: SparkSession, folder: str) -> DataFrame:
    text = table(spark, folder, "match_results").filter("lexical_score is not null and as_of is not null").select("market_uid", F.lit("text").alias("modality"), F.col("as_of").alias("at"), F.col("match_uid").alias("uid"), F.col("lexical_score").alias("value"), F.lit(0.8).alias("reliability"))
    trade = table(spark, folder, "fills").filter("event_time is not null").select("market_uid", F.lit("trade").alias("modality"), F.col("event_time").alias("at"), F.col("fill_uid").alias("uid"), F.col("price").cast("double").alias("value"), F.lit(0.9).alias("reliability"))
    return fuse(text.unionByName(trade), "market_uid", F.timestamp_seconds(F.lit(1712000000)), 604_800.0).select("market_uid", "modalities", r6("fused"), F.round("disagreement", 5).alias("disagreement"))


@query("cmp14_abstention", with_(_ROWS) + "SELECT row_uid, list_sort(list_filter([CASE WHEN score IS NULL THEN 'score_missing' END, CASE WHEN score BETWEEN 0.4 AND 0.6 THEN 'ambiguous' END, CASE WHEN as_of IS NULL THEN 'time_missing' END, CASE WHEN delay > 86400 THEN 'late' END], lambda x: x IS NOT NULL)) AS reasons FROM er")
def cmp14(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("score")
    return eval_rows(spark, folder).select("row_uid", reasons({"score_missing": score.isNull(), "ambiguous": score.between(0.4, 0.6), "time_missing": F.col("as_of").isNull(), "late": F.col("delay") > 86_400}).alias("reasons"))


@query("sc21_ablation", with_(_ROWS) + "SELECT row_uid, round(least(1, abs(score - 0.5)), 6) AS move, round(score / (1 + score), 6) AS squashed, round(0.5 * score + 0.5 * least(1, delay / 86400) - 0.5 * least(1, delay / 86400), 6) AS without_delay FROM er WHERE score IS NOT NULL AND delay IS NOT NULL")
def sc21(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_rows(spark, folder).filter("score is not null and delay is not null")
    return rows.select("row_uid", r6(F.least(F.lit(1.0), F.abs(F.col("score") - 0.5)), "move"), r6(F.col("score") / (1 + F.col("score")), "squashed"), r6(0.5 * F.col("score"), "without_delay"))


@query("cmp15_mechanism_baseline")
def cmp15(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression over scaled score and delay, fitted before a cut-off, judged after it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = eval_rows(spark, folder).filter("label <> 'unknown' and delay is not null").withColumn("y", (F.col("label") == "positive").cast("double"))
    parts = disjoint_split(rows, "as_of", "document_uid", 0.6)
    model = Pipeline(stages=[VectorAssembler(inputCols=["score", "delay"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="y", maxIter=20)]).fit(parts.filter("part = 'train'"))
    judged = model.transform(parts.filter("part = 'test'"))
    return judged.select("row_uid", "label", vector_to_array("probability")[1].alias("p"))


@query("cmp16_isotonic_calibration")
def cmp16(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    rows = eval_rows(spark, folder).filter("label <> 'unknown'").select("row_uid", "score", (F.col("label") == "positive").cast("double").alias("y"))
    model = IsotonicRegression(featuresCol="score", labelCol="y").fit(rows)
    return model.transform(rows).select("row_uid", "score", F.col("prediction").alias("calibrated"))


# --- graph -----------------------------------------------------------------------------------------------------------
_EDGES = "ed AS (SELECT DISTINCT maker.actor_uid AS src, taker.actor_uid AS dst, 'TRANSFERRED_TO' AS type FROM fills WHERE maker.actor_uid IS NOT NULL AND taker.actor_uid IS NOT NULL AND maker.actor_uid <> taker.actor_uid)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("maker.actor_uid"), F.col("taker.actor_uid")
    return table(spark, folder, "fills").filter(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("src"), b.alias("dst"), F.lit("TRANSFERRED_TO").alias("type")).distinct()


@query("gr02_typed_edges", with_(FILLS) + "SELECT type, count(*) AS n FROM (SELECT DISTINCT 'TRADED_IN' AS type, actor_uid AS src, market_uid AS dst FROM f WHERE actor_uid IS NOT NULL UNION SELECT 'SETTLED_IN', actor_uid, transaction_uid FROM f WHERE actor_uid IS NOT NULL AND transaction_uid IS NOT NULL UNION SELECT 'OUTCOME_OF', outcome_uid, market_uid FROM f) GROUP BY type")
def gr02(spark: SparkSession, folder: str) -> DataFrame:
    """Three typed edges of each fill in one pass."""
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.col(a).alias("src"), F.col(b).alias("dst")) for t, a, b in (("TRADED_IN", "actor_uid", "market_uid"), ("SETTLED_IN", "actor_uid", "transaction_uid"), ("OUTCOME_OF", "outcome_uid", "market_uid"))])
    rows = fills(spark, folder).select(F.inline(kinds)).filter("src is not null and dst is not null").distinct()
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_MENU = "mk AS (SELECT market_uid AS src, event_uid AS dst FROM markets WHERE event_uid IS NOT NULL)"


@query("gr05_components", "WITH RECURSIVE e AS (SELECT DISTINCT document_uid AS a, source AS b FROM evidence), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t AS (SELECT a AS id, a AS r FROM l UNION SELECT l.b, t.r FROM t JOIN l ON l.a = t.id) SELECT id, min(r) AS component FROM t GROUP BY id")
def gr05(spark: SparkSession, folder: str) -> DataFrame:
    return components(table(spark, folder, "evidence").select(F.col("document_uid").alias("a"), F.col("source").alias("b")).distinct())


@query("gr05b_cofunded_clusters", "WITH RECURSIVE " + _EDGES + ", g AS (SELECT src, min(dst) AS low FROM ed GROUP BY src), k AS (SELECT ed.dst AS a, g.low AS b FROM ed JOIN g USING (src) UNION SELECT src, dst FROM ed WHERE src < dst), l AS (SELECT a, b FROM k UNION SELECT b, a FROM k), t AS (SELECT a AS id, a AS r FROM l UNION SELECT l.b, t.r FROM t JOIN l ON l.a = t.id) SELECT id, min(r) AS component FROM t GROUP BY id")
def gr05b(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of wallets with a common funder or a direct transfer in name order. The wallets of one funder are linked to
    the first of them: the same clusters as all their pairs, with as many links as wallets."""
    rows = edges(spark, folder)
    stars = rows.join(rows.groupBy("src").agg(F.min("dst").alias("low")), "src").select(F.col("dst").alias("a"), F.col("low").alias("b"))
    return components(stars.unionByName(rows.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))))


@query("gr06_hub_factor", with_(_EDGES) + "SELECT id, count(*) AS degree, round(1 / (1 + 0.1 * greatest(count(*) - 10, 0)), 6) AS hub FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY id")
def gr06(spark: SparkSession, folder: str) -> DataFrame:
    return degrees(edges(spark, folder)).select("id", "degree", r6(hub_factor(F.col("degree")), "hub"))


@query("prs03_wallets_by_market", with_(FILLS) + "SELECT DISTINCT market_uid, actor_uid FROM f WHERE actor_uid IS NOT NULL AND actor_visibility <> 'not_available'")
def prs03(spark: SparkSession, folder: str) -> DataFrame:
    return fills(spark, folder).filter("actor_uid is not null and actor_visibility <> 'not_available'").select("market_uid", "actor_uid").distinct()
