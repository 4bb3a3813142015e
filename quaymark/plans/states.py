"""Queries over run states, schedules, cohorts, retrieval order, and uncertainty."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.operators.actors import actor_features
from quaymark.operators.asof import instant, ordered_reason, reasons
from quaymark.operators.evaluate import average_precision, disjoint_split
from quaymark.operators.evidence import rerank
from quaymark.operators.ranks import placed
from quaymark.operators.uncertainty import fit, ood_scores
from quaymark.plans.evaluation import _ROWS, eval_rows
from quaymark.plans.feeds import _ARRIVED, arrived_frames
from quaymark.plans.market import _MEANING, r6
from quaymark.plans.people import _COMP, _composites
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import FILLS, with_
from quaymark.plans.texts import _hits
from quaymark.session import materialise, scratch_path, small_side
from quaymark.sources.domain import fills
from quaymark.sources.tables import table
from quaymark.streaming.sequences import run_once, sequence_states, stream_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --- runs ------------------------------------------------------------------------------------------------------------
@query("st01_bounded_run", "SELECT CASE WHEN event_id % 3 < 2 THEN 0 ELSE 1 END AS run, count(*) AS frames, CASE WHEN event_id % 3 < 2 THEN CAST([] AS VARCHAR[]) ELSE ['resumed_connection'] END AS gaps FROM events GROUP BY ALL")
def st01(spark: SparkSession, folder: str) -> DataFrame:
    """A run of two landed files, then a restart from its checkpoint with a third: no frame twice, and the restart is a gap."""
    root, out, state = (scratch_path(spark, n) for n in ("frames", "run", "run-state"))
    rows = table(spark, folder, "events").select("event_id", "event_type")
    for run in (0, 1):
        own = rows.filter(F.col("event_id") % 3 < 2) if run == 0 else rows.filter(F.col("event_id") % 3 == 2)
        own.repartition(2).write.mode("append").parquet(root)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root).withColumn("run", F.lit(run))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("event_id long, event_type string, run int").parquet(out)
    gaps = F.when(F.col("run") > 0, F.array(F.lit("resumed_connection"))).otherwise(F.array().cast("array<string>"))
    return done.groupBy("run").agg(F.count(F.lit(1)).alias("frames")).select("run", "frames", gaps.alias("gaps"))


@query("st03_run_watermarks", "WITH d AS (SELECT event_type AS stream, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, max(epoch_us(ts) + (event_id % 7) * 1000000) AS received, max(epoch_us(ts) - (event_id % 900) * 1000000) AS happened FROM events GROUP BY ALL) SELECT stream, day, max(received) OVER w AS received_mark, max(happened) OVER w AS event_mark FROM d WINDOW w AS (PARTITION BY stream ORDER BY day)")
def st03(spark: SparkSession, folder: str) -> DataFrame:
    """The two marks of each stream, by receipt and by venue time, at the end of each day: neither ever falls."""
    us, i = F.unix_micros("ts"), F.col("event_id")
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("stream"), F.floor(F.unix_seconds("ts") / 86_400).alias("day")).agg(F.max(us + F.pmod(i, F.lit(7)) * 1_000_000).alias("received"), F.max(us - F.pmod(i, F.lit(900)) * 1_000_000).alias("happened"))
    w = Window.partitionBy("stream").orderBy("day")
    return rows.select("stream", "day", F.max("received").over(w).alias("received_mark"), F.max("happened").over(w).alias("event_mark"))


@query("st05_verified_lineage", "SELECT market_uid, count(*) FILTER (right(raw_artifact_uid, 1) NOT IN ('0', '8')) AS admitted, count(*) FILTER (right(raw_artifact_uid, 1) IN ('0', '8') OR raw_artifact_uid IS NULL) AS lineage_unverified FROM fills GROUP BY market_uid")
def st05(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of fills admitted if their artifact is among the verified ones, a static table; the rest is kept apart."""
    verified = table(spark, folder, "fills").select("raw_artifact_uid").filter("right(raw_artifact_uid, 1) not in ('0', '8')").distinct().withColumn("verified", F.lit(True))
    stream = stream_table(spark, folder, "fills").select("delivery_id", "market_uid", "raw_artifact_uid")
    out = run_once(stream.join(verified, "raw_artifact_uid", "left").select("market_uid", F.coalesce("verified", F.lit(False)).alias("verified")), "lineage")
    return out.groupBy("market_uid").agg(F.count_if("verified").alias("admitted"), F.count_if(~F.col("verified")).alias("lineage_unverified"))


@query("st08_run_snapshot", with_(_ARRIVED) + "SELECT stream, count(*) AS frames, count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (status = 'replay') AS replays, max(seq) AS last_seq, list_sort(list_filter([CASE WHEN bool_or(status = 'gap') THEN 'sequence_gap' END, CASE WHEN bool_or(status = 'replay') THEN 'replayed_or_out_of_order' END, CASE WHEN arg_max(coalesce(g > coalesce(f, -1), false), k) FILTER (status <> 'replay') THEN 'book_withheld' END], lambda x: x IS NOT NULL)) AS partial_reasons FROM l GROUP BY stream")
def st08(spark: SparkSession, folder: str) -> DataFrame:
    """What a run came to: counts, the last number, and why its coverage is partial."""
    states = run_once(sequence_states(arrived_frames(spark, folder)), "snapshot")
    is_ = lambda s: F.col("status") == s
    last = F.max_by("withheld", F.when(~is_("replay"), F.col("seq")))
    per = states.groupBy("stream").agg(F.count(F.lit(1)).alias("frames"), F.count_if(is_("gap")).alias("gaps"), F.count_if(is_("replay")).alias("replays"), F.max("seq").alias("last_seq"), last.alias("closed"))
    return per.select("stream", "frames", "gaps", "replays", "last_seq", reasons({"sequence_gap": F.col("gaps") > 0, "replayed_or_out_of_order": F.col("replays") > 0, "book_withheld": F.col("closed")}).alias("partial_reasons"))


def follow_up_states(attempts: DataFrame, retries: int, delay: int, interval: int) -> DataFrame:
    """The schedule after each attempt of a registration, in order of (at, uid), up to the first that ends it.

    attempts: registration, uid, at and expires_at (seconds), failed, covers_expiry, more (a continuation is pending).
    status: complete or expired at the end of the watch, retries_exhausted, retry_scheduled, continuation_pending or
    scheduled; next_due is null once it has ended.
    """
    w = Window.partitionBy("registration").orderBy("at", "uid")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = attempts.withColumn("over", F.col("at") >= F.col("expires_at")).withColumn("retry_count", F.count_if(F.col("failed") & ~F.col("over")).over(upto))
    status = ordered_reason([("complete", F.col("over") & F.col("covers_expiry")), ("expired", F.col("over")), ("retries_exhausted", F.col("failed") & (F.col("retry_count") > retries)), ("retry_scheduled", F.col("failed")), ("continuation_pending", F.col("more"))], "scheduled")
    ended = F.col("status").isin("complete", "expired", "retries_exhausted")
    df = df.withColumn("status", status).withColumn("ends", F.count_if(ended).over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("ends = 0")
    due = F.when(F.col("status") == "retry_scheduled", F.least(F.col("at") + delay, "expires_at")).when(F.col("status") == "continuation_pending", F.col("at")).when(F.col("status") == "scheduled", F.least(F.col("at") + interval, "expires_at"))
    return df.select("registration", "uid", "status", due.alias("next_due"), "retry_count")


_ATT = "a1 AS (SELECT actor_uid AS registration, fill_uid AS uid, CAST(floor(epoch(event_time)) AS BIGINT) AS t, min(CAST(floor(epoch(event_time)) AS BIGINT)) OVER (PARTITION BY actor_uid) + 864000 AS x, delivery_id % 3 = 0 AS bad, delivery_id % 2 = 0 AS covers, delivery_id % 5 = 0 AS more FROM f WHERE actor_uid IS NOT NULL AND event_time IS NOT NULL), a2 AS (SELECT *, count(*) FILTER (bad AND t < x) OVER (PARTITION BY registration ORDER BY t, uid ROWS UNBOUNDED PRECEDING) AS retry_count FROM a1), a3 AS (SELECT *, CASE WHEN t >= x AND covers THEN 'complete' WHEN t >= x THEN 'expired' WHEN bad AND retry_count > 3 THEN 'retries_exhausted' WHEN bad THEN 'retry_scheduled' WHEN more THEN 'continuation_pending' ELSE 'scheduled' END AS status FROM a2), a4 AS (SELECT *, count(*) FILTER (status IN ('complete', 'expired', 'retries_exhausted')) OVER (PARTITION BY registration ORDER BY t, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ends FROM a3)"


@query("st09_follow_up_states", with_(FILLS, _ATT) + "SELECT registration, uid, status, CASE status WHEN 'retry_scheduled' THEN least(t + 3600, x) WHEN 'continuation_pending' THEN t WHEN 'scheduled' THEN least(t + 21600, x) END AS next_due, retry_count FROM a4 WHERE ends = 0")
def st09(spark: SparkSession, folder: str) -> DataFrame:
    rows = fills(spark, folder).filter("actor_uid is not null and event_time is not null")
    t, i = F.unix_seconds("event_time"), F.col("delivery_id")
    attempts = rows.select(F.col("actor_uid").alias("registration"), F.col("fill_uid").alias("uid"), t.alias("at"), (i % 3 == 0).alias("failed"), (i % 2 == 0).alias("covers_expiry"), (i % 5 == 0).alias("more"))
    ends = attempts.groupBy("registration").agg((F.min("at") + 864_000).alias("expires_at"))
    return follow_up_states(attempts.join(ends, "registration"), 3, 3_600, 21_600)


# --- cohorts ---------------------------------------------------------------------------------------------------------
_LONG = "lg AS (SELECT actor_uid, count(*) FILTER (event_time < TIMESTAMP '2024-03-05') AS n_old, count(*) FILTER (event_time < TIMESTAMP '2024-03-05' AND ingested_at < TIMESTAMP '2024-03-05') AS n_known FROM f WHERE actor_uid IS NOT NULL GROUP BY actor_uid)"


@query("cmp06_priority_queue", with_(FILLS, _COMP, _LONG) + ", b AS (SELECT actor_uid, rank() OVER (ORDER BY round(composite, 6) DESC) AS population_rank FROM cp WHERE composite IS NOT NULL), j AS (SELECT b.*, CASE WHEN n_known >= 3 THEN n_known END AS value FROM b LEFT JOIN lg USING (actor_uid)), r AS (SELECT *, rank() OVER (ORDER BY population_rank, value IS NULL, value DESC) AS rank, count(*) OVER (PARTITION BY population_rank, value) AS ties, row_number() OVER (ORDER BY population_rank, value IS NULL, value DESC, actor_uid) AS place FROM j) SELECT actor_uid, population_rank, value, rank, ties, place <= 25 AS selected FROM r")
def cmp06(spark: SparkSession, folder: str) -> DataFrame:
    """The review queue of all ranked actors: population rank, then those with longitudinal evidence by its value; ranks with
    ties, and a budget of 25 in order of uid within ties. Ranks come from the counts of distinct orders."""
    ranked = placed(_composites(spark, folder).filter("composite is not null").select("actor_uid", "composite"), "composite")
    old, known = F.col("event_time") < instant("2024-03-05"), F.col("ingested_at") < instant("2024-03-05")
    value = fills(spark, folder).filter("actor_uid is not null").groupBy("actor_uid").agg(F.count_if(old & known).alias("n"))
    rows = materialise(ranked.join(value, "actor_uid", "left").select("actor_uid", F.col("rank").alias("population_rank"), F.when(F.col("n") >= 3, F.col("n")).alias("value")), "queue")
    # An order is one number: population rank first, value within it; neither exceeds the number of rows.
    most = rows.agg(F.coalesce(F.max("value"), F.lit(0))).scalar()
    order = placed(rows.withColumn("order", -(F.col("population_rank") * (most + 2) - F.coalesce(F.col("value") + 1, F.lit(0)))), "order")
    best = rows.orderBy("population_rank", F.col("value").desc_nulls_last(), "actor_uid").limit(25).select(F.col("actor_uid").alias("u"), F.lit(True).alias("best"))
    return order.join(F.broadcast(best), F.col("actor_uid") == F.col("u"), "left").select("actor_uid", "population_rank", "value", "rank", "ties", F.coalesce("best", F.lit(False)).alias("selected"))


@query("cmp08_cohort_replay", f"WITH s AS (SELECT *, CASE WHEN event_time < TIMESTAMP '2024-03-11' THEN 'first' ELSE 'second' END AS slice FROM fills WHERE actor_uid IS NOT NULL AND event_time IS NOT NULL), g AS (SELECT slice, actor_uid, fill_uid, count(*) AS n, count(DISTINCT {_MEANING}) AS m FROM s GROUP BY ALL), a AS (SELECT slice, actor_uid, CAST(sum(n) AS BIGINT) AS raw, count(*) AS canonical, CAST(sum(CASE WHEN m = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN m > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS conflicts FROM g GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY slice ORDER BY canonical DESC) AS rank, count(*) OVER (PARTITION BY slice, canonical) AS ties FROM a")
def cmp08(spark: SparkSession, folder: str) -> DataFrame:
    """Two coverage slices replayed: raw, canonical, duplicate and conflicting deliveries of each actor, and the descriptive rank."""
    half = F.when(F.col("event_time") < instant("2024-03-11"), "first").otherwise("second")
    meaning = F.struct("market_uid", "outcome_uid", "price", "size", "side", "transaction_uid", "event_time")
    rows = table(spark, folder, "fills").filter("actor_uid is not null and event_time is not null").withColumn("slice", half)
    per = rows.groupBy("slice", "actor_uid", "fill_uid").agg(F.count(F.lit(1)).alias("n"), (F.min(meaning) == F.max(meaning)).alias("same"))
    counts = per.groupBy("slice", "actor_uid").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("canonical"), F.sum(F.when(F.col("same"), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(F.col("same"), 0).otherwise(F.col("n") - 1)).alias("conflicts"))
    return placed(counts, "canonical", ["slice"]).select("slice", "actor_uid", "raw", "canonical", "duplicates", "conflicts", "rank", "ties")


@query("cmp10_behaviour_output", with_(FILLS, "b AS (SELECT * FROM f WHERE right(fill_uid, 1) <> '0')") + "SELECT actor_uid, count(*) AS fills, count(DISTINCT market_uid) AS markets, round(sum(CAST(size AS DOUBLE)), 4) AS gross FROM b WHERE actor_uid IS NOT NULL GROUP BY actor_uid")
def cmp10(spark: SparkSession, folder: str) -> DataFrame:
    """Behaviour from fills bound to their pointers by uid and hash; a pointer with another hash binds nothing."""
    rows = fills(spark, folder).withColumn("hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("fill_uid", "market_uid", "price", "size", "event_time")]), 256))
    pointers = rows.select("fill_uid", F.when(F.right("fill_uid", F.lit(1)) == "0", F.lit("0" * 64)).otherwise(F.col("hash")).alias("hash"))
    bound = rows.join(pointers, ["fill_uid", "hash"], "left_semi")
    return actor_features(bound).select("actor_uid", "fills", "markets", F.round("gross", 4).alias("gross"))


@query("cmp11_readiness", with_(_ROWS, "a AS (SELECT *, as_of IS NOT NULL AND as_of <= TIMESTAMP '2024-03-20' AND score IS NOT NULL AS ok FROM er), v AS (SELECT score AS s, label FROM a WHERE ok AND label <> 'unknown'), p AS (SELECT s, count(*) FILTER (label = 'positive') AS p, count(*) AS c FROM v GROUP BY s), t AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS n FROM p)") + "SELECT (SELECT count(*) FROM a WHERE ok) AS admitted, (SELECT count(*) FROM a WHERE NOT coalesce(ok, false)) AS excluded, (SELECT list_sort(list_filter([CASE WHEN count(*) FILTER (label = 'positive') < 50 THEN 'too_few_positives' END, CASE WHEN count(*) FILTER (label = 'negative') < 50 THEN 'too_few_negatives' END, CASE WHEN count(DISTINCT document_uid) < 1000000 THEN 'too_few_documents' END], lambda x: x IS NOT NULL)) FROM a WHERE ok) AS reasons, (SELECT round(sum(p * tp / n) / sum(p), 6) FROM t) AS naive_average_precision")
def cmp11(spark: SparkSession, folder: str) -> DataFrame:
    """Rows admissible as of the cut-off, those that are not, why the data are not ready, and how far the naive score gets."""
    rows = materialise(eval_rows(spark, folder).withColumn("ok", F.coalesce((F.col("as_of") <= instant("2024-03-20")) & F.col("score").isNotNull(), F.lit(False))), "rows")
    is_ = lambda label: F.count_if(F.col("ok") & (F.col("label") == label))
    docs = rows.filter("ok").select("document_uid").distinct().agg(F.count("document_uid").alias("docs"))
    n = rows.agg(F.count_if("ok").alias("admitted"), F.count_if(~F.col("ok")).alias("excluded"), is_("positive").alias("p"), is_("negative").alias("q"))
    naive = average_precision(rows.filter("ok"))
    one = n.withColumn("docs", docs.scalar()).withColumn("ap", naive.scalar())  # single rows
    why = reasons({"too_few_positives": F.col("p") < 50, "too_few_negatives": F.col("q") < 50, "too_few_documents": F.col("docs") < 1_000_000})
    return one.select("admitted", "excluded", why.alias("reasons"), r6("ap", "naive_average_precision"))


@query("ctr06_operational_claim", with_(_ROWS, "t AS (SELECT * FROM er WHERE as_of IS NOT NULL), c AS (SELECT quantile_cont(epoch_us(as_of), 0.8) AS cut FROM t), p AS (SELECT t.*, epoch_us(as_of) <= cut AS train FROM t, c), h AS (SELECT * FROM p WHERE NOT train AND document_uid NOT IN (SELECT document_uid FROM p WHERE train))") + "SELECT platform, count(*) AS held_out, false AS claim_available, CASE WHEN count(*) FILTER (label <> 'unknown') < 50 THEN 'calibration_unavailable:insufficient_labels' WHEN count(*) FILTER (label = 'positive') < 10 THEN 'calibration_unavailable:insufficient_positives' WHEN count(*) FILTER (label = 'negative') < 10 THEN 'calibration_unavailable:insufficient_negatives' ELSE 'prospective_governance_evidence_required' END AS reason FROM h GROUP BY platform")
def ctr06(spark: SparkSession, folder: str) -> DataFrame:
    """Of the held-out, later and group-disjoint rows of a platform: why no claim of performance can be made. None ever can
    from these alone, so only the reason varies."""
    held = disjoint_split(eval_rows(spark, folder).filter("as_of is not null"), "as_of", "document_uid", 0.8).filter("part = 'test'")
    is_ = lambda label: F.count_if(F.col("label") == label)
    per = held.groupBy("platform").agg(F.count(F.lit(1)).alias("held_out"), F.count_if(F.col("label") != "unknown").alias("n"), is_("positive").alias("p"), is_("negative").alias("q"))
    why = ordered_reason([("calibration_unavailable:insufficient_labels", F.col("n") < 50), ("calibration_unavailable:insufficient_positives", F.col("p") < 10), ("calibration_unavailable:insufficient_negatives", F.col("q") < 10)], "prospective_governance_evidence_required")
    return per.select("platform", "held_out", F.lit(False).alias("claim_available"), why.alias("reason"))


# --- retrieval and uncertainty ---------------------------------------------------------------------------------------
_COS50 = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS record_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS cosine FROM q, embeddings WHERE vec_id <> query_id), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, record_id) AS k FROM s QUALIFY k <= 50), r AS (SELECT query_id, record_id, cosine, 0.55 * (cosine + 1) / 2 + 0.15 * 0.5 + 0.15 * pow(2, -(record_id % 365) / 30.0) + 0.075 * CASE WHEN record_id % 3 = 0 THEN 1 ELSE 0 END + 0.075 * 0.8 AS rerank FROM h)"


@query("top08_retrieval_order", with_(_COS50) + "SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank, 9) DESC, round(cosine, 9) DESC, record_id) AS place, round(rerank, 6) AS rerank FROM r QUALIFY place <= 10")
def top08(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty candidates of each query by cosine, then the best ten by (rerank, cosine, uid)."""
    uid = F.col("record_id")
    scored = rerank(_hits(spark, folder, 50).drop("place"), F.lit(1.0), F.lit(0.5), F.pow(F.lit(2.0), -(uid % 365) / 30.0), F.when(uid % 3 == 0, 1.0).otherwise(0.0), F.lit(0.8))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("rerank", 9).desc(), F.round("cosine", 9).desc(), "record_id"))
    return scored.withColumn("place", place.cast("long")).filter("place <= 10").select("query_id", "record_id", "place", r6("rerank"))


@query("vec07_embedding_gates", "SELECT evidence_uid, CASE WHEN trim(coalesce(title, '') || coalesce(body, '')) = '' THEN 'text_empty' WHEN first_seen_at IS NULL THEN 'availability_unknown' WHEN first_seen_at > TIMESTAMP '2024-03-20' THEN 'not_available_as_of' WHEN raw_artifact_uid IS NULL THEN 'provenance_missing' ELSE 'prepared' END AS status, CASE WHEN status = 'prepared' THEN sha256('document: ' || coalesce(title, '') || chr(10) || coalesce(body, '')) END AS document_key, CASE WHEN status = 'prepared' THEN sha256('query: ' || coalesce(title, '') || chr(10) || coalesce(body, '')) END AS query_key FROM evidence")
def vec07(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that may be embedded as of the cut-off, or why not; a text has separate keys as document and as query."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    status = ordered_reason([("text_empty", F.trim(F.concat(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))) == ""), ("availability_unknown", F.col("first_seen_at").isNull()), ("not_available_as_of", F.col("first_seen_at") > instant("2024-03-20")), ("provenance_missing", F.col("raw_artifact_uid").isNull())], "prepared")
    key = lambda mode: F.when(F.col("status") == "prepared", F.sha2(F.concat(F.lit(f"{mode}: "), text), 256)).alias(f"{mode}_key")
    return table(spark, folder, "evidence").withColumn("status", status).select("evidence_uid", "status", key("document"), key("query"))


#: The first so many records by id are the reference population, at every size.
REFERENCES = 300


@query("cmp13_out_of_distribution", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT * FROM v ORDER BY vec_id LIMIT {REFERENCES}), d AS (SELECT v.vec_id, r.vec_id AS ref, list_distance(v.e, r.e) AS d FROM v, r),
 n AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d), k AS (SELECT vec_id, max(d) FILTER (k = 5) AS near FROM n GROUP BY vec_id), x AS (SELECT vec_id, max(-0.5 * d * d) AS top FROM d GROUP BY vec_id), g AS (SELECT vec_id, -(any_value(top) + ln(avg(exp(-0.5 * d * d - top)))) AS energy FROM d JOIN x USING (vec_id) GROUP BY vec_id),
 l AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d WHERE vec_id <> ref AND vec_id IN (SELECT vec_id FROM r)), sk AS (SELECT greatest(quantile_cont(d, 0.9), 1e-12) AS ks FROM l WHERE k = 5), ec AS (SELECT median(energy) AS c FROM g WHERE vec_id IN (SELECT vec_id FROM r)), es AS (SELECT greatest(quantile_cont(abs(energy - c), 0.9), 1e-12) AS es FROM g, ec WHERE vec_id IN (SELECT vec_id FROM r))
 SELECT vec_id, round(near, 5) AS knn_distance, round(energy, 5) AS energy, round(least(1, 1 - exp(-0.5 * greatest(0, near / ks - 1) - 0.5 * greatest(0, (energy - c) / es))), 4) AS ood FROM k JOIN g USING (vec_id), sk, ec, es""")
def cmp13(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's distance to its fifth reference and its kernel energy, scaled by the references' own."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    own = rows.orderBy("vec_id").limit(REFERENCES).collect()  # a fixed number
    reference = fit(np.array([r["embedding"] for r in own], float)) if own else None
    return ood_scores(rows, "vec_id", "embedding", reference).select("vec_id", F.round("knn_distance", 5).alias("knn_distance"), F.round("energy", 5).alias("energy"), F.round("ood", 4).alias("ood"))
