"""Queries over evidence, feeds and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.scalars import STOP_WORDS, bitcoin_address_ok, canonical_url, evm_addresses, hash_share, simple_query, terms
from quaymark.operators.asof import extreme_row, instant, reasons
from quaymark.operators.evidence import cosine_search, evidence_state, explanation, lexical_match, rerank
from quaymark.plans.market import r6
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import with_
from quaymark.session import small_side
from quaymark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def _terms_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_-]*'), lambda t: length(t) >= 3 AND t NOT IN {_STOP}))"


@query("sc09_terms", f"SELECT evidence_uid, list_sort({_terms_sql('title')}) AS terms FROM evidence")
def sc09(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence").select("evidence_uid", F.array_sort(terms(F.col("title"))).alias("terms"))


@query("sc10_simple_query", r"SELECT market_uid, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '\([^)]*\)', ' ', 'g'), '\b[0-9][0-9,.%]*', ' ', 'g'), '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))) AS search FROM markets")
def sc10(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "markets").select("market_uid", simple_query(F.col("question")).alias("search"))


@query("sc12_canonical_url", "SELECT evidence_uid, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^(https?)', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END || CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '')), '&') END ELSE '' END AS url FROM evidence")
def sc12(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence").select("evidence_uid", canonical_url(F.col("url")).alias("url"))


@query("sc13_hash_sample", "SELECT fill_uid FROM (SELECT DISTINCT fill_uid FROM fills) WHERE CAST(('0x' || substr(sha256('7|' || fill_uid), 1, 16)) AS UBIGINT) / 18446744073709551616.0 < 0.25")
def sc13(spark: SparkSession, folder: str) -> DataFrame:
    """The sampling operator: the same quarter of all uids wherever it is drawn."""
    return table(spark, folder, "fills").select("fill_uid").distinct().filter(hash_share(F.lit("7"), F.col("fill_uid")) < 0.25)


@query("sc14_json_props", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def sc14(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("sc15_array_tools", "SELECT match_uid, list_sort(list_distinct(market_terms)) AS terms, len(market_terms) AS n, list_contains(market_terms, 'bank') AS bank FROM (SELECT DISTINCT match_uid, market_terms FROM match_results)")
def sc15(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "match_results").select("match_uid", "market_terms").distinct()
    return rows.select("match_uid", F.array_sort(F.array_distinct("market_terms")).alias("terms"), F.size("market_terms").cast("long").alias("n"), F.array_contains("market_terms", "bank").alias("bank"))


@query("sc17_sparse_vector", "SELECT market_uid, coalesce(liquidity, 0) AS liquidity, liquidity IS NULL AS liquidity__missing, closes_at IS NULL AS closes_at__missing FROM markets")
def sc17(spark: SparkSession, folder: str) -> DataFrame:
    features = F.create_map(F.lit("liquidity"), F.col("liquidity"), F.lit("closes_at"), F.unix_seconds("closes_at").cast("double"))
    rows = table(spark, folder, "markets").withColumn("m", features)
    return rows.select("market_uid", F.coalesce(F.element_at("m", "liquidity"), F.lit(0.0)).alias("liquidity"), F.element_at("m", "liquidity").isNull().alias("liquidity__missing"), F.element_at("m", "closes_at").isNull().alias("closes_at__missing"))


@query("sc18_address_checksums")
def sc18(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fills").filter("actor_uid is not null").select(F.regexp_replace("actor_uid", "^wallet:", "").alias("address")).distinct()
    return rows.withColumn("valid", bitcoin_address_ok("address"))


_CLAIMS = "guilty|fraud|insider trading|criminal"


@query("sc20_text_firewall", f"SELECT evidence_uid, regexp_replace(regexp_replace(title, '[<>]', '', 'g'), '[[:cntrl:]]', ' ', 'g') AS safe, regexp_matches(lower(body), '{_CLAIMS}') AS forbidden FROM evidence")
def sc20(spark: SparkSession, folder: str) -> DataFrame:
    safe = F.regexp_replace(F.regexp_replace("title", "[<>]", ""), r"\p{Cntrl}", " ")
    return table(spark, folder, "evidence").select("evidence_uid", safe.alias("safe"), F.lower("body").rlike(_CLAIMS).alias("forbidden"))


@query("vec08_lexical_match", with_("d AS (SELECT document_uid, arg_min(title || ' ' || body, (first_seen_at, evidence_uid)) AS t FROM evidence GROUP BY document_uid)", f"p AS (SELECT match_uid, list_distinct(list_transform(market_terms, lambda x: lower(x))) AS w, {_terms_sql('t')} AS g FROM (SELECT DISTINCT match_uid, market_terms, document_uid FROM match_results) JOIN d USING (document_uid))") + "SELECT match_uid, len(list_intersect(w, g)) AS overlap, round(len(list_intersect(w, g)) / nullif(len(w), 0), 6) AS ratio, len(w) > 0 AND len(list_intersect(w, g)) >= least(2, len(w)) AND len(list_intersect(w, g)) / nullif(len(w), 0) >= 0.25 AS matched FROM p")
def vec08(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a document are taken once per document and joined to its candidates."""
    text = F.concat_ws(" ", "title", "body")
    docs = table(spark, folder, "evidence").groupBy("document_uid").agg(F.min_by(text, F.struct("first_seen_at", "evidence_uid")).alias("t")).select("document_uid", terms(F.col("t")).alias("g"))
    asked = table(spark, folder, "match_results").select("match_uid", "document_uid", "market_terms").distinct()
    pairs = asked.join(docs, "document_uid").withColumn("w", F.array_distinct(F.transform("market_terms", F.lower)))
    return lexical_match(pairs, "w", "g").select("match_uid", F.col("overlap").cast("long").alias("overlap"), r6("ratio"), "matched")


_EXPL = with_(
    "mt AS (SELECT market_uid, min(e.first_seen_at) AS seen_at, bool_or(e.backfill) AS ambiguous FROM (SELECT DISTINCT market_uid, document_uid FROM match_results WHERE relevant) JOIN evidence e USING (document_uid) GROUP BY market_uid)",
    "cv AS (SELECT market_uid, count(*) >= 3 AS adequate FROM (SELECT DISTINCT market_uid, document_uid FROM match_results) GROUP BY market_uid)",
)


@query("cmp02_explanations", _EXPL + "SELECT market_uid, CASE WHEN seen_at <= closes_at AND NOT ambiguous THEN 'observed_pre_shock' WHEN seen_at IS NOT NULL THEN 'timing_ambiguous' WHEN adequate THEN 'no_match' ELSE 'unknown_coverage' END AS status, CASE WHEN abs(epoch_us(seen_at) - epoch_us(closes_at)) / 3600000000 <= 720 THEN round((epoch_us(seen_at) - epoch_us(closes_at)) / 3600000000, 6) END AS lead_hours FROM (SELECT market_uid, closes_at FROM markets) LEFT JOIN mt USING (market_uid) LEFT JOIN cv USING (market_uid)")
def cmp02(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "match_results")
    seen = table(spark, folder, "evidence").groupBy("document_uid").agg(F.min("first_seen_at").alias("seen_at"), F.bool_or("backfill").alias("ambiguous"))
    matches = results.filter("relevant").select("market_uid", "document_uid").distinct().join(seen, "document_uid")
    coverage = results.select("market_uid", "document_uid").distinct().groupBy("market_uid").agg((F.count(F.lit(1)) >= 3).alias("adequate"))
    shocks = table(spark, folder, "markets").select("market_uid", "closes_at")
    return explanation(shocks, matches, coverage, "closes_at", "market_uid").select("market_uid", "status", r6("lead_hours"))


@query("flt21_evidence_state", "SELECT market_uid, CASE WHEN coalesce(n, 0) = 0 THEN 'no_evidence' WHEN hits = 0 THEN 'context' ELSE 'attributed' END AS state FROM markets LEFT JOIN (SELECT market_uid, count(*) AS n, count(*) FILTER (relevant) AS hits FROM match_results GROUP BY market_uid) USING (market_uid)")
def flt21(spark: SparkSession, folder: str) -> DataFrame:
    per = table(spark, folder, "match_results").groupBy("market_uid").agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("hits"))
    return table(spark, folder, "markets").select("market_uid").join(small_side(per), "market_uid", "left").select("market_uid", evidence_state(F.col("hits"), F.col("n")).alias("state"))


@query("adp15_feed_ids", "SELECT entry_uid, CASE WHEN coalesce(source_document_id, '') <> '' THEN source_document_id WHEN coalesce(url, '') <> '' THEN url ELSE 'sha256:' || sha256(coalesce(title, '') || chr(10) || coalesce(body, '')) END AS item_id FROM parsed_entries")
def adp15(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))), 256))
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    return table(spark, folder, "parsed_entries").select("entry_uid", F.coalesce(filled("source_document_id"), filled("url"), digest).alias("item_id"))


@query("adp17_first_seen", "SELECT evidence_uid, epoch_us(CASE WHEN backfill THEN retrieved_at ELSE min(first_seen_at) OVER (PARTITION BY document_uid, revision_uid) END) AS first_seen FROM evidence")
def adp17(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest sight of a revision goes to its replays; a backfilled row was first seen when it was retrieved. The minimum
    is joined back, so that a much-replayed revision is not one task's window."""
    rows = table(spark, folder, "evidence").select("evidence_uid", "document_uid", "revision_uid", "backfill", "retrieved_at", "first_seen_at")
    first = rows.groupBy("document_uid", "revision_uid").agg(F.min("first_seen_at").alias("first"))
    return rows.join(first, ["document_uid", "revision_uid"]).select("evidence_uid", F.unix_micros(F.when(F.col("backfill"), F.col("retrieved_at")).otherwise(F.col("first"))).alias("first_seen"))


@query("ctr04_case_contract", "SELECT m.match_uid, list_sort(list_filter([CASE WHEN max(e.document_uid) IS NULL THEN 'reference_outside_ledger' END, CASE WHEN min(e.first_seen_at) > max(m.as_of) THEN 'late_evidence' END], lambda x: x IS NOT NULL)) AS reasons FROM (SELECT DISTINCT match_uid, document_uid, as_of FROM match_results) m LEFT JOIN evidence e USING (document_uid) GROUP BY m.match_uid")
def ctr04(spark: SparkSession, folder: str) -> DataFrame:
    ledger = table(spark, folder, "evidence").groupBy("document_uid").agg(F.min("first_seen_at").alias("first"), F.lit(True).alias("held"))
    rows = table(spark, folder, "match_results").select("match_uid", "document_uid", "as_of").distinct().join(ledger, "document_uid", "left")
    per = rows.groupBy("match_uid").agg(F.max("held").alias("held"), F.min("first").alias("first"), F.max("as_of").alias("as_of"))
    return per.select("match_uid", reasons({"reference_outside_ledger": F.col("held").isNull(), "late_evidence": F.col("first") > F.col("as_of")}).alias("reasons"))


# --- vectors ---------------------------------------------------------------------------------------------------------
@query("vec01_catalog", "SELECT label, count(*) AS records, count(DISTINCT vec_id) AS uids, min(len(embedding)) AS least_dimension, max(len(embedding)) AS largest_dimension FROM embeddings GROUP BY label")
def vec01(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size("embedding")
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("vec_id").alias("uids"), F.min(n).alias("least_dimension"), F.max(n).alias("largest_dimension"))


def _hits(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return cosine_search(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "vec_id", "embedding", k)


_COS = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS record_id, label, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS cosine FROM q, embeddings WHERE vec_id <> query_id), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, record_id) AS place FROM s QUALIFY place <= 10)"


@query("vec02_cosine_top_k", with_(_COS) + "SELECT query_id, record_id, place, round(cosine, 6) AS cosine FROM h")
def vec02(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("query_id", "record_id", F.col("place").cast("long").alias("place"), r6("cosine"))


@query("vec03_rerank", with_(_COS) + "SELECT query_id, record_id, round((0.55 * (cosine + 1) / 2 * 0.9 + 0.15 * CASE WHEN record_id % 2 = 0 THEN 1 ELSE 0.5 END + 0.15 * pow(2, -(record_id % 10) / 5.0) + 0.075 * CASE WHEN record_id % 3 = 0 THEN 1 ELSE 0 END + 0.075 * 0.8) / 1.0, 6) AS rerank FROM h")
def vec03(spark: SparkSession, folder: str) -> DataFrame:
    uid = F.col("record_id")
    entity, age = F.when(uid % 2 == 0, 1.0).otherwise(0.5), F.pow(F.lit(2.0), -(uid % 10) / 5.0)
    return rerank(_hits(spark, folder), F.lit(0.9), entity, age, F.when(uid % 3 == 0, 1.0).otherwise(0.0), F.lit(0.8)).select("query_id", "record_id", r6("rerank"))


@query("vec04_recall_at_k", with_(_COS, "l AS (SELECT h.query_id, max(CASE WHEN e.label = h.label THEN 1.0 ELSE 0 END) AS hit FROM h JOIN embeddings e ON e.vec_id = h.query_id GROUP BY h.query_id)") + "SELECT round(avg(hit), 6) AS recall, count(*) AS queries FROM l")
def vec04(spark: SparkSession, folder: str) -> DataFrame:
    """A hit if any of the ten retrieved records has the query's label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    hits = _hits(spark, folder).join(labels.withColumnsRenamed({"vec_id": "record_id", "label": "found"}), "record_id").join(labels.withColumnsRenamed({"vec_id": "query_id"}), "query_id")
    per = hits.groupBy("query_id").agg(F.max(F.when(F.col("found") == F.col("label"), 1.0).otherwise(0.0)).alias("hit"))
    return per.agg(r6(F.avg("hit"), "recall"), F.count(F.lit(1)).alias("queries"))


@query("vec05_safety", "SELECT DISTINCT m.match_uid, e.first_seen_at > m.as_of AS from_the_future, e.raw_artifact_uid IS NULL AS without_provenance FROM match_results m JOIN (SELECT document_uid, min(first_seen_at) AS first_seen_at, max(raw_artifact_uid) AS raw_artifact_uid FROM evidence GROUP BY document_uid) e USING (document_uid) WHERE e.first_seen_at > m.as_of OR e.raw_artifact_uid IS NULL")
def vec05(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "evidence").groupBy("document_uid").agg(F.min("first_seen_at").alias("first"), F.max("raw_artifact_uid").alias("raw"))
    rows = table(spark, folder, "match_results").select("match_uid", "document_uid", "as_of").distinct().join(first, "document_uid")
    return rows.filter((F.col("first") > F.col("as_of")) | F.col("raw").isNull()).select("match_uid", (F.col("first") > F.col("as_of")).alias("from_the_future"), F.col("raw").isNull().alias("without_provenance")).distinct()
