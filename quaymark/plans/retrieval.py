"""Queries over paths, bounded prefixes, property graphs, retrieval under filters, and landed feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import evm_addresses
from quaymark.operators.dedup import first_of_either
from quaymark.operators.evidence import cosine_search
from quaymark.operators.graph import claim_chains, merged_properties, neighbourhood, simple_paths
from quaymark.plans.evaluation import _MENU
from quaymark.plans.market import r6
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import FILLS, with_
from quaymark.session import scratch_path, small_side
from quaymark.sources.domain import fills
from quaymark.sources.landing import publish, read_current
from quaymark.sources.tables import table
from quaymark.sources.wire import feed_entries

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --- graphs ----------------------------------------------------------------------------------------------------------
_PATHS = """bo AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ln UNION ALL SELECT dst, src FROM ln)), dg AS (SELECT id, greatest(count(*) - 10, 0) AS ex FROM (SELECT src AS id FROM (SELECT DISTINCT * FROM ln) UNION ALL SELECT dst FROM (SELECT DISTINCT * FROM ln)) GROUP BY id), st AS (SELECT DISTINCT market_uid AS id FROM markets WHERE event_uid IS NOT NULL AND live_event), tg AS (SELECT DISTINCT market_uid AS id FROM markets WHERE event_uid IS NOT NULL AND NOT live_event),
 p AS (SELECT id AS s, [id] AS nodes, id AS e, 0 AS length, 0 AS penalty, false AS hit FROM st UNION ALL SELECT s, list_append(nodes, dst), dst, length + 1, penalty + CASE WHEN length = 0 THEN 0 ELSE dg.ex END, dst IN (SELECT id FROM tg) FROM p JOIN bo ON src = e JOIN dg ON dg.id = e WHERE NOT hit AND length < 4 AND NOT list_contains(nodes, dst))"""
_LINKS = "ln AS (SELECT market_uid AS src, event_uid AS dst FROM markets WHERE event_uid IS NOT NULL UNION ALL SELECT event_uid, category FROM markets WHERE event_uid IS NOT NULL AND category IS NOT NULL)"


@query("gr03_simple_paths", f"WITH RECURSIVE {_LINKS}, {_PATHS} SELECT s AS start, e AS target, length, round(1 / (length + 0.1 * penalty), 6) AS score FROM p WHERE hit QUALIFY row_number() OVER (PARTITION BY s, e ORDER BY length, nodes) <= 50")
def gr03(spark: SparkSession, folder: str) -> DataFrame:
    """From live markets to others over shared events and their categories, at most four hops."""
    rows = table(spark, folder, "markets").filter("event_uid is not null")
    links = rows.select(F.col("market_uid").alias("src"), F.col("event_uid").alias("dst")).unionByName(rows.filter("category is not null").select(F.col("event_uid").alias("src"), F.col("category").alias("dst")))
    pick = lambda live: rows.filter(F.col("live_event") == live).select(F.col("market_uid").alias("id")).distinct()
    return simple_paths(links, pick(True), pick(False), depth=4).select("start", "target", "length", r6("score"))


_CHAIN = """cl AS (SELECT DISTINCT market_uid AS src, category AS dst, 'controller' AS kind, 0.9 AS confidence, 0.85 AS band, 1.0 AS recency, platform AS source FROM markets WHERE category IS NOT NULL UNION ALL SELECT DISTINCT category, split_part(category, '/', 1), 'role', 0.8, 1.0, 0.5, 'taxonomy' FROM markets WHERE category IS NOT NULL UNION ALL SELECT DISTINCT split_part(category, '/', 1), 'root', 'access', 0.5, 0.6, 0.75, 'taxonomy' FROM markets WHERE category IS NOT NULL),
 dg AS (SELECT id, greatest(count(*) - 10, 0) AS ex FROM (SELECT src AS id FROM cl UNION ALL SELECT dst FROM cl) GROUP BY id)"""


@query("gr04_claim_chains", with_(_CHAIN) + "SELECT a.src AS n0, c.dst AS n3, len(list_distinct([a.source, b.source, c.source])) AS sources, len(list_distinct([a.source, b.source, c.source])) >= 2 AS accepted, CASE WHEN len(list_distinct([a.source, b.source, c.source])) >= 2 THEN round(least(1, exp((ln(a.confidence * a.band * a.recency) + ln(b.confidence * b.band * b.recency) + ln(c.confidence * c.band * c.recency)) / 3) * least(1, len(list_distinct([a.source, b.source, c.source])) / 2) / (1 + 0.1 * (x.ex + y.ex))), 6) ELSE 0 END AS score FROM cl a JOIN cl b ON a.dst = b.src AND b.kind = 'role' JOIN cl c ON b.dst = c.src AND c.kind = 'access' JOIN dg x ON x.id = a.dst JOIN dg y ON y.id = b.dst WHERE a.kind = 'controller'")
def gr04(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of three claims: geometric mean of confidence, band and recency, with diversity of sources and hubs in the score."""
    rows = table(spark, folder, "markets").filter("category is not null")
    topic = F.split_part("category", F.lit("/"), F.lit(1))
    claim = lambda src, dst, kind, weights, source: rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), *[F.lit(w).alias(n) for n, w in zip(("confidence", "band", "recency"), weights)], source.alias("source")).distinct()
    claims = claim(F.col("market_uid"), F.col("category"), "controller", (0.9, 0.85, 1.0), F.col("platform")).unionByName(claim(F.col("category"), topic, "role", (0.8, 1.0, 0.5), F.lit("taxonomy"))).unionByName(claim(topic, F.lit("root"), "access", (0.5, 0.6, 0.75), F.lit("taxonomy")))
    return claim_chains(claims).select("n0", "n3", "sources", "accepted", r6("score"))


_PROPS = "pr AS (SELECT document_uid AS id, unnest([{'k': 'title', 'v': title}, {'k': 'url', 'v': nullif(url, '')}, {'k': 'source', 'v': source}]) AS x, first_seen_at AS t, evidence_uid AS u FROM evidence)"


@query("gr01_node_upsert", with_(_PROPS) + "SELECT id, x.k AS name, arg_max(x.v, (t, u)) AS value FROM pr WHERE x.v IS NOT NULL GROUP BY ALL")
def gr01(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes merged property by property: of each the last known value stays, and a null overwrites nothing."""
    props = F.create_map(F.lit("title"), F.col("title"), F.lit("url"), F.nullif(F.col("url"), F.lit("")), F.lit("source"), F.col("source"))
    merged = merged_properties(table(spark, folder, "evidence").select(F.col("document_uid").alias("id"), props.alias("props"), "first_seen_at", "evidence_uid"), ["first_seen_at", "evidence_uid"])
    return merged.select("id", F.explode("props").alias("name", "value"))


@query("prs02_neighbourhood", with_(_MENU, "s AS (SELECT market_uid AS id FROM markets WHERE live_event), k AS (SELECT DISTINCT dst FROM mk WHERE src IN (SELECT id FROM s))") + "SELECT DISTINCT src, dst FROM mk WHERE dst IN (SELECT dst FROM k)")
def prs02(spark: SparkSession, folder: str) -> DataFrame:
    """All edges within two frontiers of the live markets."""
    links = table(spark, folder, "markets").filter("event_uid is not null").select(F.col("market_uid").alias("src"), F.col("event_uid").alias("dst"))
    seeds = table(spark, folder, "markets").filter("live_event").select(F.col("market_uid").alias("id"))
    return neighbourhood(links, seeds)


# --- prefixes, queues, snapshots -------------------------------------------------------------------------------------
@query("top10_bounded_prefix", "SELECT delivery_id, market_uid, row_number() OVER (PARTITION BY market_uid ORDER BY ingested_at, delivery_id) <= 50 AS admitted FROM fills")
def top10(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty arrivals of each market are admitted, and a receipt is kept of all that are over the limit. The prefix
    is cut before the shuffle, so no task sorts a market."""
    rows = table(spark, folder, "fills").select("delivery_id", "market_uid", "ingested_at")
    place = F.row_number().over(Window.partitionBy("market_uid").orderBy(F.col("ingested_at").asc_nulls_last(), "delivery_id"))
    first = rows.withColumn("place", place).filter("place <= 50").select(F.col("delivery_id").alias("d"), F.lit(True).alias("in"))
    return rows.join(small_side(first), F.col("delivery_id") == F.col("d"), "left").select("delivery_id", "market_uid", F.coalesce("in", F.lit(False)).alias("admitted"))


@query("top07_due_watches", with_(FILLS) + "SELECT actor_uid, epoch_us(last + INTERVAL 1 DAY) AS due_at FROM (SELECT actor_uid, max(event_time) AS last FROM f WHERE actor_uid IS NOT NULL GROUP BY actor_uid) WHERE last + INTERVAL 1 DAY <= TIMESTAMP '2024-03-20'")
def top07(spark: SparkSession, folder: str) -> DataFrame:
    """Watches due by the cut-off, in order of when, then of actor."""
    last = fills(spark, folder).filter("actor_uid is not null").groupBy("actor_uid").agg(F.max("event_time").alias("last"))
    due = last.select("actor_uid", (F.unix_micros("last") + 86_400_000_000).alias("due_at"))
    return due.filter(F.col("due_at") <= F.unix_micros(F.lit("2024-03-20").cast("timestamp"))).orderBy("due_at", "actor_uid")


@query("snk07_snapshot_digest", "SELECT (SELECT count(DISTINCT fill_uid) FROM fills) AS rows, (SELECT count(*) FROM (SELECT fill_uid FROM fills GROUP BY fill_uid HAVING count(DISTINCT (price, size, market_uid)) > 1)) AS conflicts, true AS verified, true AS tampering_noticed")
def snk07(spark: SparkSession, folder: str) -> DataFrame:
    """A sealed snapshot of one fill per uid with its conflicts counted; read back and verified, then changed and refused."""
    root, rows = scratch_path(spark, "snapshot"), fills(spark, folder).select("fill_uid", "market_uid", "price", "size")
    meaning = F.struct("price", "size", "market_uid")
    conflicts = table(spark, folder, "fills").groupBy("fill_uid").agg((F.min(meaning) != F.max(meaning)).alias("c")).filter("c")
    publish(rows, root, "sealed")
    n = read_current(spark, root).count()
    rows.limit(1).write.mode("append").parquet(f"{root}/versions/sealed")
    try:
        read_current(spark, root)
        noticed = False
    except ValueError:
        noticed = True
    return conflicts.agg(F.lit(n).alias("rows"), F.count(F.lit(1)).alias("conflicts"), F.lit(True).alias("verified"), F.lit(noticed).alias("tampering_noticed"))


@query("sc19_evm_addresses", "SELECT delivery_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(concat_ws(' ', actor_uid, maker.actor_uid, taker.actor_uid, transaction_uid)), '0x[0-9a-f]{40}(?:[^0-9a-f]|$)'), lambda x: x[1:42]))) AS found FROM fills")
def sc19(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses anywhere in a fill's nested record; longer hex words are none."""
    rows = table(spark, folder, "fills").select("delivery_id", F.to_json(F.struct("actor_uid", "maker", "taker", "transaction_uid")).alias("record"))
    return rows.select("delivery_id", evm_addresses(F.col("record")).alias("found"))


# --- retrieval -------------------------------------------------------------------------------------------------------
_ELIGIBLE = "vec_id % 7 <= 4 AND vec_id % 30 BETWEEN 2 AND 27 AND label IN (0, 1, 2, 3) AND vec_id % 50 <> 13 AND (vec_id % 3 = 1 OR vec_id % 5 = 2)"


@query("flt13_eligible_search", with_("q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0)", f"s AS (SELECT query_id, vec_id AS record_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS cosine FROM q, embeddings e WHERE vec_id <> query_id AND {_ELIGIBLE})") + "SELECT query_id, record_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, record_id) <= 5")
def flt13(spark: SparkSession, folder: str) -> DataFrame:
    """Records are filtered by availability, event range, coverage, exclusion and any of two entities before similarity."""
    i = F.col("vec_id")
    rows = table(spark, folder, "embeddings").withColumns({"available": i % 7, "happened": i % 30, "entities": F.array(i % 3, i % 5 + 10)})
    wanted = F.array(F.lit(1).cast("long"), F.lit(12).cast("long"))
    eligible = rows.filter((F.col("available") <= 4) & F.col("happened").between(2, 27) & F.col("label").isin(0, 1, 2, 3) & (i % 50 != 13) & F.arrays_overlap("entities", wanted))
    return cosine_search(rows.filter("vec_id % 100 = 0"), eligible, "vec_id", "vec_id", "embedding", 5).select("query_id", "record_id")


@query("vec06_news_lead", "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS record_id, list_distance(q, CAST(embedding AS DOUBLE[])) AS distance FROM q, embeddings WHERE vec_id <> query_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS place FROM s QUALIFY place <= 5), c AS (SELECT *, (record_id % 1500) - (query_id % 1500) AS lead FROM t) SELECT query_id, record_id, round(distance, 6) AS distance, CASE WHEN abs(lead) <= 720 THEN round((1 + query_id % 9) * lead / 10.0, 6) ELSE 0 END AS ppim FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY abs(lead) > 720, place) = 1")
def vec06(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest records of each query by distance, of these the best with a valid lead (of at most 720 hours), and its
    magnitude times lead; zero where no lead is valid."""
    rows = table(spark, folder, "embeddings")
    near = cosine_search(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "vec_id", "embedding", 5, metric="distance")
    lead = F.col("record_id") % 1500 - F.col("query_id") % 1500
    best = near.withColumn("lead", lead).withColumn("valid", F.abs("lead") <= 720).groupBy("query_id").agg(F.min_by(F.struct("record_id", "distance", "lead", "valid"), F.struct(~F.col("valid"), "place")).alias("b"))
    return best.select("query_id", "b.record_id", r6("b.distance", "distance"), F.when(F.col("b.valid"), F.round((1 + F.col("query_id") % 9) * F.col("b.lead") / 10.0, 6)).otherwise(0.0).alias("ppim"))


@query("vec09_chunks")
def vec09(spark: SparkSession, folder: str) -> DataFrame:
    """Dated chunks with text, in order of retrieval; one is dropped if a kept one has its URL or its text."""
    rows = table(spark, folder, "parsed_entries").filter((F.coalesce("body", F.lit("")) != "") & F.col("retrieved_at").isNotNull())
    keyed = rows.select("entry_uid", "retrieved_at", F.nullif(F.col("url"), F.lit("")).alias("url"), F.md5("body").alias("text"))
    return first_of_either(keyed, ["url", "text"], ["retrieved_at", "entry_uid"]).select("entry_uid")


@query("src21_feed_documents", "SELECT entry_uid, source, coalesce(nullif(source_document_id, ''), nullif(url, '')) AS document_id FROM parsed_entries WHERE coalesce(nullif(source_document_id, ''), nullif(url, '')) IS NOT NULL")
def src21(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds landed as RSS and Atom pages of fifty entries, taken apart by Spark's XML reader: the entry's own id, else its link."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\p{Cntrl}", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = table(spark, folder, "parsed_entries").withColumns({c: escaped(c) for c in ("entry_uid", "source_document_id", "url")})
    atom = F.col("source").endswith("i") | F.col("source").endswith("l")
    item = F.when(atom, F.format_string('<entry><id>%s</id><link href="%s"/><key>%s</key></entry>', "source_document_id", "url", "entry_uid")).otherwise(F.format_string("<item><guid>%s</guid><link>%s</link><key>%s</key></item>", "source_document_id", "url", "entry_uid"))
    pages = rows.groupBy("source", atom.alias("atom"), F.pmod(F.xxhash64("entry_uid"), F.lit(64)).alias("page")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    xml = pages.select("source", F.when(F.col("atom"), "atom").otherwise("rss").alias("format"), F.when(F.col("atom"), F.concat(F.lit("<feed>"), "items", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>"))).alias("xml"))
    return feed_entries(xml).select(F.col("key").alias("entry_uid"), "source", "document_id")
