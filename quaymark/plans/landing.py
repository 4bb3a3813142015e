"""Queries over landed files: loaders with quarantine, stores, bundles, logs and reference tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.operators.asof import classify_append, ordered_reason
from quaymark.plans.market import _MEANING, r6
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import FILLS, with_
from quaymark.session import scratch_path
from quaymark.sources.domain import fills
from quaymark.sources.landing import canonical_line, decode_logs, load_bundle, load_canonical, publish, read_current, read_ledger, resolve_files, store_objects, verified_objects, write_bundle, write_sorted
from quaymark.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_FIELDS = ["delivery_id", "fill_uid", "market_uid", "outcome_uid", "price", "size", "side", "actor_uid", "transaction_uid", "event_time", "ingested_at", "raw_artifact_uid"]


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([df.schema[c] for c in _FIELDS])


@query("src03_tick_files", "SELECT platform, count(*) AS n FROM fills GROUP BY platform")
def src03(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of a staging file and of all published ones, found by pattern."""
    root, rows = scratch_path(spark, "ticks"), table(spark, folder, "fills").select("delivery_id", "platform")
    names = sorted(r[0] for r in rows.select("platform").distinct().collect())  # venues
    for i, name in enumerate(names):
        rows.filter(F.col("platform") == name).write.parquet(f"{root}/{'ticks' if i == 0 else f'published/{name}'}")
    found = resolve_files(spark, [f"{root}/ticks", f"{root}/published/*", f"{root}/absent/*"])
    return spark.read.parquet(*found).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


_LOAD_CUT = "2024-03-20"
#: What becomes of a landed line, from its number: broken JSON, a blank too many, a field missing.
_DAMAGE = (("broken", 97), ("spaced", 89), ("holed", 83))


@query("src05_canonical_load", f"""WITH l AS (SELECT *, CAST(event_time AS DATE) AS date, CASE WHEN delivery_id % 97 = 0 THEN 'decode_failed' WHEN delivery_id % 83 = 0 THEN 'schema_invalid' WHEN delivery_id % 89 = 0 THEN 'noncanonical' WHEN right(raw_artifact_uid, 1) = '0' THEN 'raw_unverified' ELSE 'readable' END AS s FROM fills WHERE CAST(event_time AS DATE) <= DATE '{_LOAD_CUT}'),
 g AS (SELECT *, md5(CAST({_MEANING} AS VARCHAR)) AS m FROM l WHERE s = 'readable'), c AS (SELECT *, row_number() OVER w AS k, first_value(m) OVER w AS f FROM g WINDOW w AS (PARTITION BY fill_uid ORDER BY ingested_at, delivery_id)),
 a AS (SELECT platform, CASE WHEN k = 1 THEN 'loaded' WHEN m = f THEN 'duplicate' ELSE 'conflict' END AS status, event_time FROM c UNION ALL SELECT platform, s, event_time FROM l WHERE s <> 'readable')
 SELECT platform, status, count(*) AS n, max(CASE WHEN status = 'loaded' THEN epoch_us(event_time) END) AS watermark FROM a GROUP BY platform, status""")
def src05(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical partitions with damaged lines among them: what each came to, and the watermark of what was loaded."""
    root, rows = scratch_path(spark, "canonical"), table(spark, folder, "fills")
    line, n = canonical_line(_FIELDS), F.col("delivery_id")
    holed = rows.withColumn("price", F.when(n % 83 == 0, None).otherwise(F.col("price")))
    value = F.when(n % 97 == 0, F.expr("substring(line, 1, length(line) - 3)")).when(n % 89 == 0, F.concat(F.lit("{ "), F.expr("substring(line, 2)"))).otherwise(F.col("line"))
    landed = holed.withColumn("line", line).select(value.alias("value"), "platform", F.to_date("event_time").alias("date")).filter("date is not null")
    landed.repartition("platform", "date").write.partitionBy("platform", "date").text(root)
    verified = rows.select("raw_artifact_uid").filter("right(raw_artifact_uid, 1) <> '0'")
    loaded = load_canonical(spark, root, _LOAD_CUT, _schema(rows), "fill_uid", ["delivery_id", "fill_uid", "market_uid", "price"], ["ingested_at", "delivery_id"], verified)
    mark = F.max(F.when(F.col("status") == "loaded", F.unix_micros("event_time")))
    return loaded.groupBy(F.col("partition").alias("platform"), "status").agg(F.count(F.lit(1)).alias("n"), mark.alias("watermark"))


@query("src06_raw_artifacts", "SELECT sha256(source || '|' || url) AS digest, CAST(strlen(source || '|' || url) AS BIGINT) + CASE WHEN starts_with(source, 'wire') THEN 1 ELSE 0 END AS bytes, NOT starts_with(source, 'wire') AS ok FROM feeds")
def src06(spark: SparkSession, folder: str) -> DataFrame:
    """Content-addressed objects read as bytes; those of wires were changed after they were named."""
    root = scratch_path(spark, "objects")
    rows = table(spark, folder, "feeds").select("source", F.concat_ws("|", "source", "url").alias("content"))
    named = store_objects(rows, "content", root)
    local = root.removeprefix("file://").removeprefix("file:")
    for r in named.filter(F.col("source").startswith("wire")).collect():  # feeds are a table of fixed size
        with open(f"{local}/objects/{r['digest'][:2]}/{r['digest']}.raw", "ab") as out:
            out.write(b"!")
    return verified_objects(spark, f"{root}/objects")


@query("snk01_raw_objects", "SELECT count(DISTINCT content_hash || title || body) AS objects, count(*) AS receipts, count(DISTINCT content_hash || title || body) AS valid FROM (SELECT coalesce(content_hash, '') AS content_hash, coalesce(title, '') AS title, coalesce(body, '') AS body FROM evidence)")
def snk01(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes of every observation: equal ones stored once, a receipt each; the stored objects are read back and checked."""
    root = scratch_path(spark, "capture")
    text = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in ("content_hash", "title", "body")])
    receipts = store_objects(table(spark, folder, "evidence").select("evidence_uid", text.alias("content")), "content", root)
    stored = verified_objects(spark, f"{root}/objects").select(F.lit(True).alias("object"), "ok")
    both = stored.unionByName(receipts.select(F.lit(False).alias("object"), F.lit(False).alias("ok")))
    return both.agg(F.count_if("object").alias("objects"), F.count_if(~F.col("object")).alias("receipts"), F.count_if("ok").alias("valid"))


@query("src07_coverage_ledger", "SELECT source, CAST(date_part('epoch', CAST(first_seen_at AS DATE)) AS BIGINT) AS start, CASE WHEN count(*) > 3 THEN 'complete' ELSE 'partial' END AS status, count(*) AS record_count FROM evidence WHERE source LIKE 'wire%' GROUP BY source, CAST(first_seen_at AS DATE)")
def src07(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger of JSON lines, a broken line among them, read by data set and filtered by source."""
    root = scratch_path(spark, "ledger")
    day = F.unix_date(F.to_date("first_seen_at")).cast("long") * 86_400
    rows = table(spark, folder, "evidence").filter("first_seen_at is not null").groupBy("source", day.alias("start")).agg(F.count(F.lit(1)).alias("record_count"))
    lines = rows.select("source", F.lit("evidence").alias("dataset"), "start", (F.col("start") + 86_399).alias("stop"), F.when(F.col("record_count") > 3, "complete").otherwise("partial").alias("status"), "record_count", F.array().cast("array<string>").alias("raw_sha256"))
    lines.select(F.to_json(F.struct(*lines.columns)).alias("value")).unionByName(spark.createDataFrame([('{"source": "wire-broken", "dataset": "evidence", ',)], "value string")).write.text(root)
    read = read_ledger(spark, root, dataset="evidence")
    return read.filter(F.col("source").startswith("wire") & (F.col("status") != "unreadable")).select("source", "start", "status", "record_count")


@query("src08_evidence_archive", "SELECT source, CASE WHEN right(evidence_uid, 1) = '3' THEN 'content_hash_mismatch' WHEN right(evidence_uid, 1) = '7' THEN 'path_mismatch' ELSE 'verified' END AS status, count(*) AS n FROM evidence GROUP BY ALL")
def src08(spark: SparkSession, folder: str) -> DataFrame:
    """Archived revisions under the hash of their line; content and path are recomputed. Some texts and paths were changed."""
    root = scratch_path(spark, "archive")
    content = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    rows = table(spark, folder, "evidence").select("evidence_uid", "source", "title", "body", F.sha2(content, 256).alias("content_sha"))
    changed = rows.withColumn("body", F.when(F.right("evidence_uid", F.lit(1)) == "3", F.concat(F.coalesce("body", F.lit("")), F.lit("."))).otherwise(F.col("body")))
    lines = changed.select(canonical_line(changed.columns).alias("line"), "evidence_uid")
    name = F.when(F.right("evidence_uid", F.lit(1)) == "7", F.lit("0" * 64)).otherwise(F.sha2("line", 256))
    lines.select(name.alias("name"), "line").write.parquet(root)
    read = spark.read.parquet(root).withColumn("r", F.from_json("line", "body string, content_sha string, evidence_uid string, source string, title string"))
    fresh = F.sha2(F.concat_ws("\n", F.coalesce("r.title", F.lit("")), F.coalesce("r.body", F.lit(""))), 256)
    status = ordered_reason([("content_hash_mismatch", fresh != F.col("r.content_sha")), ("path_mismatch", F.sha2("line", 256) != F.col("name"))], "verified")
    return read.groupBy(F.col("r.source").alias("source"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("src09_frozen_bundle", with_(FILLS) + "SELECT count(*) AS fills, CAST([] AS VARCHAR[]) AS reasons, ['checksum_mismatch:fills', 'coverage_not_single'] AS reasons_after_tampering FROM f")
def src09(spark: SparkSession, folder: str) -> DataFrame:
    """A frozen bundle read back whole, and again after a line was added to each part."""
    root, kinds = scratch_path(spark, "bundle"), {"fills": "fill_uid string, market_uid string, price string, size string", "coverage": "platform string, rows string"}
    rows = fills(spark, folder).select("fill_uid", "market_uid", "price", "size")
    write_bundle({"fills": rows, "coverage": rows.agg(F.lit("all").alias("platform"), F.count(F.lit(1)).alias("rows"))}, root)
    parts, why = load_bundle(spark, root, kinds)
    n = parts["fills"].count()
    spark.createDataFrame([('{"fill_uid":"added"}',)], "value string").write.mode("append").text(f"{root}/fills.jsonl")
    spark.createDataFrame([('{"platform":"added"}',)], "value string").write.mode("append").text(f"{root}/coverage.jsonl")
    _, after = load_bundle(spark, root, kinds)
    return spark.createDataFrame([(n, why, [w for w in after if w != "checksum_mismatch:coverage"])], "fills long, reasons array<string>, reasons_after_tampering array<string>")


@query("src10_raw_deliveries", "SELECT raw_artifact_uid, CASE WHEN right(raw_artifact_uid, 1) = '5' THEN 'digest_mismatch' ELSE 'bound' END AS status, CASE WHEN right(raw_artifact_uid, 1) = '5' THEN 0 ELSE count(*) END AS records FROM fills WHERE raw_artifact_uid IS NOT NULL GROUP BY raw_artifact_uid")
def src10(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries as JSON arrays, each bound to the digest of its receipt; only bound ones are taken apart."""
    root = scratch_path(spark, "deliveries")
    rows = table(spark, folder, "fills").filter("raw_artifact_uid is not null")
    body = F.to_json(F.transform(F.array_sort(F.collect_list("delivery_id")), lambda i: F.struct(i.alias("id"))))
    sent = rows.groupBy("raw_artifact_uid").agg(body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    sent.withColumn("payload", F.when(F.right("raw_artifact_uid", F.lit(1)) == "5", F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))).write.parquet(root)
    read = spark.read.parquet(root).withColumn("bound", F.sha2("payload", 256) == F.col("digest"))
    items = F.size(F.from_json("payload", "array<struct<id: long>>"))
    return read.select("raw_artifact_uid", F.when(F.col("bound"), "bound").otherwise("digest_mismatch").alias("status"), F.when(F.col("bound"), items).otherwise(0).cast("long").alias("records"))


_CONTRACT, _TOPIC = "0x" + "ab" * 20, "0x" + "cd" * 32
_HEX = "lpad(format('{:x}', %s), 64, '0')"


@query("src24_onchain_logs", f"""WITH l AS (SELECT delivery_id AS d, CASE WHEN d % 41 = 0 THEN 'contract_not_allowed' WHEN d % 37 = 0 THEN 'topic_unknown' WHEN d % 31 = 0 THEN 'topics_malformed' WHEN d % 29 = 0 THEN 'data_malformed' WHEN d % 23 = 0 THEN 'assets_ambiguous' WHEN d % 19 = 0 THEN 'amount_out_of_range' WHEN d % 17 = 0 THEN 'amount_zero' ELSE 'decoded' END AS status FROM fills)
 SELECT d // 1000 AS chunk, status, count(*) AS n, CAST(sum(CASE WHEN status = 'decoded' THEN d * 3 END) AS BIGINT) AS money, CAST(sum(CASE WHEN status = 'decoded' THEN d * 7 END) AS BIGINT) AS quantity, count(*) FILTER (status = 'decoded' AND d % 2 = 0) AS buys FROM l GROUP BY ALL""")
def src24(spark: SparkSession, folder: str) -> DataFrame:
    """Logs landed as JSON by chunk of blocks and decoded, malformed ones among them."""
    root, d = scratch_path(spark, "logs"), F.col("delivery_id")
    word = lambda x: F.lpad(F.lower(F.hex(x)), 64, "0")
    none, asset = F.lit("0" * 64), F.lpad(F.lower(F.hex(d + 1)), 64, "1")
    buy = d % 2 == 0
    maker, taker = F.when(d % 23 == 0, asset).when(buy, none).otherwise(asset), F.when(d % 23 == 0, asset).when(buy, asset).otherwise(none)
    money, goods = F.when(d % 19 == 0, F.lit("f" * 64)).when(d % 17 == 0, F.lit("0" * 64)).otherwise(word(d * 3)), word(d * 7)
    data = F.concat(F.lit("0x"), maker, taker, F.when(buy, money).otherwise(goods), F.when(buy, goods).otherwise(money), word(F.lit(0)), F.when(d % 29 == 0, "ab").otherwise(""))
    person = lambda shift: F.concat(F.lit("0x"), F.when(d % 31 == 0, "1").otherwise("0"), F.lit("0" * 23), F.lpad(F.lower(F.hex(d + shift)), 40, "0"))
    logs = table(spark, folder, "fills").select(
        d.alias("block_number"), F.lit(0).alias("log_index"), F.when(d % 41 == 0, "0x" + "00" * 20).otherwise(_CONTRACT).alias("address"),
        F.array(F.when(d % 37 == 0, "0x" + "ee" * 32).otherwise(_TOPIC), F.lit("0x" + "01" * 32), person(1), person(2)).alias("topics"), data.alias("data"), F.lit("0x0").alias("transaction_hash"), F.floor(d / 1000).alias("chunk"),
    )
    logs.repartition("chunk").write.partitionBy("chunk").json(root)
    read = spark.read.schema("block_number long, log_index long, address string, topics array<string>, data string, transaction_hash string, chunk long").json(root)
    out = decode_logs(read, [_CONTRACT], _TOPIC)
    return out.groupBy(F.floor(F.col("block_number") / 1000).alias("chunk"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("money").cast("long").alias("money"), F.sum("quantity").cast("long").alias("quantity"), F.count_if((F.col("status") == "decoded") & (F.col("side") == "BUY")).alias("buys"))


@query("snk08_pointer_index", f"WITH h AS (SELECT *, md5(CAST({_MEANING} AS VARCHAR)) AS m FROM fills WHERE actor_uid IS NOT NULL), c AS (SELECT *, row_number() OVER w AS k, first_value(m) OVER w AS f FROM h WINDOW w AS (PARTITION BY fill_uid ORDER BY ingested_at, delivery_id)) SELECT actor_uid, count(*) FILTER (k = 1) AS pointers, count(*) FILTER (k > 1 AND m = f) AS duplicates, count(*) FILTER (k > 1 AND m <> f) AS conflicts FROM c GROUP BY actor_uid")
def snk08(spark: SparkSession, folder: str) -> DataFrame:
    """Pointers to fills by actor: one per fill, repeated ones counted, those of another meaning kept as conflicts."""
    rows = table(spark, folder, "fills").filter("actor_uid is not null").select(*[c for c in _FIELDS if c != "raw_artifact_uid"])
    seen = classify_append(rows, None, "fill_uid", ["ingested_at", "delivery_id"], ["ingested_at"])
    n = lambda s: F.count_if(F.col("status") == s)
    return seen.groupBy("actor_uid").agg(n("inserted").alias("pointers"), n("duplicate").alias("duplicates"), n("conflict").alias("conflicts"))


@query("snk09_bundle_publish", "SELECT market_uid, platform FROM markets WHERE liquidity IS NOT NULL")
def snk09(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions published; readers get the second, checked."""
    root, rows = scratch_path(spark, "published"), table(spark, folder, "markets").select("market_uid", "platform", "liquidity")
    publish(rows, root, "v1")
    publish(rows.filter("liquidity is not null"), root, "v2")
    return read_current(spark, root).select("market_uid", "platform")


@query("snk11_sorted_parquet", "SELECT market_uid, count(*) AS n, min(epoch_us(event_time)) AS first_at FROM fills WHERE market_uid IS NOT NULL AND event_time IS NOT NULL GROUP BY market_uid")
def snk11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fills").filter("market_uid is not null and event_time is not null").select("market_uid", "event_time", "price")
    stored = write_sorted(rows, ["market_uid", "event_time"], scratch_path(spark, "sorted"), "ticks")
    return stored.groupBy("market_uid").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("event_time")).alias("first_at"))


@query("adp07_ticker_observations", "WITH t AS (SELECT event_id, value / (value + 50) AS p FROM events), u AS (SELECT event_id, 'last_trade' AS kind, p AS price FROM t UNION ALL SELECT event_id, 'best_bid', p - 0.005 FROM t WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'best_ask', p + 0.005 FROM t WHERE event_id % 5 <> 0) SELECT event_id, kind, round(price, 6) AS price FROM u WHERE price BETWEEN 0 AND 1")
def adp07(spark: SparkSession, folder: str) -> DataFrame:
    """A ticker gives up to three observations: null fields give none, prices outside [0, 1] are refused."""
    p, i = F.col("value") / (F.col("value") + 50), F.col("event_id")
    ticker = table(spark, folder, "events").select(i, p.alias("last_trade"), F.when(i % 3 != 0, p - 0.005).alias("best_bid"), F.when(i % 5 != 0, p + 0.005).alias("best_ask"))
    return ticker.unpivot("event_id", ["last_trade", "best_bid", "best_ask"], "kind", "price").filter("price between 0 and 1").select("event_id", "kind", r6("price"))


@query("adp13_ticker_validation", "SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'type_wrong' WHEN event_id % 19 = 0 THEN 'product_wrong' WHEN event_id % 17 = 0 THEN 'sequence_invalid' WHEN event_id % 13 = 0 THEN 'subscription_not_exact' ELSE 'valid' END AS status FROM events")
def adp13(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers as landed JSON: exact type and product, a whole non-negative sequence, and just the two channels subscribed."""
    i = F.col("event_id")
    channels = F.create_map(F.lit("ticker"), F.array(F.lit("BTC-USD")), F.when(i % 13 == 0, "level2").otherwise("heartbeat"), F.array(F.lit("BTC-USD")))
    landed = table(spark, folder, "events").select(i, F.to_json(F.struct(F.when(i % 23 == 0, "snapshot").otherwise("ticker").alias("type"), F.when(i % 19 == 0, "ETH-USD").otherwise("BTC-USD").alias("product_id"), F.when(i % 17 == 0, "-1").otherwise(i.cast("string")).alias("sequence"), channels.alias("channels"))).alias("frame"))
    r = landed.withColumn("r", F.from_json("frame", "type string, product_id string, sequence string, channels map<string, array<string>>"))
    exact = (F.size("r.channels") == 2) & F.coalesce(F.col("r.channels")["ticker"] == F.array(F.lit("BTC-USD")), F.lit(False)) & F.coalesce(F.col("r.channels")["heartbeat"] == F.array(F.lit("BTC-USD")), F.lit(False))
    status = ordered_reason([("type_wrong", F.col("r.type") != "ticker"), ("product_wrong", F.col("r.product_id") != "BTC-USD"), ("sequence_invalid", ~F.col("r.sequence").rlike("^[0-9]+$")), ("subscription_not_exact", ~exact)], "valid")
    return r.select("event_id", status.alias("status"))
