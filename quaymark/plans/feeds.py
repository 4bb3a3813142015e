"""Queries over venue frames, ledgers, streams and source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.scalars import abi_word, topic_address
from quaymark.operators.ledger import chain, current_labels, registry_violations, verify
from quaymark.plans.market import r6
from quaymark.plans.registry import Registry
from quaymark.plans.relations_sql import with_
from quaymark.sources.inventory import missing_references, python_facts, scenarios, tree
from quaymark.session import scratch_path
from quaymark.sources.tables import table
from quaymark.sources.wire import final_candles, frames, rest_trades, same_pairs
from quaymark.streaming.sequences import run_once, run_updates, sequence_states, split_late, stream_table, without_redeliveries

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def landed_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Fills as a venue sends them: JSON whose numbers are text."""
    body = F.to_json(F.struct(F.col("market_uid").alias("market"), F.col("outcome_uid").alias("outcome"), "side", _text("price").alias("price"), _text("size").alias("size"), _text(F.unix_millis("event_time")).alias("ts_ms"), F.upper("actor_uid").alias("wallet"), F.col("transaction_uid").alias("tx")))
    return table(spark, folder, "fills").select("delivery_id", "ingested_at", body.alias("body"))


@query("adp01_rest_trades", "SELECT delivery_id, upper(side) AS side, round(CAST(price AS DOUBLE), 6) AS price, round(CAST(size AS DOUBLE), 6) AS size, CASE WHEN event_time IS NULL THEN epoch_us(ingested_at) ELSE epoch_us(event_time) // 1000 * 1000 END AS event_us, CASE WHEN event_time IS NULL THEN 'receipt' ELSE 'ts_ms' END AS time_source, lower(actor_uid) AS actor_uid, NULL::VARCHAR AS reason FROM fills")
def adp01(spark: SparkSession, folder: str) -> DataFrame:
    df = rest_trades(landed_trades(spark, folder), "body", "ingested_at")
    return df.select("delivery_id", "side", r6(F.col("price").cast("double"), "price"), r6(F.col("size").cast("double"), "size"), "event_us", "time_source", "actor_uid", "reason")


@query("adp01b_fill_identity", "SELECT count(*) AS rows, count(DISTINCT (market_uid, outcome_uid, upper(side), price, size, epoch_ms(coalesce(event_time, ingested_at)), CASE WHEN event_time IS NULL THEN epoch_us(ingested_at) % 1000 END, upper(actor_uid), transaction_uid)) AS identities FROM fills")
def adp01b(spark: SparkSession, folder: str) -> DataFrame:
    per = rest_trades(landed_trades(spark, folder), "body", "ingested_at").groupBy("fill_uid").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("identities"))


@query("adp02_trade_to_two_facts", "SELECT 'observation' AS fact, count(*) AS n FROM fills UNION ALL SELECT 'fill', count(*) FROM fills WHERE actor_uid IS NOT NULL")
def adp02(spark: SparkSession, folder: str) -> DataFrame:
    """Every trade is an observation, and a fill only where its taker is stated."""
    both = F.array_compact(F.array(F.lit("observation"), F.when(F.col("actor_uid").isNotNull(), "fill")))
    return table(spark, folder, "fills").select(F.explode(both).alias("fact")).groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


def landed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Five kinds of frames from events, with text numbers."""
    price = F.format_number(F.col("value") / (F.col("value") + 50), 4)
    text = lambda c: c.cast("string")
    n = F.col("event_id") % 5
    levels = F.array(*[F.struct(text(F.format_number(F.lit(d), 2)).alias("price"), text(F.col("event_id") % m + 1).alias("size")) for d, m in ((0.25, 7), (0.35, 5), (0.15, 3))])
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("book", "price_change", "last_trade_price", "best_bid_ask", "heartbeat")]), (n + 1).cast("int"))
    body = F.to_json(F.struct(
        kinds.alias("event_type"), F.col("event_type").alias("market"), F.col("event_id").alias("seq"), F.when(n == 2, price).alias("price"), F.when(n == 2, text(F.col("event_id") % 97 + 1)).alias("size"), F.when(n == 2, "sell").alias("side"), text(F.unix_seconds("ts")).alias("ts"),
        F.when(n == 0, levels).alias("bids"), F.when(n == 0, levels).alias("asks"), F.when(n == 1, F.array(F.struct(F.lit("bid").alias("side"), price.alias("price"), text(F.col("event_id") % 2).alias("size")))).alias("changes"), F.when(n == 3, price).alias("best_bid"), F.when((n == 3) & (F.col("event_id") % 2 == 0), price).alias("best_ask"),
    ))
    return table(spark, folder, "events").filter("value is not null").select("event_id", F.col("ts").alias("received"), body.alias("body"))


_P4 = "round(value / (value + 50), 4)"


@query("st06_frames", f"""WITH e AS (SELECT *, event_id % 5 AS n, {_P4} AS p FROM events WHERE value IS NOT NULL)
 SELECT event_id, 'level' AS fact, 'book' AS kind, s AS side, d AS price, CAST(event_id % m + 1 AS DOUBLE) AS size, CASE WHEN s = 'bid' THEN b ELSE 2 - b END AS rank FROM e, (VALUES (0.25, 7, 1), (0.35, 5, 0), (0.15, 3, 2)) l(d, m, b), (VALUES ('bid'), ('ask')) x(s) WHERE n = 0
 UNION ALL SELECT event_id, 'level', CASE WHEN event_id % 2 = 0 THEN 'level_removed' ELSE 'level_changed' END, 'bid', p, event_id % 2, 0 FROM e WHERE n = 1 UNION ALL SELECT event_id, 'observation', 'platform_snapshot', NULL, p, NULL, 0 FROM e WHERE n = 1
 UNION ALL SELECT event_id, 'fill', 'trade', 'SELL', p, event_id % 97 + 1, 0 FROM e WHERE n = 2 UNION ALL SELECT event_id, 'observation', 'last_trade', NULL, p, NULL, 0 FROM e WHERE n = 2
 UNION ALL SELECT event_id, 'observation', 'best_bid', NULL, p, NULL, 0 FROM e WHERE n = 3 UNION ALL SELECT event_id, 'observation', 'best_ask', NULL, p, NULL, 0 FROM e WHERE n = 3 AND event_id % 2 = 0
 UNION ALL SELECT event_id, 'unknown', 'heartbeat', NULL, NULL, NULL, 0 FROM e WHERE n = 4""")
def st06(spark: SparkSession, folder: str) -> DataFrame:
    df = frames(landed_frames(spark, folder), "body", "received")
    return df.select("event_id", "fact", "kind", "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), "rank")


@query("adp12_final_candles", "SELECT market_uid AS symbol, round(CAST(max(price) AS DOUBLE), 6) AS price, (minute + 1) * 60000000 AS event_us, greatest(max(epoch_us(ingested_at)), (minute + 1) * 60000000) AS admissible_us FROM (SELECT *, CAST(floor(epoch(event_time) / 60) AS BIGINT) AS minute FROM fills WHERE event_time IS NOT NULL) GROUP BY market_uid, minute HAVING max(epoch_us(ingested_at)) >= (minute + 1) * 60000000")
def adp12(spark: SparkSession, folder: str) -> DataFrame:
    """Minute candles of fills, final once something was received after their end."""
    minute = F.floor(F.unix_seconds("event_time") / 60)
    rows = table(spark, folder, "fills").filter("event_time is not null").groupBy(F.col("market_uid").alias("symbol"), minute.alias("minute")).agg(F.max("price").alias("high"), F.unix_micros(F.max("ingested_at")).alias("received_us"))
    end = (F.col("minute") + 1) * 60_000_000
    candles = rows.select("symbol", "high", (F.col("minute") * 60_000_000).alias("start_us"), end.alias("end_us"), "received_us", F.lit(0).cast("long").alias("exchange_us"), (F.col("received_us") >= end).alias("is_final"))
    return final_candles(candles).select("symbol", r6(F.col("price").cast("double"), "price"), "event_us", "admissible_us")


@query("adp14_outcome_pairs", "SELECT market_uid, count(DISTINCT lower(outcome_uid)) AS outcomes, true AS same FROM fills GROUP BY market_uid")
def adp14(spark: SparkSession, folder: str) -> DataFrame:
    """Two listings of a market's outcomes, in other order and case, must be equal as sets; outcomes of a market are few."""
    per = table(spark, folder, "fills").select("market_uid", "outcome_uid").distinct().groupBy("market_uid").agg(F.collect_list(F.struct(F.col("outcome_uid").alias("label"), F.col("outcome_uid").alias("id"))).alias("a"))
    other = F.reverse(F.transform("a", lambda p: F.struct(F.upper(p["label"]).alias("label"), F.upper(p["id"]).alias("id"))))
    return per.select("market_uid", F.size("a").cast("long").alias("outcomes"), same_pairs(F.col("a"), other).alias("same"))


@query("adp10_tick_uid", "SELECT delivery_id, sha256(concat_ws('|', platform, market_uid, CAST(CAST(floor(epoch(event_time)) AS BIGINT) AS VARCHAR), CAST(CAST(price AS DECIMAL(20,10)) AS VARCHAR), fill_uid)) AS tick_uid FROM fills")
def adp10(spark: SparkSession, folder: str) -> DataFrame:
    """platform, market, second, price to ten places and source key; parts that are null are left out."""
    parts = ["platform", "market_uid", F.unix_seconds("event_time").cast("string"), F.col("price").cast("decimal(20,10)").cast("string"), "fill_uid"]
    return table(spark, folder, "fills").select("delivery_id", F.sha2(F.concat_ws("|", *parts), 256).alias("tick_uid"))


@query("adp11_legacy_observation", "SELECT delivery_id, CASE WHEN maker IS NULL AND taker IS NULL THEN 'not_available' ELSE 'visible' END AS visibility FROM fills")
def adp11(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fills").select("delivery_id", F.when(F.col("maker").isNull() & F.col("taker").isNull(), "not_available").otherwise("visible").alias("visibility"))


@query("adp09_market_fallbacks", "SELECT market_uid, coalesce(category, 'uncategorised') AS category, coalesce(liquidity, 0) AS liquidity, coalesce(epoch_us(closes_at), epoch_us(scheduled_announcement_at), 0) AS closes_us FROM markets WHERE market_uid IN (SELECT market_uid FROM fills)")
def adp09(spark: SparkSession, folder: str) -> DataFrame:
    """Markets with fall-backs; a market without ticks is dropped."""
    rows = table(spark, folder, "markets").select("market_uid", F.coalesce("category", F.lit("uncategorised")).alias("category"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"), F.coalesce(F.unix_micros("closes_at"), F.unix_micros("scheduled_announcement_at"), F.lit(0)).alias("closes_us"))
    return rows.join(table(spark, folder, "fills").select("market_uid"), "market_uid", "left_semi")


@query("sc11_hex_words", "SELECT event_id, lpad(to_hex(event_id), 64, '0') AS amount, lower(right(lpad(to_hex(user_id), 40, '0'), 40)) AS address, event_id AS value FROM events WHERE user_id IS NOT NULL")
def sc11(spark: SparkSession, folder: str) -> DataFrame:
    """Words of call data and addresses of topics; numbers of 256 bits stay hex."""
    rows = table(spark, folder, "events").filter("user_id is not null").select("event_id", F.concat(F.lit("0x"), F.lpad(F.hex("user_id"), 64, "0"), F.lpad(F.hex("event_id"), 64, "0")).alias("data"), F.concat(F.lit("0x"), F.lpad(F.hex("user_id"), 64, "0")).alias("topic"))
    word = abi_word(F.col("data"), 1)
    return rows.select("event_id", F.upper(word).alias("amount"), F.substring(topic_address(F.col("topic")), 3, 40).alias("address"), F.conv(F.substring(word, 49, 16), 16, 10).cast("long").alias("value"))


# --- stores ----------------------------------------------------------------------------------------------------------
@query("snk05_ledger_verify")
def snk05(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger of the feeds, one entry changed afterwards: the two places where the chain breaks."""
    names = [r[0] for r in table(spark, folder, "feeds").select("source").orderBy("source").collect()]  # a table of fixed size
    entries = [(i, p if i != 3 else "changed", a, b) for i, p, a, b in chain(names)]
    return verify(spark.createDataFrame(entries, "sequence long, payload string, previous_hash string, entry_hash string"))


_ADJ = "a AS (SELECT revision_uid AS uid, document_uid AS case_uid, lag(revision_uid) OVER (PARTITION BY document_uid ORDER BY t, revision_uid) AS supersedes_uid FROM (SELECT document_uid, revision_uid, min(first_seen_at) AS t FROM evidence GROUP BY ALL))"


def _adjudications(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    per = table(spark, folder, "evidence").groupBy("document_uid", "revision_uid").agg(F.min("first_seen_at").alias("t"))
    before = F.lag("revision_uid").over(Window.partitionBy("document_uid").orderBy("t", "revision_uid"))
    return per.select(F.col("revision_uid").alias("uid"), F.col("document_uid").alias("case_uid"), before.alias("supersedes_uid"))


@query("snk06_current_labels", f"WITH {_ADJ} SELECT uid, case_uid FROM a WHERE uid NOT IN (SELECT supersedes_uid FROM a WHERE supersedes_uid IS NOT NULL)")
def snk06(spark: SparkSession, folder: str) -> DataFrame:
    return current_labels(_adjudications(spark, folder)).select("uid", "case_uid")


@query("snk06b_registry_violations", f"WITH {_ADJ} SELECT supersedes_uid AS uid, 'two_successors' AS reason FROM a WHERE supersedes_uid IS NOT NULL GROUP BY supersedes_uid HAVING count(*) > 1")
def snk06b(spark: SparkSession, folder: str) -> DataFrame:
    return registry_violations(_adjudications(spark, folder))


# --- streams ---------------------------------------------------------------------------------------------------------
_ARRIVED = """e AS (SELECT event_type AS stream, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'snapshot' ELSE 'delta' END AS kind, unnest([event_id * 10 + CASE WHEN event_id % 17 = 0 THEN 35 ELSE 0 END] || CASE WHEN event_id % 13 = 0 THEN [event_id * 10 + 55] ELSE [] END) AS arrived FROM events),
 s AS (SELECT *, row_number() OVER w AS k, CASE WHEN seq <= max(seq) OVER b THEN 'replay' WHEN seq > max(seq) OVER b + 1 THEN 'gap' ELSE 'contiguous' END AS status FROM e WINDOW w AS (PARTITION BY stream ORDER BY arrived, seq), b AS (PARTITION BY stream ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, max(CASE WHEN status = 'gap' THEN k END) OVER w AS g, max(CASE WHEN kind = 'snapshot' AND status <> 'replay' THEN k END) OVER w AS f FROM s WINDOW w AS (PARTITION BY stream ORDER BY k))"""


def arrived_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events as frames in order of arrival: every 17th comes out of order, every 13th again."""
    seq = F.col("event_id")
    times = F.filter(F.array(seq * 10 + F.when(seq % 17 == 0, 35).otherwise(0), F.when(seq % 13 == 0, seq * 10 + 55)), lambda t: t.isNotNull())
    return stream_table(spark, folder, "events").select(F.col("event_type").alias("stream"), seq.alias("seq"), F.when(seq % 11 == 0, "snapshot").otherwise("delta").alias("kind"), F.explode(times).alias("arrived"))


@query("st02_sequence_gaps", with_(_ARRIVED) + "SELECT stream, status, status = 'replay' OR coalesce(g > coalesce(f, -1), false) AS withheld, count(*) AS n FROM l GROUP BY ALL")
def st02(spark: SparkSession, folder: str) -> DataFrame:
    return run_once(sequence_states(arrived_frames(spark, folder)), "sequences").groupBy("stream", "status", "withheld").agg(F.count(F.lit(1)).alias("n"))


@query("st04_late_side_output", "SELECT CASE WHEN ts <= TIMESTAMP '2024-01-15' THEN 'usable' ELSE 'unavailable' END AS admission, count(*) AS n FROM events GROUP BY ALL")
def st04(spark: SparkSession, folder: str) -> DataFrame:
    stream = stream_table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_once(split_late(stream, "ts", "ts", "2024-01-15"), "late").groupBy("admission").agg(F.count(F.lit(1)).alias("n"))


@query("st07_redeliveries", "SELECT count(DISTINCT event_id) AS n FROM events")
def st07(spark: SparkSession, folder: str) -> DataFrame:
    stream = stream_table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_once(without_redeliveries(twice, "event_id", "ts", "60 days"), "once").agg(F.count(F.lit(1)).alias("n"))


@query("st11_tumbling", "SELECT event_type, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def st11(spark: SparkSession, folder: str) -> DataFrame:
    """Five-minute counts, complete over what is there."""
    stream = stream_table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = stream.groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_micros("w.start").alias("window_start"), "n")
    return run_updates(counts, "tumbling", ["event_type", "window_start"])


# --- source trees ----------------------------------------------------------------------------------------------------
#: A small tree of sources, written out by each query that reads one.
FIXTURE = {
    "app/main.py": 'import json\nfrom app.store import Store\n\n\ndef run(path):\n    return Store(json.loads(path))\n\n\nif __name__ == "__main__":\n    run("{}")\n',
    "app/store.py": "import os\n\n\nclass Store:\n    def put(self, key):\n        return os.path.join(key)\n",
    "app/broken.py": "def half(:\n",
    "tests/test_store.py": "from app.store import Store\n\n\ndef test_put():\n    assert Store\n",
    "specs/store.feature": "@storage @fast\nFeature: Store\n\n  Scenario: put a key\n    Given a store\n\n  @slow\n  Scenario Outline: put many keys\n    Given a store\n",
    "config/settings.json": '{"store": "app/store.py"}\n', "config/server.key": "none\n", "README.md": "# Store\n",
}
_TREE = "tree AS (SELECT * FROM (VALUES " + ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in FIXTURE.items()) + ") t(name, content))"


def fixture_tree(spark: SparkSession) -> str:
    """The fixture's folder below the shared one."""
    root = scratch_path(spark, "tree")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, content in FIXTURE.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(content.encode()))
        out.close()
    return root


def _named(df: DataFrame, root: str) -> DataFrame:
    """Paths from the root of the tree on."""
    mark = root.rstrip("/").rsplit("/", 1)[-1]
    return df.withColumn("path", F.substring_index("path", f"{mark}/", -1))


_KIND = "CASE WHEN regexp_matches(name, '(^|/)tests?/|(^|/)test_[^/]*[.]py$') THEN 'test' WHEN name LIKE '%.py' THEN 'source' WHEN name LIKE '%.feature' THEN 'scenario' WHEN name LIKE '%.md' THEN 'document' WHEN name LIKE '%.json' THEN 'config' ELSE 'other' END"


@query("src29_tree_snapshot", with_(_TREE) + f"SELECT name AS path, strlen(content) AS bytes, sha256(content) AS sha256, {_KIND} AS kind, regexp_matches(name, '[.]key') AS sensitive FROM tree")
def src29(spark: SparkSession, folder: str) -> DataFrame:
    root = fixture_tree(spark)
    return _named(tree(spark, root).drop("content"), root)


_FACTS = "fa AS (SELECT * FROM (VALUES ('app/main.py', 'import', 'json', 1), ('app/main.py', 'import', 'app.store', 2), ('app/main.py', 'function', 'run', 5), ('app/main.py', 'entrypoint', '__main__', 9), ('app/store.py', 'import', 'os', 1), ('app/store.py', 'class', 'Store', 4), ('app/store.py', 'function', 'put', 5), ('app/broken.py', 'error', 'SyntaxError', 1), ('tests/test_store.py', 'import', 'app.store', 1), ('tests/test_store.py', 'function', 'test_put', 4)) t(path, fact, name, line))"


@query("src30_python_facts", with_(_FACTS) + "SELECT * FROM fa")
def src30(spark: SparkSession, folder: str) -> DataFrame:
    root = fixture_tree(spark)
    return _named(python_facts(tree(spark, root, "*.py")), root)


@query("src31_scenarios", "SELECT * FROM (VALUES ('specs/store.feature', 4, 'put a key', ['@fast', '@storage']), ('specs/store.feature', 8, 'put many keys', ['@fast', '@slow', '@storage'])) t(path, line, title, tags)")
def src31(spark: SparkSession, folder: str) -> DataFrame:
    root = fixture_tree(spark)
    return _named(scenarios(tree(spark, root, "*.feature")), root)


@query("cmp19_component_status", with_(_FACTS) + "SELECT i.path, i.name AS module, CASE WHEN s.path IS NULL THEN 'external' WHEN t.path IS NOT NULL THEN 'tested' ELSE 'wired' END AS status FROM fa i LEFT JOIN (SELECT DISTINCT path FROM fa) s ON s.path = replace(i.name, '.', '/') || '.py' LEFT JOIN (SELECT DISTINCT path FROM fa WHERE path LIKE 'tests/%') t ON t.path = 'tests/test_' || split_part(i.name, '.', -1) || '.py' WHERE i.fact = 'import'")
def cmp19(spark: SparkSession, folder: str) -> DataFrame:
    """What each import comes to: a module of the tree that has a test, one that is only wired, or an external one."""
    root = fixture_tree(spark)
    facts = _named(python_facts(tree(spark, root, "*.py")), root)
    held = facts.select(F.col("path").alias("module_path")).distinct()
    imports = facts.filter("fact = 'import'").select("path", F.col("name").alias("module")).withColumns({"module_path": F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py")), "test_path": F.concat(F.lit("tests/test_"), F.element_at(F.split("module", "[.]"), -1), F.lit(".py"))})
    both = imports.join(held.withColumn("held", F.lit(True)), "module_path", "left").join(held.select(F.col("module_path").alias("test_path"), F.lit(True).alias("tested")), "test_path", "left")
    return both.select("path", "module", F.when(F.col("held").isNull(), "external").when(F.col("tested"), "tested").otherwise("wired").alias("status"))


@query("cmp20_artifact_binding", with_(_TREE) + "SELECT split_part(name, '/', -1) AS name, CASE WHEN name = 'app/store.py' THEN 'changed' ELSE 'bound' END AS status FROM tree WHERE name LIKE '%.py' UNION ALL SELECT 'nowhere.py', 'missing'")
def cmp20(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest's references: bound, changed since, or missing."""
    files = tree(spark, fixture_tree(spark), "*.py")
    manifest = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "sha256").withColumn("sha256", F.when(F.col("name") == "store.py", "0").otherwise(F.col("sha256")))
    return missing_references(manifest.unionByName(spark.createDataFrame([("nowhere.py", "0")], "name string, sha256 string")), files)


@query("agg29_inventory_summary", with_(_FACTS) + "SELECT fact, count(*) AS n, count(DISTINCT path) AS files FROM fa GROUP BY fact")
def agg29(spark: SparkSession, folder: str) -> DataFrame:
    facts = python_facts(tree(spark, fixture_tree(spark), "*.py"))
    return facts.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files")).orderBy(F.col("n").desc(), "fact")


@query("ctr05_manifest_fingerprint", with_(_TREE) + "SELECT sha256(string_agg(name || ':' || sha256(content), chr(10) ORDER BY name)) AS fingerprint, count(*) AS parts FROM tree")
def ctr05(spark: SparkSession, folder: str) -> DataFrame:
    """One hash over the sorted names and hashes of a tree's files: a manifest's metadata, not its content."""
    root = fixture_tree(spark)
    parts = _named(tree(spark, root), root).select(F.concat_ws(":", "path", "sha256").alias("p"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("parts"))


@query("prs04_reports", with_(_TREE) + "SELECT name AS path, strlen(content) AS bytes FROM tree WHERE name LIKE '%.md' OR name LIKE '%.json'")
def prs04(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of a folder, newest first; what is no report, or hidden, is not listed."""
    root = fixture_tree(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("path").rlike(r"/[A-Za-z0-9_-]+\.(md|json)$"))
    return _named(files.orderBy(F.col("modificationTime").desc(), "path").select("path", F.col("length").alias("bytes")), root)
