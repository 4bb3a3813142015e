"""The queries p1_ to p6_: large-scale data-processing problems over the surveillance tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.attributes import AttributeHistories, known_attributes
from quaymark.operators.dedup import deduplicate, deduplicate_arrivals, surplus
from quaymark.operators.features import feature_table
from quaymark.operators.skew import compress, hot_keys, profile, weighted_percentiles
from quaymark.operators.timestamps import TimestampDictionary
from quaymark.session import materialise, scratch_path, small_side, write_once
from quaymark.sources.tables import table
from quaymark.streaming.panes import PaneStore, panes, windows

COPY_ORDER = ("ingested_at", "delivery_id")
#: Attributes of a document that change on their own; True where a value is known from its first sight only.
DOCUMENT_ATTRIBUTES = {"revision_uid": True, "title": False, "url": False, "publication_timestamp_status": False}


def _matches(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "match_results").select("match_uid", "document_uid", "as_of", *columns).filter("as_of is not null").distinct()


def _in_micros(df: DataFrame) -> DataFrame:
    """Instants as microseconds since 1970 UTC, which every reader shows alike."""
    return df.select(*[F.unix_micros(c).alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    stored = AttributeHistories(spark, scratch_path(spark, "histories"), {"revision_uid": True})
    stored.update(table(spark, folder, "evidence"), "document_uid", "first_seen_at")
    known = known_attributes(_matches(spark, folder), stored.past(), "document_uid", "as_of", ["revision_uid"])
    return known.filter("revision_uid is not null").select("match_uid", "revision_uid")


def p1_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """The histories come in two updates, backfilled rows second, though they may be known from earlier."""
    stored = AttributeHistories(spark, scratch_path(spark, "histories"), DOCUMENT_ATTRIBUTES)
    evidence, late = table(spark, folder, "evidence"), F.coalesce(F.col("backfill"), F.lit(False))
    for rows in (evidence.filter(~late), evidence.filter(late)):
        stored.update(rows, "document_uid", "first_seen_at")
    return _in_micros(known_attributes(_matches(spark, folder), stored.past(), "document_uid", "as_of", list(DOCUMENT_ATTRIBUTES)))


def _fills(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "fills").select("delivery_id", "fill_uid", "ingested_at", *columns)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return surplus(_fills(spark, folder), ["fill_uid"], COPY_ORDER).select("delivery_id")


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    return _in_micros(deduplicate(_fills(spark, folder, "market_uid", "actor_uid", "price", "size"), ["fill_uid"], COPY_ORDER))


def _weeks(rows: DataFrame) -> list[DataFrame]:
    """`rows` in batches by week of arrival, in order; rows without a time of arrival come in the last one."""
    week = F.date_trunc("week", "ingested_at")
    starts = [r[0] for r in rows.select(week.alias("w")).filter("w is not null").distinct().orderBy("w").collect()]  # one row a week
    own = [rows.filter((F.col("ingested_at") >= a) & (F.col("ingested_at") < a + timedelta(days=7))) for a in starts]
    none = rows.filter(F.col("ingested_at").isNull())
    return [*own[:-1], own[-1].unionByName(none)] if own else [none]


def p2_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries come week by week; a store takes one copy of each message, whenever copies come."""
    rows, path, stored = _fills(spark, folder), scratch_path(spark, "store"), None
    for i, batch in enumerate(_weeks(rows)):
        fresh = deduplicate(batch, ["fill_uid"], COPY_ORDER) if stored is None else deduplicate_arrivals(batch, stored, ["fill_uid"], COPY_ORDER)
        added = write_once(fresh, f"{path}/part={i}")
        stored = added if stored is None else stored.unionByName(added)
    return stored.select("delivery_id", "fill_uid")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = compress(table(spark, folder, "fills"), ["actor_uid"], ["market_uid"])
    kinds = [hot_keys(pairs, c, 40).select(F.lit(c.removesuffix("_uid")).alias("kind"), F.col(c).alias("key_uid")) for c in ("actor_uid", "market_uid")]
    return kinds[0].unionByName(kinds[1])


def p3_profiles(spark: SparkSession, folder: str) -> DataFrame:
    pairs = compress(table(spark, folder, "fills"), ["actor_uid"], ["market_uid"])
    sides = []
    for key, value in (("actor_uid", "market_uid"), ("market_uid", "actor_uid")):
        one = profile(pairs, key, value).filter(F.col(key).isNotNull())
        sides.append(one.select(F.lit(key.removesuffix("_uid")).alias("kind"), F.col(key).alias("key_uid"), "n_rows", "n_values", F.col("mode_value").alias("mode_uid"), "mode_rows"))
    return sides[0].unionByName(sides[1])


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    sizes = compress(table(spark, folder, "fills").filter("market_uid is not null"), ["market_uid"], ["size"])
    return weighted_percentiles(sizes, "market_uid", "size", (0.5, 0.9, 0.99)).withColumnRenamed("value_at", "size_at")


def _kinds(spark: SparkSession, folder: str) -> list[str]:
    """The pairs of category and side; markets is a table of fixed size."""
    rows = table(spark, folder, "markets").filter("category is not null").select("category").distinct().orderBy("category").collect()
    return [f"{r[0]} {side}" for r in rows for side in ("buy", "sell")]


def p4_features(spark: SparkSession, folder: str) -> DataFrame:
    markets = small_side(table(spark, folder, "markets").select("market_uid", "category"))
    fills = table(spark, folder, "fills").select("actor_uid", "market_uid", "side", "event_time", "price", "size")
    typed = fills.join(markets, "market_uid", "left").withColumn("kind", F.concat_ws(" ", F.col("category"), F.when(F.col("category").isNotNull(), F.lower("side"))))
    return _in_micros(feature_table(typed, "actor_uid", "kind", "event_time", {"size": F.col("size"), "notional": F.col("price") * F.col("size")}, _kinds(spark, folder)))


def _clocks(spark: SparkSession, folder: str, name: str, uid: str) -> DataFrame:
    fields = ("claimed_published_at", "modified_at")
    feeds = small_side(table(spark, folder, "feeds").select("source", F.col("default_tz").alias("zone"), "date_order"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])
    rows = table(spark, folder, name).select(F.col(uid).alias("record_uid"), "source", F.inline(pairs)).filter("raw is not null")
    return rows.join(feeds, "source", "left").select("record_uid", "field_name", "raw", "zone", "date_order")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    readings = TimestampDictionary(spark, scratch_path(spark, "clocks"))
    tables = [_clocks(spark, folder, "evidence", "evidence_uid"), _clocks(spark, folder, "parsed_entries", "entry_uid")]
    for rows in tables:
        readings.update(rows)
    return readings.resolve(tables[0].unionByName(tables[1])).select("record_uid", "field_name", "instant_us")


def _stream_fills(spark: SparkSession, folder: str) -> DataFrame:
    copies = deduplicate(_fills(spark, folder, "market_uid", "event_time", "price", "size"), ["fill_uid"], COPY_ORDER)
    return copies.withColumn("notional", F.col("price") * F.col("size"))


def _hours(spark: SparkSession, folder: str) -> DataFrame:
    return panes(_stream_fills(spark, folder), ["market_uid"], "event_time", "ingested_at", ["size", "notional"])


def p6_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The hours as last emitted when fills come week by week; old weeks are folded and closed hours retired on the way."""
    store, out = PaneStore(spark, scratch_path(spark, "panes"), ["market_uid"], ["size", "notional"]), None
    for i, batch in enumerate(_weeks(materialise(_stream_fills(spark, folder), "stream"))):
        emitted = materialise(store.merge(batch, i, "event_time", "ingested_at").withColumn("batch", F.lit(i)), "emitted")
        out = emitted if out is None else out.unionByName(emitted)
        if i % 3 == 2:
            came = batch.agg(F.min(F.unix_seconds("ingested_at"))).first()[0]
            store.compact(i, came)
    last = out.groupBy("market_uid", "period_start").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("market_uid", "period_start", "n_refused", "batch")]), "batch").alias("w"))
    return last.select("market_uid", "period_start", "w.*")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return windows(_hours(spark, folder), ["market_uid"], ["size", "notional"]).filter("corrected").select("market_uid", "period_start")


def p6_hours(spark: SparkSession, folder: str) -> DataFrame:
    return windows(_hours(spark, folder), ["market_uid"], ["size", "notional"])


def p6_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return windows(_hours(spark, folder), ["market_uid"], ["size", "notional"], width=6, step=2)


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p2_found, p2_kept, p2_arrivals, p3_found, p3_profiles, p3_percentiles, p4_features, p5_found, p6_found, p6_hours, p6_sliding, p6_stream)}

_COPIES = "(SELECT *, row_number() OVER (PARTITION BY fill_uid ORDER BY ingested_at, delivery_id) AS rn FROM fills)"
_HISTORY = "SELECT document_uid, revision_uid, min(first_seen_at) AS known FROM evidence GROUP BY ALL"
_MATCHES = "SELECT DISTINCT match_uid, document_uid, as_of FROM match_results WHERE as_of IS NOT NULL"


def _last_known(attribute: str) -> str:
    return f"""(SELECT match_uid, {attribute}, {attribute}_known_at FROM (SELECT m.match_uid, e.{attribute}, e.first_seen_at AS {attribute}_known_at,
      row_number() OVER (PARTITION BY m.match_uid ORDER BY e.first_seen_at DESC, e.{attribute} DESC NULLS LAST) AS k FROM m JOIN evidence e ON e.document_uid = m.document_uid AND e.first_seen_at <= m.as_of) WHERE k = 1)"""


_HOURS = f"""c AS (SELECT market_uid, CAST(floor(epoch(event_time) / 3600) AS BIGINT) * 3600 AS pane, epoch_us(ingested_at) AS came, size, price FROM {_COPIES} WHERE rn = 1 AND event_time IS NOT NULL),
 p AS (SELECT market_uid, pane, size, price, CASE WHEN came <= (pane + 3900) * 1000000 THEN 0 WHEN came <= (pane + 3600 + 86400) * 1000000 THEN 1 ELSE 2 END AS phase FROM c)"""


def _windows(source: str) -> str:
    return f"""SELECT market_uid, period_start, count(*) FILTER (phase = 0) AS first_n, count(*) FILTER (phase < 2) AS n, count(*) FILTER (phase = 1) AS n_late, count(*) FILTER (phase = 2) AS n_refused,
      sum(size) FILTER (phase = 0) AS first_size, sum(size) FILTER (phase < 2) AS size, sum(price * size) FILTER (phase = 0) AS first_notional, sum(price * size) FILTER (phase < 2) AS notional, count(*) FILTER (phase = 1) > 0 AS corrected FROM {source} GROUP BY ALL"""


SQL = {
    "p1_found": f"WITH h AS ({_HISTORY}), m AS ({_MATCHES}) SELECT match_uid, revision_uid FROM (SELECT match_uid, revision_uid, row_number() OVER (PARTITION BY match_uid ORDER BY known DESC, revision_uid DESC) AS k FROM m JOIN h ON h.document_uid = m.document_uid AND h.known <= m.as_of) WHERE k = 1",
    "p1_attributes": f"WITH h AS ({_HISTORY}), m AS ({_MATCHES}), r AS (SELECT match_uid, revision_uid, known AS revision_uid_known_at FROM (SELECT *, row_number() OVER (PARTITION BY match_uid ORDER BY known DESC, revision_uid DESC) AS k FROM m JOIN h ON h.document_uid = m.document_uid AND h.known <= m.as_of) WHERE k = 1) SELECT * REPLACE (epoch_us(as_of) AS as_of, epoch_us(revision_uid_known_at) AS revision_uid_known_at, epoch_us(title_known_at) AS title_known_at, epoch_us(url_known_at) AS url_known_at, epoch_us(publication_timestamp_status_known_at) AS publication_timestamp_status_known_at) FROM m LEFT JOIN r USING (match_uid) LEFT JOIN {_last_known('title')} USING (match_uid) LEFT JOIN {_last_known('url')} USING (match_uid) LEFT JOIN {_last_known('publication_timestamp_status')} USING (match_uid)",
    "p2_found": f"SELECT delivery_id FROM {_COPIES} WHERE rn > 1",
    "p2_kept": f"SELECT delivery_id, fill_uid, epoch_us(ingested_at) AS ingested_at, market_uid, actor_uid, price, size FROM {_COPIES} WHERE rn = 1",
    "p2_arrivals": f"SELECT delivery_id, fill_uid FROM {_COPIES} WHERE rn = 1",
    "p3_found": "WITH k AS (SELECT 'actor' AS kind, actor_uid AS key_uid FROM fills UNION ALL SELECT 'market', market_uid FROM fills) SELECT kind, key_uid FROM k WHERE key_uid IS NOT NULL GROUP BY ALL HAVING count(*) * 40 >= (SELECT count(*) FROM fills)",
    "p3_profiles": "WITH k AS (SELECT 'actor' AS kind, actor_uid AS key_uid, market_uid AS v FROM fills UNION ALL SELECT 'market', market_uid, actor_uid FROM fills), c AS (SELECT kind, key_uid, v, count(*) AS n FROM k WHERE key_uid IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind, key_uid ORDER BY v IS NULL, n DESC, v) AS o FROM c) SELECT kind, key_uid, CAST(sum(n) AS BIGINT) AS n_rows, count(v) AS n_values, max(v) FILTER (o = 1) AS mode_uid, max(n) FILTER (o = 1 AND v IS NOT NULL) AS mode_rows FROM r GROUP BY kind, key_uid",
    "p3_percentiles": "WITH p AS (SELECT unnest([0.5, 0.9, 0.99]) AS fraction), r AS (SELECT market_uid, size, row_number() OVER (PARTITION BY market_uid ORDER BY size) AS k, count(*) OVER (PARTITION BY market_uid) AS n FROM fills WHERE market_uid IS NOT NULL AND size IS NOT NULL) SELECT market_uid, CAST(fraction AS DOUBLE) AS fraction, size AS size_at FROM r, p WHERE k = greatest(1, CAST(ceil(CAST(fraction AS DOUBLE) * n) AS BIGINT))",
    "p6_found": f"WITH {_HOURS} SELECT market_uid, pane AS period_start FROM p WHERE phase = 1 GROUP BY ALL",
    "p6_hours": f"WITH {_HOURS} {_windows('(SELECT *, pane AS period_start FROM p)')}",
    "p6_stream": f"WITH {_HOURS}, w AS ({_windows('(SELECT *, pane AS period_start FROM p)')}) SELECT * EXCLUDE (n_refused) FROM w WHERE n > 0",
    "p6_sliding": f"WITH {_HOURS} {_windows('(SELECT *, pane - 3600 * i AS period_start FROM p, (SELECT unnest(range(6)) AS i) WHERE (pane // 3600 - i) % 2 = 0)')}",
}

# Topics and facets whose pairs are the market categories of the test tables; only the SQL needs them.
TOPICS = ("census", "court", "election", "energy", "film", "health", "rates", "shipping", "space", "sport", "trade", "weather")
FACETS = ("annual", "award", "final", "local", "margin", "national", "other", "outage", "recount", "timing")


def _features_sql() -> str:
    parts = ["count(*) AS n_all", "epoch_us(max(event_time)) AS last_all", "sum(size) AS size_all", "sum(price * size) AS notional_all"]
    for topic in TOPICS:
        for facet in FACETS:
            for side in ("buy", "sell"):
                name, here = f"{topic}_{facet}_{side}", f"FILTER (kind = '{topic}/{facet} {side}')"
                parts += [f"count(*) {here} AS n_{name}", f"epoch_us(max(event_time) {here}) AS last_{name}", f"sum(size) {here} AS size_{name}", f"sum(price * size) {here} AS notional_{name}"]
    return f"SELECT actor_uid, {', '.join(parts)} FROM (SELECT f.*, m.category || ' ' || lower(f.side) AS kind FROM fills f LEFT JOIN markets m USING (market_uid)) WHERE actor_uid IS NOT NULL GROUP BY actor_uid"


SQL["p4_features"] = _features_sql()
