"""The relations of quaymark.sources.domain as SQL, for use in WITH clauses."""

OBS = """obs AS (SELECT 'ev:obs-' || event_id AS observation_uid, 'ev:' || event_type AS market_uid, 'ev:' || event_type || '-yes' AS outcome_uid, 'ev' AS platform,
 value / (value + 50) AS price, ['last_trade','midpoint','best_bid','best_ask','platform_snapshot'][(event_id % 5) + 1] AS kind, ts AS event_time, ts + to_seconds(event_id % 7) AS ingested_at FROM events)"""
EFILLS = """efills AS (SELECT 'ev:fill-' || event_id AS fill_uid, 'ev:' || event_type AS market_uid, 'ev:' || event_type || '-yes' AS outcome_uid, value / (value + 50) AS price,
 CAST(event_id % 97 + 1 AS DOUBLE) AS size, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 'ev:user-' || user_id AS actor_uid, ts AS event_time, ts + to_seconds(event_id % 7) AS ingested_at FROM events)"""
BOOKS = """books AS (SELECT 'ev:book-' || event_id AS snapshot_uid, 'ev:' || event_type AS market_uid, 'ev:' || event_type || '-yes' AS outcome_uid, value / (value + 50) AS p, event_id, ts AS event_time, ts + to_seconds(event_id % 7) AS ingested_at,
 list_transform([1, 2], lambda i: {'price': round(value / (value + 50) - 0.01 * i, 6), 'size': CAST(event_id % (10 * i) + i AS DOUBLE)}) AS bids, list_transform([1, 2], lambda i: {'price': round(value / (value + 50) + 0.01 * i, 6), 'size': CAST(event_id % (10 * i) + i AS DOUBLE)}) AS asks FROM events)"""
FILLS = """f AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY fill_uid ORDER BY ingested_at, delivery_id) AS rn FROM fills) WHERE rn = 1)"""


def us(column: str) -> str:
    return f"epoch_us({column})"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
