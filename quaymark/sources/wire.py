"""Normalisers of venue frames and landed JSON: text in, typed rows out; what is malformed is kept apart, never defaulted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADE = "market string, outcome string, side string, price string, size string, ts string, ts_ms string, wallet string, tx string"
FRAME = "event_type string, market string, seq long, price string, size string, side string, ts string, ts_ms string, bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>, changes array<struct<side:string,price:string,size:string>>, best_bid string, best_ask string"


def money(text: Column, precision: str) -> Column:
    """Numbers arrive as text and never pass through a float."""
    return text.try_cast(f"decimal({precision})")


def event_time(received: Column, parsed: str = "x") -> tuple[Column, Column]:
    """(instant in microseconds, its source): ts_ms, else ts (seconds), else the receipt."""
    ms, s = F.col(f"{parsed}.ts_ms").try_cast("long"), F.col(f"{parsed}.ts").try_cast("long")
    return F.coalesce(ms * 1000, s * 1_000_000, F.unix_micros(received)), F.when(ms.isNotNull(), "ts_ms").when(s.isNotNull(), "ts").otherwise("receipt")


def uid(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"ev:{kind}:"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def rest_trades(landed: DataFrame, body: str, received: str) -> DataFrame:
    """Landed trades as fills: side must be BUY or SELL, numbers must be numbers; others have a reason and no fill."""
    df = landed.withColumn("x", F.from_json(body, TRADE))
    at, source = event_time(F.col(received))
    side, price, size = F.upper("x.side"), money(F.col("x.price"), "12,10"), money(F.col("x.size"), "24,10")
    reason = F.when(F.col("x.market").isNull(), "unreadable").when(~F.coalesce(side.isin("BUY", "SELL"), F.lit(False)), "side_unknown").when(price.isNull() | ~price.between(0, 1), "price_invalid").when(size.isNull() | (size < 0), "size_invalid")
    named = uid("fill", F.col("x.market"), F.col("x.outcome"), side, price, size, at, F.col("x.wallet"), F.col("x.tx"))
    return df.select("*", F.when(reason.isNull(), named).alias("fill_uid"), F.col("x.market").alias("market_uid"), side.alias("side"), price.alias("price"), size.alias("size"), at.alias("event_us"), source.alias("time_source"), F.lower("x.wallet").alias("actor_uid"), reason.alias("reason")).drop("x")


def frames(landed: DataFrame, body: str, received: str) -> DataFrame:
    """One row per fact of a frame: market, fact (level, observation, fill, bid, ask or unknown), kind, side, price, size, seq.

    book: bids by falling, asks by rising price, one row a level; price_change: a level change and a snapshot observation
    each, size 0 removes the level; last_trade_price: a fill without actor and an observation; best_bid_ask: two
    observations; any other frame is kept as unknown.
    """
    df = landed.withColumn("x", F.from_json(body, FRAME))
    at, source = event_time(F.col(received))

    def fact(name: Column | str, kind: Column | str, side: Column, price: Column, size: Column, rank: Column | None = None) -> Column:
        text = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(text(name).alias("fact"), text(kind).alias("kind"), side.alias("side"), money(price, "12,10").alias("price"), money(size, "24,10").alias("size"), (F.lit(0) if rank is None else rank).alias("rank"))

    none = F.lit(None).cast("string")
    level = lambda side: lambda v, i: fact("level", "book", F.lit(side), v["price"], v["size"], i)
    ordered = lambda c, falling: F.array_sort(F.coalesce(c, F.array().cast("array<struct<price:string,size:string>>")), lambda a, b: F.coalesce((F.signum(a["price"].try_cast("double") - b["price"].try_cast("double")) * (-1 if falling else 1)).cast("int"), F.lit(0)))
    book = F.concat(F.transform(ordered(F.col("x.bids"), True), level("bid")), F.transform(ordered(F.col("x.asks"), False), level("ask")))
    change = F.flatten(F.transform("x.changes", lambda c: F.array(fact("level", F.when(c["size"].try_cast("double") == 0, "level_removed").otherwise("level_changed"), c["side"], c["price"], c["size"]), fact("observation", "platform_snapshot", none, c["price"], none))))
    trade = F.array(fact("fill", "trade", F.upper("x.side"), F.col("x.price"), F.col("x.size")), fact("observation", "last_trade", none, F.col("x.price"), none))
    best = F.filter(F.array(fact("observation", "best_bid", none, F.col("x.best_bid"), none), fact("observation", "best_ask", none, F.col("x.best_ask"), none)), lambda f: f["price"].isNotNull())
    other = F.array(fact("unknown", F.coalesce(F.col("x.event_type"), F.lit("unreadable")), none, none, none))
    kind = F.col("x.event_type")
    facts = F.when(kind == "book", book).when(kind == "price_change", change).when(kind == "last_trade_price", trade).when(kind == "best_bid_ask", best).otherwise(other)
    keep = [c for c in landed.columns if c not in (body, received)]
    return df.select(*keep, F.col("x.market").alias("market"), F.col("x.seq").alias("seq"), at.alias("event_us"), source.alias("time_source"), F.inline(facts))


def final_candles(candles: DataFrame, skew_seconds: int = 5) -> DataFrame:
    """Closed one-minute candles: price is the high, the event is the candle's end, admissible at the latest of receipt,
    exchange clock and end; an exchange clock too far ahead of the receipt is refused."""
    ok = F.col("is_final") & (F.col("end_us") - F.col("start_us") == 60_000_000) & (F.col("exchange_us") <= F.col("received_us") + skew_seconds * 1_000_000)
    return candles.filter(F.coalesce(ok, F.lit(False))).select("symbol", F.col("high").alias("price"), F.col("end_us").alias("event_us"), F.greatest("received_us", "exchange_us", "end_us").alias("admissible_us"))


def same_pairs(left: Column, right: Column) -> Column:
    """Whether two lists of (label, id) are equal as sets, regardless of case."""
    flat = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda p: F.concat_ws("\x01", F.lower(p["label"]), F.lower(p["id"])))))
    return flat(left) == flat(right)


def feed_entries(pages: DataFrame) -> DataFrame:
    """Entries of feed pages (source, format rss or atom, xml): source, key, document_id (its own id, else its link). Pages that
    are no XML and entries without any id give nothing."""
    rss = "struct<channel: struct<item: array<struct<guid: string, link: string, key: string>>>>"
    atom = "struct<entry: array<struct<id: string, link: struct<_href: string>, key: string>>>"
    one = pages.filter("format = 'rss'").select("source", F.explode(F.from_xml("xml", rss)["channel"]["item"]).alias("e")).select("source", F.col("e.key").alias("key"), F.col("e.guid").alias("own"), F.col("e.link").alias("link"))
    two = pages.filter("format = 'atom'").select("source", F.explode(F.from_xml("xml", atom)["entry"]).alias("e")).select("source", F.col("e.key").alias("key"), F.col("e.id").alias("own"), F.col("e.link._href").alias("link"))
    none = F.lit("")
    named = one.unionByName(two).withColumn("document_id", F.coalesce(F.nullif(F.trim("own"), none), F.nullif(F.trim("link"), none)))
    return named.filter("document_id is not null").select("source", "key", "document_id")
