"""Mixed timestamp formats and time zones: one UTC instant per usable text."""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.session import small_side

# Minutes east of UTC that a zone abbreviation stands for.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "COT": -300, "BRT": -180, "ART": -180, "SAST": 120, "EAT": 180, "PKT": 300, "IST": 330, "NPT": 345, "SGT": 480,
    "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Seconds since 1970 of the years 2000 and 2100.
EPOCH_FROM, EPOCH_TO = 946_684_800, 4_102_444_800


def _words(names: tuple[str, ...]) -> str:
    return "|".join(sorted({x for n in names for x in (n, n[:3])} | ({"sept"} if "september" in names else set()), key=len, reverse=True))


@lru_cache(1)
def _pattern() -> tuple[str, list[str]]:
    """One expression for all written forms, and the names of its groups."""
    names: list[str] = []

    def g(name: str, body: str) -> str:
        names.append(name)
        return f"({body})"

    month, weekday = _words(MONTHS), f"(?:(?:{_words(WEEKDAYS)})\\.?,?\\s+)?"
    dates = [
        g("y1", r"\d{4}") + "-" + g("m1", r"\d{1,2}") + "-" + g("d1", r"\d{1,2}"),
        g("y7", r"\d{4}") + "/" + g("m4", r"\d{1,2}") + "/" + g("d6", r"\d{1,2}"),
        g("a", r"\d{1,2}") + "/" + g("b", r"\d{1,2}") + "/" + g("y2", r"\d{4}|\d{2}"),
        g("d2", r"\d{1,2}") + r"\." + g("m2", r"\d{1,2}") + r"\." + g("y3", r"\d{4}|\d{2}"),
        weekday + g("d3", r"\d{1,2}") + r"[ -]" + g("w1", month) + r"\.?,?[ -]" + g("y4", r"\d{4}|\d{2}"),
        weekday + g("w2", month) + r"\.? " + g("d4", r"\d{1,2}") + r",? " + g("y5", r"\d{4}"),
        g("y6", r"\d{4}") + g("m3", r"\d{2}") + g("d5", r"\d{2}"),
    ]
    clocks = [
        r"(?:t|,? (?:at )?|,)" + g("h1", r"\d{1,2}") + ":" + g("i1", r"\d{2}") + "(?::" + g("s1", r"\d{2}") + "(?:[.,]" + g("f1", r"\d+") + ")?)?(?: ?" + g("ap", "[ap]") + "\\.?m\\.?(?![a-z]))?",
        r"(?:t| )?" + g("h2", r"\d{2}") + g("i2", r"\d{2}") + "(?:" + g("s2", r"\d{2}") + "(?:[.,]?" + g("f2", r"\d+") + ")?)?",
    ]
    zone = r" ?\[?" + g("zone", "[a-z][a-z_]*(?:/[a-z0-9_+-]+)*") + r"?\]? ?" + g("off", r"[+-]\d{1,2}(?::?\d{2})?") + r"? ?(?:\[[a-z0-9_+/-]+\])?"
    return f"^(?i)(?:{'|'.join(dates)})(?:{'|'.join(clocks)})?{zone}$", names


def _parsed(df: DataFrame, raw: str, zone: str, order: str) -> DataFrame:
    """`df` with instant_us: null where the text names no instant."""
    pattern, names = _pattern()
    at = {n: i + 1 for i, n in enumerate(names)}
    mark = "\x01"
    text = F.trim(F.regexp_replace(F.col(raw), r"[\s\p{Z}]+", " "))
    df = df.withColumn("__text", text).withColumn("__parts", F.split(F.regexp_replace("__text", pattern, mark + "|" + "|".join(f"${i + 1}" for i in range(len(names)))), r"\|", -1))

    def part(*options: str) -> Column:
        return F.coalesce(*[F.nullif(F.get("__parts", F.lit(at[o])), F.lit("")) for o in options])

    def number(*options: str) -> Column:
        return part(*options).try_cast("int")

    month_no = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1)])
    month_first = F.col(order) == "mdy"
    year = number("y1", "y2", "y3", "y4", "y5", "y6", "y7")
    hour = F.coalesce(number("h1", "h2"), F.lit(0))
    half = F.lower(part("ap"))
    df = df.select(
        "*",
        (F.get("__parts", F.lit(0)) == mark).alias("__hit"),
        F.when(F.length(part("y2", "y3", "y4")) == 2, year + 2000).otherwise(year).alias("__y"),
        F.coalesce(number("m1", "m2", "m3", "m4"), F.when(month_first, number("a")).otherwise(number("b")), F.element_at(month_no, F.lower(F.substring(part("w1", "w2"), 1, 3)))).alias("__m"),
        F.coalesce(number("d1", "d2", "d3", "d4", "d5", "d6"), F.when(month_first, number("b")).otherwise(number("a"))).alias("__d"),
        F.when(half.isNull(), hour).when(~hour.between(1, 12), 99).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0)).alias("__h"),
        F.coalesce(number("i1", "i2"), F.lit(0)).alias("__i"),
        F.coalesce(number("s1", "s2"), F.lit(0)).alias("__s"),
        F.coalesce(F.rpad(F.substring(part("f1", "f2"), 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("__us"),
        part("off").alias("__off"),
        part("zone").alias("__zone"),
        F.regexp_extract("__text", r"^(\d{1,17})(?:[.,](\d+))?$", 1).try_cast("long").alias("__bare"),
        F.rpad(F.substring(F.regexp_extract("__text", r"^(\d{1,17})(?:[.,](\d+))?$", 2), 1, 6), 6, "0").alias("__rest"),
    )
    y, m, d = F.col("__y"), F.col("__m"), F.col("__d")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = F.col("__hit") & (y > 0) & m.between(1, 12) & (d >= 1) & (d <= last) & (F.col("__h") < 24) & (F.col("__i") < 60) & (F.col("__s") < 60)
    day = F.when(real, F.unix_date(F.make_date(y, m, d)))
    wall = ((day.cast("long") * 86_400 + F.col("__h") * 3600 + F.col("__i") * 60 + F.col("__s")) * 1_000_000) + F.col("__us")
    digits = F.regexp_replace(F.substring("__off", 2, 9), ":", "")
    hours, minutes = F.when(F.length(digits) <= 2, digits).otherwise(F.expr("left(regexp_replace(substring(__off, 2, 9), ':', ''), length(regexp_replace(substring(__off, 2, 9), ':', '')) - 2)")).try_cast("int"), F.when(F.length(digits) > 2, F.right(digits, F.lit(2))).otherwise("0").try_cast("int")
    offset = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(F.col("__off").startswith("-"), -1).otherwise(1))
    short = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    stated = F.element_at(short, F.upper("__zone"))
    named = F.when(F.col("__zone").isNotNull(), F.when(stated.isNull(), F.col("__zone"))).otherwise(F.col(zone))
    zones = sorted(available_timezones())
    df = df.select("*", wall.alias("__wall"), F.when(F.col("__off").isNotNull(), offset).otherwise(stated).alias("__east"), F.col("__off").isNotNull().alias("__hasoff"), F.when(named.isin(zones), named).alias("__named"))
    known = F.when(F.col("__hasoff") | F.col("__east").isNotNull(), F.col("__wall") - F.col("__east").cast("long") * 60_000_000).otherwise(
        F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__wall"), F.col("__named")))
    )
    bare = F.col("__bare")
    counted = F.coalesce(
        F.when(bare.between(EPOCH_FROM, EPOCH_TO - 1), bare * 1_000_000 + F.col("__rest").try_cast("long")),
        F.when(bare.between(EPOCH_FROM * 1000, EPOCH_TO * 1000 - 1), bare * 1000 + F.substring("__rest", 1, 3).try_cast("long")),
        F.when(bare.between(EPOCH_FROM * 1_000_000, EPOCH_TO * 1_000_000 - 1), bare),
    )
    return df.withColumn("instant_us", F.coalesce(counted, known)).drop(*[c for c in df.columns if c.startswith("__")])


def parse_texts(df: DataFrame, raw: str = "raw", zone: str = "zone", order: str = "date_order") -> DataFrame:
    """Adds instant_us, microseconds since 1970 UTC, null where `raw` names no instant.

    Surrounding blanks don't count. An offset, zone or abbreviation in the text holds, else `zone`; without either the
    text is unusable. Dates with slashes follow `order` (mdy or dmy, null like dmy), with dots the day is first,
    two-digit years are 20xx, a date alone is the start of that day, missing smaller units are zero, digits beyond
    microseconds are cut. A bare number counts seconds, milliseconds or microseconds since 1970 where that falls in
    2000-2099, else its digits are a calendar reading. A wall time that occurs twice is its first occurrence, a skipped
    one takes the offset in force before the change. Nulls, blanks, words and impossible readings give null.
    """
    return _parsed(df, raw, zone, order)


class TimestampDictionary:
    """Every distinct (raw, zone, date_order) is parsed once; later batches add only what is new."""

    KEY = ("raw", "zone", "date_order")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), 0

    def stored(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/*") if self.parts else None

    def update(self, rows: DataFrame) -> None:
        """Adds the distinct texts of `rows` (columns raw, zone, date_order). Nulls name nothing and aren't kept."""
        fresh = rows.filter(F.col("raw").isNotNull()).select(*self.KEY).distinct()
        if (old := self.stored()) is not None:
            same = fresh["raw"] == old["raw"]
            for c in self.KEY[1:]:
                same = same & fresh[c].eqNullSafe(old[c])
            fresh = fresh.join(old, same, "left_anti")
        parse_texts(fresh).write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def resolve(self, rows: DataFrame) -> DataFrame:
        """`rows` whose text names an instant, with instant_us; every repeat of a text gets the one parsed reading."""
        usable = self.stored().filter(F.col("instant_us").isNotNull()).select(*[F.col(c).alias(f"__{c}") for c in self.KEY], "instant_us")
        same = F.col("raw") == F.col("__raw")
        for c in self.KEY[1:]:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return rows.join(small_side(usable), same).select(*[rows[c] for c in rows.columns], "instant_us")
