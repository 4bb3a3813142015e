"""Point-in-time admission, last-known joins, append classification and keyset pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def admit(df: DataFrame, cutoff: str, event: str = "event_time", available: str = "ingested_at") -> DataFrame:
    """Facts usable at `cutoff`: they happened by then and were known by then. Both tests reach the Parquet scan. Rows
    with a null clock are not usable."""
    return df.filter((F.col(event) <= instant(cutoff)) & (F.col(available) <= instant(cutoff)))


def available_at(modality: Column, first_seen: Column, ingested: Column) -> Column:
    """Documents are available when first seen, everything else when ingested."""
    return F.when(modality == "document", first_seen).otherwise(ingested)


def in_window(df: DataFrame, start: str, end: str, as_of: str, event: str = "event_time", available: str = "ingested_at") -> DataFrame:
    """(start, end] by event, known at `as_of`."""
    return df.filter((F.col(event) > instant(start)) & (F.col(event) <= instant(end)) & (F.col(available) <= instant(as_of)))


def extreme_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by `order`, as a partially aggregated minimum of structs rather than a sort.
    Order columns should be unique together; of full ties the rest of the row decides."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    best = (F.max if last else F.min)(row).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def _fresh(df: DataFrame, at: str, seen: str, payload: Sequence[str], max_age: int) -> DataFrame:
    """`payload` and `seen` as null where they are older than `max_age` seconds at `at`."""
    fresh = F.unix_micros(at) - F.unix_micros(seen) <= max_age * 1_000_000
    return df.withColumns({c: F.when(fresh, F.col(c)) for c in [*payload, seen]})


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, payload: Sequence[str], max_age: int | None = None, within_partition: Sequence[str] = ()) -> DataFrame:
    """Each left row with the `payload` of the last right row of its keys at or before its time; older than `max_age`
    seconds counts as none. One union, one shuffle, one sort: no pair of rows is ever formed. With `max_age` the time line is
    cut into slices of twenty times that age; what may still be known in the next slice is copied there, so that no task
    sorts a whole key."""
    if max_age is not None:
        width = 20 * max(max_age, 1) * 1_000_000
        at = F.floor(F.unix_micros(right_at) / width)
        reach = F.floor((F.unix_micros(right_at) + max_age * 1_000_000) / width)
        left = left.withColumn("__slice", F.floor(F.unix_micros(left_at) / width))
        right = right.withColumn("__slice", F.explode(F.sequence(at, reach)))
        return asof_join(left, right, [*keys, "__slice"], left_at, right_at, payload).transform(_fresh, left_at, f"{right_at}_right" if right_at in left.columns else right_at, [c if c not in left.columns else f"{c}_right" for c in payload], max_age).drop("__slice")
    packed = F.struct(F.col(right_at).alias("__t"), *[F.col(c) for c in payload])
    events = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("__right"))
    facts = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(events.schema["__left"].dataType).alias("__left"), packed.alias("__right"))
    upto = Window.partitionBy(*keys).orderBy("__at", "__side", F.col("__right")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = events.unionByName(facts).withColumn("__last", F.last("__right", ignorenulls=True).over(upto)).filter("__side = 1")
    age = F.unix_micros("__at") - F.unix_micros("__last.__t")
    fresh = age.isNotNull()
    return joined.select("__left.*", *[F.when(fresh, F.col(f"__last.{c}")).alias(c if c not in left.columns else f"{c}_right") for c in payload], F.when(fresh, F.col("__last.__t")).alias(f"{right_at}_right" if right_at in left.columns else right_at))


def ordered_reason(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a rule that is null does not hold."""
    out = None
    for name, rule in rules:
        out = F.when(F.coalesce(rule, F.lit(False)), name) if out is None else out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(otherwise)


def reasons(rules: Mapping[str, Column]) -> Column:
    """All names whose rule holds, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])))


def semantic_hash(df: DataFrame, ignored: Sequence[str]) -> Column:
    """SHA-256 over all columns but `ignored`, in name order, nulls kept."""
    parts = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in sorted(df.columns) if c not in ignored]
    return F.sha2(F.to_json(F.array(*parts), {"ignoreNullFields": "false"}), 256)


def classify_append(incoming: DataFrame, stored: DataFrame | None, uid: str, arrival: Sequence[str], ignored: Sequence[str] = ("ingested_at", "raw_artifact_uid")) -> DataFrame:
    """`incoming` with status: inserted (first of a new uid), duplicate (same meaning as what the uid holds), conflict
    (another meaning: to be quarantined) or rejected (null uid). `stored` holds one row per uid."""
    hashed = incoming.withColumn("__hash", semantic_hash(incoming, [*ignored, *arrival]))
    first = hashed.filter(F.col(uid).isNotNull()).groupBy(uid).agg(F.min(F.struct(*arrival, "__hash")).alias("__first"))
    if stored is not None:
        held = stored.select(F.col(uid), semantic_hash(stored, [*ignored, *arrival]).alias("__held"))
        first = first.join(held, uid, "left")
    else:
        first = first.withColumn("__held", F.lit(None).cast("string"))
    both = hashed.join(first, uid, "left")
    me = F.struct(*arrival, "__hash")
    status = ordered_reason([("rejected", F.col(uid).isNull()), ("inserted", F.col("__held").isNull() & (me == F.col("__first"))), ("duplicate", F.col("__hash") == F.coalesce("__held", F.col("__first.__hash")))], "conflict")
    return both.withColumn("status", status).select(*incoming.columns, "status")


def keyset_page(df: DataFrame, order: Sequence[str], after: Sequence[Column] | None, size: int) -> DataFrame:
    """The `size` rows after the cursor in `order`, with has_more: a filter and a bounded top, no offset scan."""
    rest = df if after is None else df.filter(F.struct(*[F.col(c) for c in order]) > F.struct(*[v.alias(c) for c, v in zip(order, after)]))
    page = rest.orderBy(*order).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order))
    return page.withColumn("__n", place).withColumn("has_more", F.max("__n").over(Window.partitionBy(F.lit(1))) > size).filter(F.col("__n") <= size).drop("__n")
