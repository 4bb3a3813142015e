"""Messages delivered more than once: keep exactly one copy of each identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.session import materialise, small_side

MARK, BEST = "__copy_mark", "__copy_best"


def _mark(key: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in key])


def _identified(df: DataFrame, key: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return known


def repeated_marks(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hashes of the identifiers that occur more than once: eight bytes and a partial count are all that is shuffled.

    Two identifiers of equal hash count as repeated; ranking by the true identifier sets that right.
    """
    counts = df.filter(_identified(df, key)).select(_mark(key).alias(MARK)).groupBy(MARK).count()
    return materialise(counts.filter("count > 1").select(MARK), "repeated")


def _split(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    marks = small_side(repeated_marks(df, key))
    marked = df.withColumn(MARK, F.when(_identified(df, key), _mark(key)))
    return marked.join(marks, MARK, "left_anti").drop(MARK), marked.join(marks, MARK, "left_semi").drop(MARK)


def _order(order: Sequence[str]) -> Column:
    """Nulls last, as in a sort by `order`."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])


def _ranked(repeated: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The repeated groups with the order value of their first copy.

    The minimum is aggregated before the shuffle, so a group of any size is never sorted in one task, and the join back
    is one row per group against many: adaptive execution splits a hot group there.
    """
    best = repeated.groupBy(*key).agg(F.min(_order(order)).alias(BEST))
    return repeated.join(best, list(key))


def deduplicate(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exactly one row of each identifier `key`: the first by `order`, nulls last.

    Singletons pass as they are; only repeated identifiers are ranked; both are united. Rows that are first together
    (equal in all of `order`) leave one of them. Rows with a null in `key` have no identity and all stay. An empty
    table gives an empty table; other columns don't matter.
    """
    once, repeated = _split(df, key)
    kept = _ranked(repeated, key, order).filter(_order(order) == F.col(BEST)).drop(BEST).dropDuplicates(list(key))
    return once.unionByName(kept.select(*df.columns))


def surplus(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that `deduplicate` drops, where `order` tells all copies of an identifier apart."""
    _, repeated = _split(df, key)
    return _ranked(repeated, key, order).filter(_order(order) > F.col(BEST)).select(*df.columns)


def deduplicate_arrivals(new: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of `new` that a store of one copy of each identifier still lacks, one copy of each.

    What is stored stays: an identifier of `stored` admits nothing more. Rows without identity are all admitted.
    """
    fresh = deduplicate(new, key, order)
    return fresh.join(stored.select(*key), list(key), "left_anti").select(*new.columns)


def first_of_either(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in `order` (unique together), of which one is kept unless a row kept before it shares any of `keys` with it.

    Null keys are shared with none. In rounds: a row that comes first of all that are still open under each of its keys is
    kept, what shares a key with a kept row is dropped, until none is open. A round groups by key with partial aggregates,
    so a key of any size is no task's work, and each round cuts its lineage. Rows of equal `order` are one row.
    """
    turn, many = F.struct(*order), F.inline(F.array(*[F.struct(F.lit(k).alias("__kind"), F.col(k).cast("string").alias("__value")) for k in keys]))
    open_rows = materialise(df.dropDuplicates(list(order)), "rows")
    everything, kept = open_rows, None
    while not open_rows.isEmpty():
        under = open_rows.select(turn.alias("__turn"), many).filter("__value is not null")
        lead = under.groupBy("__kind", "__value").agg(F.min("__turn").alias("__first"))
        waiting = under.join(lead, ["__kind", "__value"]).filter("__first < __turn").select("__turn").distinct()
        sure = materialise(open_rows.select(turn.alias("__turn")).join(waiting, "__turn", "left_anti"), "sure")
        taken = under.join(sure, "__turn", "left_semi").select("__kind", "__value").distinct()
        gone = under.join(taken, ["__kind", "__value"], "left_semi").select("__turn").unionByName(sure).distinct()
        kept = sure if kept is None else kept.unionByName(sure)
        open_rows = materialise(open_rows.withColumn("__turn", turn).join(gone, "__turn", "left_anti").drop("__turn"), "open")
    return everything if kept is None else everything.withColumn("__turn", turn).join(kept, "__turn", "left_semi").drop("__turn")
