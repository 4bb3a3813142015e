"""Evidence matching, public explanations, and exact filter-before-rank retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.scalars import dot, lead_hours, norm
from quaymark.operators.asof import ordered_reason
from quaymark.session import BROADCAST_LIMIT_BYTES, materialise

#: Queries in one block.
QUERY_BLOCK = 256

WEIGHTS = {"relevance": 0.55, "entity": 0.15, "time": 0.15, "provenance": 0.075, "reliability": 0.075}


def lexical_match(pairs: DataFrame, wanted: str, found: str) -> DataFrame:
    """Adds overlap (shared terms), ratio (of the wanted terms) and matched: at least min(2, wanted) shared and a quarter."""
    shared = F.size(F.array_intersect(wanted, found))
    df = pairs.withColumn("overlap", shared).withColumn("ratio", F.try_divide(shared.cast("double"), F.size(wanted).cast("double")))
    return df.withColumn("matched", (F.size(wanted) > 0) & (F.col("overlap") >= F.least(F.lit(2), F.size(wanted))) & (F.col("ratio") >= 0.25))


def explanation(shocks: DataFrame, matches: DataFrame, coverage: DataFrame, shock: str, group: str) -> DataFrame:
    """Status per shock: observed_pre_shock, timing_ambiguous, no_match (only where coverage is adequate) or
    unknown_coverage, with the lead in hours of the earliest matching document (null unless within 720 h)."""
    per = matches.groupBy(group).agg(F.min("seen_at").alias("seen_at"), F.bool_or("ambiguous").alias("ambiguous"))
    df = shocks.join(per, group, "left").join(coverage, group, "left")
    lead = lead_hours(F.col(shock), F.col("seen_at"))
    status = ordered_reason([("observed_pre_shock", (F.col("seen_at") <= F.col(shock)) & ~F.col("ambiguous")), ("timing_ambiguous", F.col("seen_at").isNotNull()), ("no_match", F.col("adequate"))], "unknown_coverage")
    return df.withColumn("status", status).withColumn("lead_hours", F.when(F.abs(lead) <= 720, lead))


def evidence_state(n_matched: Column, n_read: Column) -> Column:
    return F.when(F.coalesce(n_read, F.lit(0)) == 0, "no_evidence").when(F.coalesce(n_matched, F.lit(0)) == 0, "context").otherwise("attributed")


def cosine_search(queries: DataFrame, catalog: DataFrame, query_id: str, record_id: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """The exact `k` nearest records of each query by cosine (or by Euclidean `distance`); the query itself is no record of its own.

    `catalog` must be filtered before it comes here: ranks are of eligible records only. Vectors are normalised once per
    row. Queries are put into blocks of QUERY_BLOCK; as many blocks as fit the broadcast limit meet the records at a time,
    where these lie, and only the best `k` per query and partition leave a task. Zero or missing vectors are similar to
    nothing. Ties by record id.
    """
    unit = lambda df: df.withColumn("__v", F.transform(vector, lambda x: x.cast("double"))).withColumn("__n", norm(F.col("__v"))).filter("__n > 0")
    q = unit(queries).select(F.col(query_id).alias("query_id"), F.col("__v").alias("__q"), F.col("__n").alias("__qn"))
    r = unit(catalog).select(F.col(record_id).alias("record_id"), "__v", "__n")
    count, width = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("__q")), F.lit(0))).first()
    blocks = max(1, -(-count // QUERY_BLOCK))
    grouped = materialise(q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("__block")).agg(F.collect_list(F.struct("query_id", "__q", "__qn")).alias("__queries")), "queries")
    at_once = max(1, BROADCAST_LIMIT_BYTES // (QUERY_BLOCK * (8 * width + 32)))
    scored = None
    for low in range(0, blocks, at_once):
        high = min(blocks, low + at_once) - 1
        part = grouped.filter(F.col("__block").between(low, high))
        met = r.withColumn("__block", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")))).join(F.broadcast(part), "__block").withColumn("__x", F.explode("__queries"))
        apart = F.sqrt(F.aggregate(F.zip_with("__x.__q", "__v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        measure = apart if metric == "distance" else dot(F.col("__x.__q"), F.col("__v")) / (F.col("__x.__qn") * F.col("__n"))
        one = met.filter(F.col("__x.query_id") != F.col("record_id")).select(F.col("__x.query_id").alias("query_id"), "record_id", measure.alias(metric))
        scored = one if scored is None else scored.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(metric).asc() if metric == "distance" else F.col(metric).desc(), "record_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)  # Spark limits groups before the shuffle as well


def rerank(hits: DataFrame, hint: Column, entity: Column, time: Column, provenance: Column, reliability: Column) -> DataFrame:
    """Weighted mean of relevance ((cosine + 1) / 2 * hint), entity overlap, time decay, provenance and reliability."""
    relevance = (F.col("cosine") + 1) / 2 * hint
    parts = {"relevance": relevance, "entity": entity, "time": time, "provenance": provenance, "reliability": reliability}
    total = sum((parts[k] * w for k, w in list(WEIGHTS.items())[1:]), parts["relevance"] * WEIGHTS["relevance"])
    return hits.withColumn("rerank", total / sum(WEIGHTS.values()))
