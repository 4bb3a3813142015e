"""The queries p7_ to p10_ over text, and their SQL where SQL can express them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.history import AcceptedIndex
from quaymark.llm.lookalike import look_classes, lookalike_pairs
from quaymark.llm.packing import pack
from quaymark.llm.tokens import encode_corpus
from quaymark.sources.tables import table

#: Rows a call takes at least: each UTC day is a batch, and days smaller than this are taken together with the next ones,
#: as a call has a fixed cost. Where the days are cut makes no difference to the result.
LEAST_ROWS = 40_000


def day_batches(rows: DataFrame, least: int) -> list[list[object]]:
    """The UTC days of first_seen_at in order, null last, in batches of at least `least` rows but the last."""
    days = rows.groupBy(F.to_date("first_seen_at").alias("day")).count().orderBy(F.col("day").asc_nulls_last()).collect()  # one row a day
    batches, held, n = [], [], 0
    for r in days:
        held, n = [*held, r["day"]], n + r["count"]
        if n >= least:
            batches.append(held)
            held, n = [], 0
    return [*batches, held] if held or not batches else batches


def repeats_by_day(spark: SparkSession, rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Every row with the accepted rows it repeats, batch by batch against the index of what was accepted before."""
    index, out, at = AcceptedIndex(spark), None, F.col("first_seen_at")
    for days in day_batches(rows, least):
        known = [d for d in days if d is not None]
        own = (at >= F.lit(known[0]).cast("timestamp")) & (at < F.lit(known[-1] + timedelta(days=1)).cast("timestamp")) if known else F.lit(False)
        found = index.take(rows.filter(own | at.isNull() if None in days else own))
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("uid_a").alias("evidence_uid_a"), F.col("uid_b").alias("evidence_uid_b"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats_by_day(spark, table(spark, folder, "evidence").select("evidence_uid", "document_uid", "revision_uid", "body", "first_seen_at"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents").select("doc_id", "text"))


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    specs = {r["spec_id"]: r["capacity"] for r in table(spark, folder, "container_specs").collect()}  # a table of fixed size
    sizes = encode_corpus(table(spark, folder, "documents").select("doc_id", "text"), ids="n_tokens", lengths_only=True)
    return pack(sizes, "doc_id", "n_tokens", sorted(set(specs.values())))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well containers are filled, by capacity: containers, the least that could hold all tokens, tokens, and the fill."""
    per = p9_packed(spark, folder).groupBy("capacity").agg(F.count_distinct("container_id").alias("containers"), F.sum("piece_size").alias("tokens"))
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return per.select("capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", F.round(fill, 6).alias("fill"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's class: the smallest doc_id that looks the same, and how many spellings the class has."""
    rows = look_classes(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    per = rows.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count_distinct("spelling").alias("n_spellings"), F.count(F.lit(1)).alias("n_docs"))
    return rows.join(per, "look").select("doc_id", "class_id", "n_spellings", "n_docs")


QUERIES = {f.__name__: f for f in (p7_found, p8_ids, p9_packed, p9_fill, p10_found, p10_classes)}
SQL: dict[str, str] = {}
