"""Hash-chained ledgers and label registries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64


def chain(payloads: list[str], previous: str = GENESIS, sequence: int = 0) -> list[tuple[int, str, str, str]]:
    """(sequence, payload, previous_hash, entry_hash) of entries to append. A chain is serial by definition; an append is a
    small batch of the driver's own records."""
    out = []
    for i, payload in enumerate(payloads, sequence):
        digest = hashlib.sha256(f"{i}|{previous}|{payload}".encode()).hexdigest()
        out.append((i, payload, previous, digest))
        previous = digest
    return out


def verify(ledger: DataFrame, parts: int = 1_000_000) -> DataFrame:
    """Entries that break the chain, with the reasons: hash_wrong, link_broken, sequence_gap. Each entry is checked against
    its own hash where it lies and against its predecessor by an equi-join on the sequence: no global sort."""
    own = F.sha2(F.concat_ws("|", "sequence", "previous_hash", "payload"), 256)
    before = ledger.select((F.col("sequence") + 1).alias("sequence"), F.col("entry_hash").alias("__before"))
    both = ledger.join(before, "sequence", "left")
    first = F.col("sequence") == 0
    why = F.array_compact(F.array(F.when(own != F.col("entry_hash"), "hash_wrong"), F.when(F.col("previous_hash") != F.when(first, GENESIS).otherwise(F.col("__before")), "link_broken"), F.when(~first & F.col("__before").isNull(), "sequence_gap")))
    return both.select("sequence", why.alias("reasons")).filter(F.size("reasons") > 0)


def current_labels(adjudications: DataFrame) -> DataFrame:
    """Adjudications that no other supersedes."""
    return adjudications.join(adjudications.select(F.col("supersedes_uid").alias("uid")), "uid", "left_anti")


def registry_violations(adjudications: DataFrame) -> DataFrame:
    """uid and reason: a repeated uid, more than one direct successor, a successor of another case."""
    twice = adjudications.groupBy("uid").count().filter("count > 1").select("uid", F.lit("repeated_uid").alias("reason"))
    fork = adjudications.filter("supersedes_uid is not null").groupBy(F.col("supersedes_uid").alias("uid")).count().filter("count > 1").select("uid", F.lit("two_successors").alias("reason"))
    old = adjudications.select(F.col("uid").alias("supersedes_uid"), F.col("case_uid").alias("old_case"))
    moved = adjudications.join(old, "supersedes_uid").filter("case_uid <> old_case").select("uid", F.lit("case_changed").alias("reason"))
    return twice.unionByName(fork).unionByName(moved)
