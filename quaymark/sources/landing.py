"""Landed files: canonical partitions, raw objects, ledgers, archives, frozen bundles, and sorted published tables.

Nothing here reads from a network: what connectors would fetch lies in a folder as text, JSON or bytes. Every loader keeps
what it refuses, with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.operators.asof import classify_append, ordered_reason
from quaymark.session import remove_path, write_once


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def resolve_files(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The files that the patterns name, in order and each once; a pattern that names none adds none."""
    out: dict[str, None] = {}
    for p in patterns:
        found = _files(spark, p).globStatus(_path(spark, p)) or []
        out |= dict.fromkeys(sorted(f.getPath().toString() for f in found))
    return list(out)


def canonical_line(columns: Sequence[str]) -> Column:
    """Canonical JSON of a row: keys sorted, no blanks, every value as text or null."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def load_canonical(spark: SparkSession, root: str, as_of: str, schema: T.StructType, uid: str, required: Sequence[str], arrival: Sequence[str], verified: DataFrame) -> DataFrame:
    """The rows of <root>/platform=/date=/ text partitions that exist at `as_of`, with status: decode_failed, schema_invalid
    (a required field missing or of another type), noncanonical (not the bytes its values give), raw_unverified (its
    raw_artifact_uid is not in `verified`), conflict (another meaning than the first of its uid), duplicate or loaded.

    Partitions after the day of `as_of` are pruned before any file is opened. Nothing is dropped.
    """
    lines = spark.read.format("text").schema("value string, platform string, date date").load(root).filter(F.col("date") <= F.lit(as_of).cast("date"))
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField("_bad", T.StringType())])
    read = lines.withColumn("r", F.from_json("value", text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    typed = read.select("value", "date", F.col("platform").alias("partition"), F.col("r._bad").alias("_bad"), *[F.col(f"r.{f.name}").alias(f"_{f.name}") for f in schema.fields], *[F.expr(f"try_cast(r.{f.name} AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields])
    wrong = F.lit(False)
    for f in schema.fields:
        wrong = wrong | (F.col(f"_{f.name}").isNotNull() & F.col(f.name).isNull())
    for c in required:
        wrong = wrong | F.col(f"_{c}").isNull()
    again = F.to_json(F.struct(*[F.col(f"_{c}").alias(c) for c in sorted(f.name for f in schema.fields)]), {"ignoreNullFields": "false"})
    known = verified.select(F.col("raw_artifact_uid").alias("_raw"), F.lit(True).alias("_verified")).distinct()
    joined = typed.join(known, F.col("raw_artifact_uid") == F.col("_raw"), "left")
    first = ordered_reason([("decode_failed", F.col("_bad").isNotNull() | F.col("value").isNull()), ("schema_invalid", wrong), ("noncanonical", again != F.col("value")), ("raw_unverified", F.col("_verified").isNull())], "readable")
    checked = joined.withColumn("status", first).select("partition", "date", "status", *[f.name for f in schema.fields])
    good = checked.filter("status = 'readable'").drop("status")
    taken = classify_append(good, None, uid, arrival, ["ingested_at", "raw_artifact_uid", "partition", "date"])
    taken = taken.withColumn("status", F.when(F.col("status") == "inserted", "loaded").otherwise(F.col("status")))
    return checked.filter("status <> 'readable'").unionByName(taken.select(*checked.columns))


def verified_objects(spark: SparkSession, root: str) -> DataFrame:
    """digest, bytes and ok of content-addressed objects below `root`: ok if the SHA-256 of the content is the file's name.
    Files are read where they lie, by Spark's binary source; their content never leaves the executors."""
    name = F.regexp_extract("path", r"([^/]+)\.raw$", 1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.raw").load(root).select(name.alias("digest"), F.col("length").alias("bytes"), (F.sha2("content", 256) == name).alias("ok"))


def store_objects(df: DataFrame, content: str, root: str) -> DataFrame:
    """Raw capture: each distinct content once as <root>/objects/<aa>/<sha256>.raw, a receipt for every row. Executors write
    their own objects; a task that runs again writes the same bytes under the same name. `root` must be shared."""
    hashed = df.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    objects = hashed.select("digest", F.col(content).cast("binary").alias("content")).dropDuplicates(["digest"])
    local = root.removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os
        import uuid

        for pdf in batches:
            for digest, content in zip(pdf["digest"], pdf["content"]):
                folder = f"{local}/objects/{digest[:2]}"
                os.makedirs(folder, exist_ok=True)
                whole, part = f"{folder}/{digest}.raw", f"{folder}/.{digest}-{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, whole)
            yield pdf[["digest"]]

    objects.mapInPandas(write, "digest string").write.format("noop").mode("overwrite").save()
    return write_once(hashed.drop(content), f"{root}/receipts", "overwrite")


COVERAGE = "source string, dataset string, start long, stop long, status string, record_count long, raw_sha256 array<string>"


def read_ledger(spark: SparkSession, path: str, source: str | None = None, dataset: str | None = None) -> DataFrame:
    """A JSON-lines coverage ledger, of one source or data set if given; lines that don't parse have status 'unreadable'."""
    rows = spark.read.schema(COVERAGE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("status", F.when(F.col("_bad").isNotNull() | (F.col("stop") < F.col("start")), "unreadable").otherwise(F.col("status"))).drop("_bad")
    for c, value in (("source", source), ("dataset", dataset)):
        rows = rows if value is None else rows.filter(F.col(c) == value)
    return rows


def write_bundle(parts: dict[str, DataFrame], root: str) -> None:
    """A frozen bundle: each part as canonical JSON lines, and checksums.sha256 with a digest of each (of its sorted lines,
    so that the number of files makes no difference)."""
    sums = []
    for name, df in parts.items():
        df.select(canonical_line(df.columns).alias("value")).write.mode("overwrite").text(f"{root}/{name}.jsonl")
        sums.append((name, bundle_digest(df.sparkSession, root, name)))
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(f"{d}  {n}.jsonl",) for n, d in sums], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/checksums.sha256")


def bundle_digest(spark: SparkSession, root: str, name: str) -> str:
    """A digest of a part's lines in any order: lines are hashed where they lie, their sums of 48 bits added up."""
    line = F.sha2("value", 256)
    halves = [F.sum(F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(5)]
    row = spark.read.text(f"{root}/{name}.jsonl").agg(F.count(F.lit(1)).alias("n"), *halves).first()
    return "-".join(str(x) for x in row)


def load_bundle(spark: SparkSession, root: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The parts of a bundle and the reasons against it: checksum_mismatch:<part>, part_missing:<part>, coverage_not_single."""
    sums = dict(reversed(r["value"].removesuffix(".jsonl").split("  ")) for r in spark.read.text(f"{root}/checksums.sha256").collect())  # one line a part
    parts, why = {}, []
    for name, schema in schemas.items():
        if not _files(spark, root).exists(_path(spark, f"{root}/{name}.jsonl")):
            why.append(f"part_missing:{name}")
            continue
        parts[name] = spark.read.schema(schema).json(f"{root}/{name}.jsonl")
        if sums.get(name) != bundle_digest(spark, root, name):
            why.append(f"checksum_mismatch:{name}")
    if "coverage" in parts and parts["coverage"].count() != 1:
        why.append("coverage_not_single")
    return parts, sorted(why)


def publish(df: DataFrame, root: str, version: str) -> None:
    """Writes <root>/versions/<version> as a whole, then moves the pointer: readers see the old or the new one."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    digest = df.sparkSession.read.parquet(f"{root}/versions/{version}").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    pointer = json.dumps({"version": version, "rows": digest["n"], "hash": str(digest["h"])}, sort_keys=True)
    files, temporary, current = _files(spark, root), _path(spark, f"{root}/.current-{version}"), _path(spark, f"{root}/current")
    out = files.create(temporary, True)
    out.write(bytearray(pointer.encode()))
    out.close()
    files.delete(current, False)
    files.rename(temporary, current)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The published version, checked against the pointer's row count and hash."""
    line = spark.read.text(f"{root}/current").first()["value"]
    pointer = json.loads(line)
    df = spark.read.parquet(f"{root}/versions/{pointer['version']}")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    if (found["n"], str(found["h"])) != (pointer["rows"], pointer["hash"]):
        raise ValueError(f"version {pointer['version']} is not what was published")
    return df


def write_sorted(df: DataFrame, order: Sequence[str], root: str, name: str, codec: str = "zstd") -> DataFrame:
    """Range-partitioned and sorted by `order`, so files and row groups carry narrow statistics; written to staging/ and
    renamed to published/ as a whole."""
    spark, staging, target = df.sparkSession, f"{root}/staging/{name}", f"{root}/published/{name}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", codec).parquet(staging)
    files = _files(spark, root)
    files.mkdirs(_path(spark, f"{root}/published"))
    remove_path(spark, target)
    files.rename(_path(spark, staging), _path(spark, target))
    return spark.read.schema(df.schema).parquet(target)


LOG = "block_number long, log_index long, address string, topics array<string>, data string, transaction_hash string"


def decode_logs(logs: DataFrame, contracts: Sequence[str], topic: str) -> DataFrame:
    """On-chain fill logs of allowed contracts: status decoded, or the reason that refuses them; nothing is defaulted.

    data: five 32-byte words (maker asset, taker asset, maker amount, taker amount, fee). One of the assets must be zero:
    it is the money side, so its maker sells or buys the other asset. Amounts are read if they fit 64 bits.
    """
    word = lambda i: F.substring(F.lower("data"), 3 + 64 * i, 64)
    number = lambda w: F.when(F.substring(w, 1, 48) == "0" * 48, F.conv(F.substring(w, 49, 16), 16, 10).cast("decimal(20,0)"))
    zero = lambda i: word(i) == "0" * 64
    person = lambda i: F.when(F.lower(F.get("topics", F.lit(i))).rlike("^0x0{24}[0-9a-f]{40}$"), F.concat(F.lit("0x"), F.substring(F.lower(F.get("topics", F.lit(i))), 27, 40)))
    status = ordered_reason(
        [("contract_not_allowed", ~F.lower("address").isin(*[c.lower() for c in contracts])), ("topic_unknown", F.coalesce(F.lower(F.get("topics", F.lit(0))) != topic.lower(), F.lit(True))), ("topics_malformed", person(2).isNull() | person(3).isNull()), ("data_malformed", ~F.coalesce(F.col("data").rlike("^0x([0-9a-fA-F]{64}){5}$"), F.lit(False))), ("assets_ambiguous", zero(0) == zero(1)), ("amount_out_of_range", number(word(2)).isNull() | number(word(3)).isNull()), ("amount_zero", (number(word(2)) == 0) | (number(word(3)) == 0))], "decoded"
    )
    out = logs.withColumn("status", status)
    ok = F.col("status") == "decoded"
    money, goods = F.when(zero(0), number(word(2))).otherwise(number(word(3))), F.when(zero(0), number(word(3))).otherwise(number(word(2)))
    return out.select("block_number", "log_index", "transaction_hash", "status", F.when(ok, person(2)).alias("maker"), F.when(ok, person(3)).alias("taker"), F.when(ok, F.when(zero(0), "BUY").otherwise("SELL")).alias("side"), F.when(ok, money).alias("money"), F.when(ok, goods).alias("quantity"), F.when(ok, F.when(zero(0), word(1)).otherwise(word(0))).alias("asset"))
