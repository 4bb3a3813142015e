"""Session factory and the few session-wide facts the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size in memory up to which a side may be broadcast, beyond which Spark shuffles both sides; how many times larger than
#: its Parquet files a table of unknown rows may be in memory.
BROADCAST_LIMIT_BYTES, PACKED = 64 << 20, 4


def build_session(app: str = "quaymark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `master` and partitions stay the cluster's own unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may fall back to a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quaymark-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/quaymark-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Best-effort removal of a scratch table; a stopped session leaves it to the folder's own clean-up."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def write_once(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> DataFrame:
    """Writes `df` and reads it back. Its shuffle files are of no more use then, and go as soon as it is written rather
    than when the driver happens to collect its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.mode(mode).options(**options).parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes once to the shared folder and reads back: lineage is cut, a lost executor loses nothing, sizes are known."""
    path = scratch_path(df.sparkSession, name)
    out = write_once(df, path, **options)
    out.scratch = path
    return out


def counted(df: DataFrame, name: str) -> DataFrame:
    """`materialise` that counts the rows as it writes them; the count is the attribute `rows_written`."""
    seen = Observation(name)
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    out.rows_written = seen.get["rows"]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables made by `materialise` that nothing reads any more."""
    for df in tables:
        if df is not None:
            remove_path(df.sparkSession, df.__dict__["scratch"])


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a materialised table that is the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory: 16 and 8 a column, 40 more for one of varying length."""
    return 16 + sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else 48 for f in df.schema.fields)


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES, rows: int | None = None) -> DataFrame:
    """`df` marked for broadcast if it takes at most `limit` in memory, else unmarked, so that Spark shuffles it.

    That is its rows, where they were counted or are given, times their width, and never less than the planned size.
    Where only the planned size is known it is taken as Parquet that unfolds PACKED times.
    """
    n, planned = rows if rows is not None else df.__dict__.get("rows_written"), planned_bytes(df)
    size = planned * PACKED if n is None else max(n * _row_bytes(df), planned if rows is None else 0)
    return F.broadcast(df) if size <= limit else df


def test_data(sf: str) -> str:
    return os.environ.get("QUAYMARK_TESTDATA", "/root/testdata") + f"/{sf}"
