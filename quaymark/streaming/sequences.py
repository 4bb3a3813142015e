"""Sequence gaps of venue streams, late rows, and re-deliveries, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaymark.session import scratch_path

OUTPUT = "stream string, seq long, kind string, status string, withheld boolean"
STATE = "last long, open_gap boolean"


#: Rows of one frame handed back at a time.
PIECE = 100_000


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's frames come in chunks in no order, so all are gathered first: per frame, its arrival, a number and the code of
    its kind."""
    last, gap = state.get if state.exists else (None, False)
    names, seqs, codes, came = {}, [], [], []
    for pdf in frames:
        seqs.append(pdf["seq"].to_numpy("int64", na_value=-1) if pdf["seq"].dtype != "float64" else pdf["seq"].fillna(-1).to_numpy("int64"))
        came.append(pdf["arrived"].to_numpy("int64") if "arrived" in pdf else np.zeros(len(pdf), "int64"))
        code, kinds = pd.factorize(pdf["kind"], use_na_sentinel=False)
        codes.append(np.array([names.setdefault(None if pd.isna(k) else k, len(names)) for k in kinds], "int32")[code])
    seq, code = np.concatenate(seqs), np.concatenate(codes)
    kinds = np.array(list(names), object)
    rank = np.empty(len(kinds), "int32")
    rank[sorted(range(len(kinds)), key=lambda i: (kinds[i] is None, kinds[i] or ""))] = np.arange(len(kinds))
    order = np.lexsort((rank[code], seq, np.concatenate(came)))
    for start in range(0, len(seq), PIECE):
        at = order[start : start + PIECE]
        s, k = seq[at], kinds[code[at]]
        rows = []
        for number, kind in zip(s.tolist(), k.tolist()):
            if number < 0:
                rows.append((key[0], None, kind, "invalid", True))
                continue
            if last is not None and number <= last:
                rows.append((key[0], number, kind, "replay", True))
                continue
            status = "gap" if last is not None and number > last + 1 else "contiguous"
            gap = (gap or status == "gap") and kind != "snapshot"
            rows.append((key[0], number, kind, status, gap))
            last = number
        if start + PIECE >= len(seq):
            state.update((last, gap))
        yield pd.DataFrame(rows, columns=["stream", "seq", "kind", "status", "withheld"]).astype({"seq": "Int64"})


def sequence_states(frames: DataFrame) -> DataFrame:
    """Per stream and frame (stream, seq, kind): contiguous, gap, replay or invalid; after a gap frames are withheld until a
    full snapshot comes, which closes the gap. State is two values per stream. Frames of one stream and batch are taken in
    order of `arrived` (a long, never null) if there is such a column, then seq, whatever files and chunks they come in; a
    task holds twenty-odd bytes for each frame of the stream in the batch."""
    return frames.groupBy("stream").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Runs an aggregating stream over what is there; each batch writes the groups it changed, of which the last count."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*").select(*stream.columns)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, a single file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    return reader.parquet(f"{folder}/{name}.parquet") if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def split_late(stream: DataFrame, at: str, arrived: str, cutoff: str) -> DataFrame:
    """Adds admission: usable, or unavailable where the event or its arrival lies after the cut-off; nothing is dropped."""
    limit = F.lit(cutoff).cast("timestamp")
    return stream.withColumn("admission", F.when((F.col(at) <= limit) & (F.col(arrived) <= limit), "usable").otherwise("unavailable"))


def without_redeliveries(stream: DataFrame, uid: str, at: str, horizon: str) -> DataFrame:
    """One delivery of each uid among those within `horizon` of each other."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([uid])
