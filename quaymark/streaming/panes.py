"""Late and out-of-order events: non-overlapping panes by event time, windows recomposed when a pane changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.session import remove_path


@dataclass(frozen=True)
class Lateness:
    """Seconds: length of a pane; how long after its end a pane first closes; how long after its end it still takes rows."""

    pane: int = 3600
    close: int = 300
    cutoff: int = 86_400


PHASES = ("on_time", "late", "refused")


def panes(events: DataFrame, keys: Sequence[str], at: str, arrived: str, sums: Sequence[str], rule: Lateness = Lateness()) -> DataFrame:
    """Totals per keys, pane (start in seconds since 1970 UTC) and phase of arrival.

    A pane is [start, start + rule.pane). on_time: arrived by its end plus `close`; late: after that, up to its end plus
    `cutoff`; refused: later. Rows without event time have no pane and are left out; rows without arrival time count as
    refused, as nothing proves that they came before the cut-off. Null keys form a group; null values add nothing.
    All of it is partially aggregated before the shuffle and a hot key's rows spread over its panes.
    """
    start = F.floor(F.unix_seconds(at) / rule.pane) * rule.pane
    lag = F.unix_micros(arrived) - (start + rule.pane) * 1_000_000
    phase = F.when(lag <= rule.close * 1_000_000, "on_time").when(lag <= rule.cutoff * 1_000_000, "late").otherwise("refused")
    return events.filter(F.col(at).isNotNull()).groupBy(*keys, start.alias("pane"), phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def windows(parts: DataFrame, keys: Sequence[str], sums: Sequence[str], rule: Lateness = Lateness(), width: int = 1, step: int = 1) -> DataFrame:
    """Windows of `width` panes starting every `step` panes, composed of pane totals.

    Columns: keys, period_start, first_n and first_<sum> (as first emitted, from on-time rows), n and <sum> (corrected by
    late rows), n_late, n_refused, corrected (a late row changed it). Only panes are aggregated again, never rows.
    """
    cover = F.sequence(F.lit(0), F.lit(width - 1))
    slots = F.filter(F.transform(cover, lambda i: F.col("pane") - i * rule.pane), lambda s: F.pmod(F.floor(s / rule.pane), F.lit(step)) == 0)
    rows = parts.withColumn("period_start", F.explode(slots) if (width, step) != (1, 1) else F.col("pane"))
    was = lambda phase: F.col("phase") == phase
    taken = F.col("phase") != "refused"
    out = rows.groupBy(*keys, "period_start").agg(
        F.sum(F.when(was("on_time"), F.col("n")).otherwise(0)).alias("first_n"),
        F.sum(F.when(taken, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(was("late"), F.col("n")).otherwise(0)).alias("n_late"),
        F.sum(F.when(was("refused"), F.col("n")).otherwise(0)).alias("n_refused"),
        *[x for c in sums for x in (F.sum(F.when(was("on_time"), F.col(f"sum_{c}"))).alias(f"first_{c}"), F.sum(F.when(taken, F.col(f"sum_{c}"))).alias(c))],
    )
    return out.withColumn("corrected", F.col("n_late") > 0)


class PaneStore:
    """Pane totals of a stream: each batch adds its own pane changes; windows over changed panes come out again.

    `merge` is made for foreachBatch. A batch's changes lie in their own folder, batch=<n>/slot=<s>, where a slot is a
    stretch of `slot` panes; a batch that runs again after a failure replaces its own changes and nothing counts twice. A
    merge reads the slots that its changed windows cover and composes those windows alone, however much is stored.
    `compact` folds old changes into fold=<n>; a fold counts as soon as it is whole, and then its batches count no more.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str], rule: Lateness = Lateness(), width: int = 1, step: int = 1, slot: int = 24):
        self.spark, self.path, self.keys, self.sums, self.rule, self.width, self.step = spark, path.rstrip("/"), list(keys), list(sums), rule, width, step
        self.slot_seconds = slot * rule.pane

    def _folders(self) -> tuple[int, list[str]]:
        """The number of the last whole fold (0 if none), and the folders that count."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(conf)
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        whole = [n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        number = lambda n: int(n.split("=")[1])
        fold = max([number(n) for n in whole if n.startswith("fold=")], default=0)
        return fold, [n for n in whole if n == f"fold={fold}" or n.startswith("batch=") and number(n) >= fold]

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys, "pane", "phase").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in self.sums])

    def _stored(self) -> DataFrame | None:
        out = None
        for name in self._folders()[1]:
            part = self.spark.read.parquet(f"{self.path}/{name}")
            out = part if out is None else out.unionByName(part)
        return out

    def state(self) -> DataFrame | None:
        stored = self._stored()
        return None if stored is None else self._sum(stored.drop("slot"))

    def _write(self, rows: DataFrame, folder: str) -> None:
        slotted = rows.withColumn("slot", F.floor(F.col("pane") / self.slot_seconds))
        slotted.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/{folder}")

    def merge(self, events: DataFrame, batch: int, at: str, arrived: str) -> DataFrame:
        """Adds a batch; the windows that cover a pane it changed, recomposed. Refused rows change no window."""
        if batch < self._folders()[0]:
            raise ValueError(f"batch {batch} was folded")
        changed = panes(events, self.keys, at, arrived, self.sums, self.rule)
        self._write(changed, f"batch={batch}")
        touched = self.spark.read.schema(changed.withColumn("slot", F.lit(0).cast("long")).schema).parquet(f"{self.path}/batch={batch}").filter("phase <> 'refused'")
        which = windows(touched, self.keys, self.sums, self.rule, self.width, self.step).select(*self.keys, "period_start")
        cover = which.select(*self.keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.col("period_start") + i * self.rule.pane)).alias("pane")).distinct()
        slots = [r[0] for r in cover.select(F.floor(F.col("pane") / self.slot_seconds).alias("slot")).distinct().collect()]  # stretches of time, not rows
        stored = self._stored()
        if stored is None:
            stored = touched
        near = self._match(self._sum(stored.filter(F.col("slot").isin(slots)).drop("slot")), cover, "pane")
        return self._match(windows(near, self.keys, self.sums, self.rule, self.width, self.step), which, "period_start")

    def _match(self, rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
        same = F.lit(True)
        for c in [*self.keys, column]:
            same = same & rows[c].eqNullSafe(wanted[c])
        return rows.join(wanted, same, "left_semi")

    def compact(self, upto: int, watermark: int | None = None) -> None:
        """Folds the changes of batches below `upto` into one folder; they can't be replayed after that.

        With a `watermark` (seconds since 1970 of which all later arrivals are known to be later) panes that no window
        still open covers are retired: they lie past the cut-off, so their windows came out for the last time.
        """
        fold, names = self._folders()
        old = [n for n in names if n.startswith("fold=") or int(n.split("=")[1]) < upto]
        if upto <= fold or not old:
            return
        rows = None
        for n in old:
            part = self.spark.read.parquet(f"{self.path}/{n}").drop("slot")
            rows = part if rows is None else rows.unionByName(part)
        if watermark is not None:
            rows = rows.filter(F.col("pane") + self.rule.pane * self.width + self.rule.cutoff >= watermark)
        self._write(self._sum(rows), f"fold={upto}")
        for n in old:  # the new fold is whole: what it replaces counts no more and may go at any time
            remove_path(self.spark, f"{self.path}/{n}")
