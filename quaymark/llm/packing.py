"""Filling fixed-capacity containers: shortest-pack-first over the length histogram, then documents by rank."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quaymark.session import materialise, small_side

#: Sub-groups into which the documents of one length are cut for ranking, so that a common length is no single task.
RANK_PARTS = 64


@dataclass(frozen=True)
class Pattern:
    """`count` containers that each hold `items`: (length, how many)."""

    count: int
    items: tuple[tuple[int, int], ...]


def plan(histogram: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Packing patterns for `histogram` (length -> number of items, lengths 1 to capacity).

    Lengths go longest first. Each item goes to the open pack that is shortest so far and has room for it; if none has,
    a new pack is opened. Packs of equal content are one pattern with a count, so the work depends on the number of
    distinct lengths (at most `capacity`), not of documents.
    """
    open_packs: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, count: int, items: tuple[tuple[int, int], ...]) -> None:
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((count, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, items = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
                    rooms.pop()
                used = min(count, left)
                if used < count:
                    put(room, count - used, items)
                put(room - length, used, _with(items, length, 1))
                left -= used
            else:  # a new pack takes further items of this length until the next would not fit
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, full, ((length, each),))
                if rest := left % each:
                    put(capacity - rest * length, 1, ((length, rest),))
                left = 0
    return [Pattern(count, items) for room in sorted(open_packs) for count, items in open_packs[room] if count]


def _with(items: tuple[tuple[int, int], ...], length: int, n: int) -> tuple[tuple[int, int], ...]:
    if items and items[-1][0] == length:
        return (*items[:-1], (length, items[-1][1] + n))
    return (*items, (length, n))


@dataclass(frozen=True)
class Slots:
    """Where the k-th item of each length goes: runs of slots in one sequence over all lengths."""

    base: np.ndarray  # by length: the place of its first item in the sequence
    start: np.ndarray  # by run, rising: its first place in the sequence
    each: np.ndarray  # items of the length in one container of the run
    container: np.ndarray  # number of the run's first container
    offset: np.ndarray  # fill of the container before the run's items

    def locate(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[length] + rank
        run = np.searchsorted(self.start, place, "right") - 1
        within = place - self.start[run]
        return self.container[run] + within // self.each[run], self.offset[run] + within % self.each[run] * length


def lay_out(patterns: Sequence[Pattern], histogram: Mapping[int, int], capacity: int) -> Slots:
    base = np.zeros(capacity + 2, np.int64)
    for length in range(1, capacity + 1):
        base[length + 1] = base[length] + histogram.get(length, 0)
    at = base.copy()
    runs, container = [], 0
    for p in patterns:
        offset = 0
        for length, each in p.items:
            runs.append((int(at[length]), each, container, offset))
            at[length] += each * p.count
            offset += each * length
        container += p.count
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 4)
    return Slots(base, *(np.ascontiguousarray(columns[:, i]) for i in range(4)))


def pack(items: DataFrame, item: str, size: str, capacities: Sequence[int]) -> DataFrame:
    """One row per capacity and piece of an item: capacity, <item>, piece, piece_size, container_id, position.

    An item larger than the capacity is cut into full pieces, each alone in its container, and a rest that is packed
    like any other item; no other item is cut. Items of null or no size need no container. Items of one <item> value
    may repeat and each gets a place. An empty table gives an empty table. Containers are numbered from 0 per capacity.

    Only the length histogram (at most `capacity` numbers) reaches the driver; documents get their rank within their
    length from counts of sub-groups, so a length that a third of all documents has is no single task.
    """
    sized = materialise(items.filter(F.col(size) > 0).select(F.col(item).alias(item), F.col(size).cast("long").alias("__size")), "sizes")
    out = None
    for capacity in capacities:
        one = _pack_one(sized, item, int(capacity))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no capacity is given")
    return out


def _pack_one(sized: DataFrame, item: str, capacity: int) -> DataFrame:
    rest = F.col("__size") % capacity
    full = sized.filter(F.col("__size") >= capacity).select(F.col(item), F.floor(F.col("__size") / capacity).alias("__full"))
    packed = sized.filter(rest > 0).select(F.col(item), F.floor(F.col("__size") / capacity).cast("long").alias("piece"), rest.cast("int").alias("piece_size"))
    histogram = {r[0]: r[1] for r in packed.groupBy("piece_size").count().collect()}
    patterns = plan(histogram, capacity)
    slots = packed.sparkSession.sparkContext.broadcast(lay_out(patterns, histogram, capacity))
    first_full = sum(p.count for p in patterns)

    # rank within the length: rows before it in its sub-group, plus all rows of earlier sub-groups
    parted = packed.withColumn("__part", F.pmod(F.xxhash64(F.col(item), "piece"), F.lit(RANK_PARTS)).cast("int"))
    counts = parted.groupBy("piece_size", "__part").count()
    before = counts.select("piece_size", "__part", (F.sum("count").over(Window.partitionBy("piece_size").orderBy("__part")) - F.col("count")).alias("__before"))
    ranked = parted.withColumn("__rank", F.row_number().over(Window.partitionBy("piece_size", "__part").orderBy(item, "piece")) - 1)
    ranked = ranked.join(small_side(before, rows=len(histogram) * RANK_PARTS), ["piece_size", "__part"]).withColumn("__rank", (F.col("__rank") + F.col("__before")).cast("long"))
    placed = ranked.select(F.col(item), "piece", "piece_size", "__rank")
    schema = T.StructType([placed.schema[item], T.StructField("piece", T.LongType()), T.StructField("piece_size", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField("position", T.LongType())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                container, position = slots.value.locate(b.column("piece_size").to_numpy(), b.column("__rank").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(item), b.column("piece"), b.column("piece_size"), pa.array(container), pa.array(position)], names=schema.names)

    small = placed.mapInArrow(locate, schema)

    # full pieces: a container each, numbered by sub-group offsets in the same way
    grouped = full.withColumn("__part", F.pmod(F.xxhash64(item), F.lit(RANK_PARTS)).cast("int"))
    totals = grouped.groupBy("__part").agg(F.sum("__full").alias("__n"))
    starts = totals.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    run = F.sum("__full").over(Window.partitionBy("__part").orderBy(item).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__full")
    numbered = grouped.withColumn("__run", run).join(F.broadcast(starts), "__part")
    big = numbered.select(F.col(item), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)).alias("piece"), (F.lit(first_full) + F.col("__start") + F.col("__run")).alias("__c"))
    big = big.select(F.col(item), "piece", F.lit(capacity).alias("piece_size"), (F.col("__c") + F.col("piece")).alias("container_id"), F.lit(0).cast("long").alias("position"))
    return small.unionByName(big).select(F.lit(capacity).alias("capacity"), item, "piece", "piece_size", "container_id", "position")
