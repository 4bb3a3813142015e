"""Deduplicating new batches against all history: an incremental inverted index of rare-gram prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quaymark.session import counted, discard, materialise, scratch_path, small_side, write_once

#: Cells of the frozen frequency sketch that orders grams from rare to frequent: 1 MB, whatever the corpus.
SKETCH_CELLS = 1 << 18
#: Pairs of postings that one pass within a batch may compare; a batch that would meet more is taken in parts.
PAIRS_AT_ONCE = 400_000_000
#: Stored postings of one gram that one task may hold; a gram with more is split into blocks of them.
HOT_POSTINGS = 1_000_000
#: Values up to which a look-up goes into the scan of the stored tables, and up to which its values are broadcast (8 to
#: 16 bytes each, some 200 MB in memory at most).
FEW_VALUES, BROADCAST_VALUES = 1_000, 4_000_000
#: Stored postings lie in 2^BUCKET_BITS ranges of grams; all stored tables are sorted, in pages of PAGE_ROWS rows.
BUCKET_BITS, PAGE_ROWS = 4, 1_024
#: Key rows of a batch whose acceptance one task may settle in turn; more of them are settled in distributed rounds.
SETTLE_AT_ONCE = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, regardless of case, with a space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def edits(a: list[str], b: list[str]) -> int:
    """Words to insert, delete or replace to get from `a` to `b`, by bit-vectors over the words of `a`."""
    same = 0
    for x, y in zip(a, b):  # equal beginnings and ends need no edit
        if x != y:
            break
        same += 1
    a, b, same = a[same:], b[same:], 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        same += 1
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) > len(b):
        a, b = b, a
    size = len(a)
    if not size:
        return len(b)
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, distance = full, 0, size
    for word in b:
        hit = where.get(word, 0)
        diagonal = (((hit & plus) + plus) ^ plus) | hit | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
    return distance


def codes(tokens: Column) -> Column:
    """64-bit codes of words, made in the JVM: what grams and sketches are computed from. Verification compares the words."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column as one array, and the lengths of its lists."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(column.offsets.to_numpy())


def _grams(words_: np.ndarray) -> np.ndarray:
    """Codes of each two neighbouring words of a flat array; those across two texts mean nothing."""
    with np.errstate(over="ignore"):
        two = (words_[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((words_[1:] << np.uint64(1)) + np.uint64(0x632BE59BD9B4E019))
        two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return two ^ (two >> np.uint64(32))


@lru_cache(1 << 16)
def spoilable(size: int, pairs: int) -> int:
    """How many grams of a text of `size` words the edits allowed can spoil at most, if `pairs` of them lie next to each
    other. A quarter of the longer text's words may change; a word replaced or deleted spoils two neighbouring grams, a
    word inserted one, and a partner of L words takes L - size insertions at least. The most is at the L where insertions
    leave just as many other edits as there are pairs, or next to it."""
    longest, best = max(size, size * 4 // 3), (size - pairs) * 4 // 3
    span = range(max(size, min(best, longest) - 8), min(longest, max(best, size) + 8) + 1)
    return max(n // 4 + min(n // 4 - (n - size), pairs) for n in span)


def prefix_length(places: list[int], size: int) -> int:
    """The grams of a text of `size` words, rare ones first at `places`, that must be indexed so that any text within a
    quarter shares at least one: the first that edits can't spoil altogether. Grams apart from each other take an edit each."""
    runs: dict[int, int] = {}
    pairs, least = 0, size // 3
    for m, p in enumerate(places, 1):
        left, right = runs.get(p - 1, 0), runs.get(p + 1, 0)
        both = left + right + 1
        runs[p - left] = runs[p + right] = both
        pairs += both // 2 - left // 2 - right // 2
        if m > least and m > spoilable(size, pairs):
            return m
    return len(places)


#: place: size << 32 | place of the gram << 2 | copy in a further block << 1 | accepted before. doc: hash of the one document
#: that has the text, 0 if several have. s0 to s3: a 256-bit sketch of the text's words.
POSTING = "gram long, id long, doc long, place long, s0 long, s1 long, s2 long, s3 long"
SKETCH = ("s0", "s1", "s2", "s3")
OLD, COPY = 1, 2


def postings(bodies: DataFrame, sketch: np.ndarray) -> DataFrame:
    """A posting for each gram of the rare prefix of each body (columns id, doc, codes)."""
    shared = bodies.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = _flat(b.column("codes"))
            if len(flat) < 2:
                continue
            start = np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(len(sizes)), sizes)
            mask = np.zeros((len(sizes), 4), np.uint64)
            np.bitwise_or.at(mask, (text, (flat >> np.uint64(8)) & np.uint64(3)), np.uint64(1) << (flat & np.uint64(63)))
            two, own = _grams(flat), text[:-1]
            inside = own == text[1:]
            at = (np.arange(len(two)) - start[own])[inside]
            two, own = two[inside], own[inside]
            seldom = np.minimum(shared.value[two >> np.uint64(46)], (1 << 40) - 1)
            order = np.lexsort((two, own << 40 | seldom))  # by text, rare first; stable, so equal grams stay in place
            ends = np.searchsorted(own[order], np.arange(len(sizes) + 1))
            rare, of_text = at[order].tolist(), ends.tolist()
            last = [i + prefix_length(rare[i:j], int(n)) for i, j, n in zip(of_text, of_text[1:], sizes)]
            turn = np.cumsum(np.concatenate([[False], (two[order][1:] != two[order][:-1]) | (own[order][1:] != own[order][:-1])])) if len(order) else np.zeros(0, int)
            final = np.array([turn[j - 1] if j > i else -1 for i, j in zip(of_text, last)])  # a gram stands in a prefix with all its places
            order = order[turn <= final[own[order]]]
            of = own[order]
            place = sizes[of].astype(np.int64) << 32 | at[order] << 2
            ids, doc = b.column("id").to_numpy(), b.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(two[order].view(np.int64)), pa.array(ids[of]), pa.array(doc[of]), pa.array(place), *[pa.array(mask[of, i].view(np.int64)) for i in range(4)]], names=["gram", "id", "doc", "place", *SKETCH])

    return bodies.select("id", "doc", "codes").mapInArrow(run, POSTING)


def _rank(groups: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal neighbours."""
    first = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))


def frequency_sketch(bodies: DataFrame) -> DataFrame:
    """How many grams of the first batch fall into each cell. It only orders grams, from rare to frequent, and is frozen
    with the index, since all prefixes must follow one order; cells it never met count as rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_CELLS, np.int64)
        for b in batches:
            flat, sizes = _flat(b.column("codes"))
            if len(flat) > 1:
                text = np.repeat(np.arange(len(sizes)), sizes)
                total += np.bincount((_grams(flat)[text[:-1] == text[1:]] >> np.uint64(46)).astype(np.int64), minlength=SKETCH_CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    return bodies.select("codes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def read_sketch(cells: DataFrame) -> np.ndarray:
    """The sketch as an array; it has at most SKETCH_CELLS rows."""
    rows, sketch = cells.toPandas(), np.zeros(SKETCH_CELLS, np.int64)
    sketch[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return sketch


#: Runs of one gram up to this length are compared offset by offset over all runs at once, longer ones run by run.
SHORT_RUN = 2048


def _near(left: np.ndarray, right: np.ndarray, size: np.ndarray, lean: np.ndarray, doc: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which pairs of postings (indices) pass the cheap bounds, cheapest first. With s the shift of the gram and g the gap in
    size, |s| + |g - s| edits are needed before and after it: the larger of |g| and |2 s - g|, the latter the difference in
    `lean`, 2 * place - size."""
    n, m = size[left], size[right]
    k, gap = np.maximum(n, m) >> 2, np.abs(n - m)
    keep = np.flatnonzero((np.abs(lean[left] - lean[right]) <= k) & (gap <= k))
    own = doc[left[keep]]
    keep = keep[(own != doc[right[keep]]) | (own == 0)]
    room = 2 * k[keep] - gap[keep]
    apart = np.bitwise_count(bits[left[keep]] ^ bits[right[keep]]).sum(axis=1, dtype=np.int64)
    return keep[apart <= room]


def _pairs_of_runs(gram: np.ndarray, ids: np.ndarray, place: np.ndarray, doc: np.ndarray, bits: np.ndarray, within: bool) -> np.ndarray:
    """Id pairs (other, new) of postings with an equal gram, sorted by gram with those accepted before first; one of each
    pair is new, and both only if `within`."""
    rank = _rank(gram)
    fresh = (place & OLD) == 0
    start = np.arange(len(gram)) - rank
    length = np.bincount(start, minlength=len(gram))[start]
    known, dense = np.unique(ids, return_inverse=True)
    size = (place >> 32).astype(np.int32)
    lean = 2 * ((place & 0xFFFFFFFF) >> 2).astype(np.int32) - size
    every = within and not (place & COPY).any()
    out = [np.zeros(0, np.int64)]

    def take(left: np.ndarray, right: np.ndarray) -> None:
        if not every:
            ok = ~fresh[left] | (within & ((place[right] & COPY) == 0))
            left, right = left[ok], right[ok]
        hit = _near(left, right, size, lean, doc, bits)
        if len(hit):
            out.append(np.unique(dense[left[hit]] * len(known) + dense[right[hit]]))

    right = np.flatnonzero(fresh & (length <= SHORT_RUN) & (rank > 0))
    d = 1
    while len(right):
        take(right - d, right)
        d += 1
        right = right[rank[right] >= d]
    for i in np.flatnonzero(fresh & (length > SHORT_RUN) & (rank > 0)):
        take(np.arange(start[i], i), np.full(rank[i], i))
    pairs = np.unique(np.concatenate(out))
    return np.stack([known[pairs // max(1, len(known))], known[pairs % max(1, len(known))]], 1)


def candidates(new: DataFrame, old: DataFrame | None, within: bool, hot: DataFrame | None = None, block: int = HOT_POSTINGS) -> DataFrame:
    """Distinct pairs (id_a, id_b) of a text of `old` (or, `within`, of `new`) and one of `new` that share a prefix gram and
    pass the cheap bounds.

    With k = a quarter of the longer text: the shared gram's places leave room for k edits before and after it, which
    bounds the lengths too; word sets differ by at most 2 k less the difference in length. Two texts that one and the
    same document alone has are no pair, since revisions of a document don't repeat each other. Postings are brought
    together by gram and compared as arrays; a task holds the postings of one gram at a time. The old postings of the
    grams in `hot` (gram, n) are spread over blocks of about `block` each, and each block meets all new ones.
    """
    if old is None:
        both = new
    else:
        old = old.withColumn("place", F.col("place").bitwiseOR(F.lit(OLD)))
        if hot is not None:
            blocks = small_side(hot.select("gram", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
            mixed = F.when(F.col("__block") == 0, F.col("gram")).otherwise(F.xxhash64("gram", "__block"))
            copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
            new = new.join(blocks, "gram", "left").withColumn("__block", copies).withColumn("place", F.col("place").bitwiseOR(F.when(F.col("__block") > 0, COPY).otherwise(0)))
            old = old.join(blocks, "gram", "left").withColumn("__block", F.pmod(F.xxhash64("id"), F.coalesce(F.col("blocks"), F.lit(1))).cast("int"))
            new, old = (df.withColumn("gram", mixed).drop("blocks", "__block") for df in (new, old))
        both = new.unionByName(old)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, 200_000

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, enough
            t = pa.Table.from_batches(held).combine_chunks()
            gram = t.column("gram").to_numpy()
            stop = len(gram) if last else int(np.searchsorted(gram, gram[-1], "left"))  # the last gram may go on
            part = t.slice(0, stop)
            if stop:
                names = [*SKETCH, "id", "place", "doc"]
                column = {c: part.column(c).to_numpy() for c in names}
                if (column["place"] & OLD).any():  # those accepted before come first of their gram
                    order = np.lexsort((~column["place"] & OLD, gram[:stop]))
                    column = {c: v[order] for c, v in column.items()}
                bits = np.stack([column[c] for c in SKETCH], 1).view(np.uint64)
                found = _pairs_of_runs(gram[:stop], column["id"], column["place"], column["doc"], bits, within)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id_a", "id_b"])
            held[:] = t.slice(stop).to_batches()
            rows = len(gram) - stop
            enough = max(200_000, 2 * rows)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= enough:
                    yield from flush(False)
        if held:
            yield from flush(True)

    together = both.repartition("gram").sortWithinPartitions("gram")
    return together.mapInArrow(run, "id_a long, id_b long").distinct()


def _within_quarter(a: list[str], b: list[str]) -> bool:
    k, x, y = max(len(a), len(b)) // 4, set(a), set(b)
    if len(x - y) > k or len(y - x) > k:  # each word that the other lacks is an edit
        return False
    return edits(a, b) <= k


@F.arrow_udf(T.BooleanType())
def near_equal(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_within_quarter(x.split(" "), y.split(" ")) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _sole(column: str) -> Column:
    """The one value of a group, null if there are several."""
    return F.when(F.min(column) == F.max(column), F.min(column))


@dataclass(frozen=True)
class Fields:
    uid: str = "evidence_uid"
    document: str = "document_uid"
    revision: str = "revision_uid"
    body: str = "body"
    at: str = "first_seen_at"


REVISION, BODY = 0, 1  # kinds of keys under which rows repeat each other
KEYED = ("cid", "uid", "turn", "document", "kind", "key")
STORED = {"postings": "gram", "bodies": "id", "keys": "key"}


class AcceptedIndex:
    """What was accepted so far, and an inverted index of its bodies.

    Folder: postings/ (the rare-gram prefix of each accepted body, in buckets of grams), bodies/ (their words by id), keys/
    (accepted rows by revision and by body). Each is sorted by what it is looked up by, in small pages. Every batch appends
    its own part and nothing is rewritten; a batch reads what its own grams, keys and ids name (`_lookup`) and moves none
    of the history. The gram order is frozen when the first batch comes.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fields: Fields = Fields(), pairs_at_once: int = PAIRS_AT_ONCE, hot_postings: int = HOT_POSTINGS, settle_at_once: int = SETTLE_AT_ONCE):
        self.spark, self.path, self.fields = spark, (path or scratch_path(spark, "accepted")).rstrip("/"), fields
        self.limit, self.hot, self.at_once = pairs_at_once, hot_postings, settle_at_once
        self.parts, self.sketch, self.schemas = 0, None, {}
        if self._exists("sketch"):  # an index of an earlier session goes on
            self.sketch = read_sketch(spark.read.parquet(f"{self.path}/sketch"))
            while self._exists(f"keys/part={self.parts}/_SUCCESS"):  # the last that a batch writes
                self.parts += 1
            self.schemas = {n: spark.read.parquet(f"{self.path}/{n}/part=0").schema for n in STORED} if self.parts else {}

    def _exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.path}/{name}/part={i}" for i in range(self.parts)])

    def _append(self, name: str, df: DataFrame) -> DataFrame:
        """Writes this batch's part as a whole; what a batch that failed left there is replaced."""
        self.schemas[name] = df.schema
        pages = {"parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "false", "compression": "zstd" if name == "bodies" else "lz4_raw"}
        return write_once(df.sortWithinPartitions(STORED[name]), f"{self.path}/{name}/part={self.parts}", "overwrite", **pages)

    @contextmanager
    def _pushing(self) -> Iterator[None]:
        """Lets Parquet skip pages by lists of up to FEW_VALUES values."""
        key = "spark.sql.parquet.pushdown.inFilterThreshold"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, str(FEW_VALUES))
        try:
            yield
        finally:
            self.spark.conf.set(key, before) if before is not None else self.spark.conf.unset(key)

    def _lookup(self, name: str, wanted: DataFrame, n: int) -> DataFrame:
        """The stored rows named by `wanted`, one column of at most `n` rows.

        A few values go into the scan, which skips the files, row groups and pages without them; more are broadcast and
        the history is filtered where it lies; beyond that both sides are shuffled, and Spark filters the larger one by
        a Bloom filter of the smaller first.
        """
        stored, column = self._stored(name), STORED[name]
        if n <= FEW_VALUES:
            values = [r[0] for r in wanted.distinct().collect()]  # at most FEW_VALUES
            return stored.filter(F.col(column).isin(values)) if values else stored.filter(F.lit(False))
        return stored.join(F.broadcast(wanted) if n <= BROADCAST_VALUES else wanted, column, "left_semi")

    def take(self, batch: DataFrame) -> DataFrame:
        """Takes a batch whose rows all come after those taken before; returns (uid_a, uid_b), smaller first: each row
        with every accepted row that it repeats.

        Rows are taken by time, then uid; where the batch is cut makes no difference. A row repeats an accepted row of
        its revision, or of another document with a near-equal body; it is accepted if it repeats none. Rows without
        uid are left out; rows without time come last; a null revision or document equals no other; a body without
        words is near nothing. Whole repeated rows (equal uid) count once.
        """
        f = self.fields
        digest = lambda c: F.unhex(F.md5(F.col(c).cast("string")))
        rows = batch.filter(F.col(f.uid).isNotNull()).select(
            F.col(f.uid).alias("uid"), digest(f.document).alias("document"), digest(f.revision).alias("revision"), F.struct(F.col(f.at).isNull().alias("late"), F.col(f.at).alias("at"), F.col(f.uid).alias("uid")).alias("turn"), words(F.coalesce(F.col(f.body), F.lit(""))).alias("words")
        )
        rows = rows.withColumn("body", F.when(F.col("words") != "", F.unhex(F.md5("words"))))
        # Rows alike in revision, document and body are a class: only its first row can be accepted.
        own = F.concat_ws("/", F.coalesce(F.hex("revision"), F.concat(F.lit("~"), F.col("uid"))), F.coalesce(F.hex("document"), F.lit("")), F.coalesce(F.hex("body"), F.lit("")))
        whole = materialise(rows.withColumn("cid", F.unhex(F.md5(own))), "batch", compression="zstd")
        out = []
        with self._pushing():
            while whole is not None:
                part, whole = self._next(whole)
                out.append(part)
        pairs = out[0]
        for p in out[1:]:
            pairs = pairs.unionByName(p)
        low, high = F.least("uid", "uid_b"), F.greatest("uid", "uid_b")
        return pairs.select(low.alias("uid_a"), high.alias("uid_b")).distinct()

    def _next(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Takes `rows`, or an earlier part of them if too many would meet; its pairs, and the rows that are left."""
        firsts = counted(rows.groupBy("cid").agg(F.min("turn").alias("turn"), *[F.first(c).alias(c) for c in ("revision", "document", "body")], F.count(F.lit(1)).alias("n")).withColumn("uid", F.col("turn.uid")), "firsts")
        number = F.monotonically_increasing_id() + F.lit(self.parts).cast("long") * (1 << 48)
        texts = rows.filter("body is not null").groupBy("body").agg(F.first("words").alias("words"), _sole("document").alias("document"))
        bodies = materialise(texts.withColumn("id", number), "bodies", compression="zstd")
        coded = bodies.select("id", F.when(F.col("document").isNull(), F.lit(0)).otherwise(F.xxhash64("document")).alias("doc"), codes(F.split("words", " ")).alias("codes"))
        if self.sketch is None:
            frequency_sketch(coded).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sketch")
            self.sketch = read_sketch(self.spark.read.parquet(f"{self.path}/sketch"))
        marks = materialise(postings(coded, self.sketch), "postings", **{f"parquet.enable.dictionary#{c}": "false" for c in ("gram", "place")})
        n_marks, share, crowded = self._share(marks)
        old = self._lookup("postings", marks.select("gram"), n_marks) if self.parts else None
        hot = materialise(old.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.hot), "hot") if crowded else None

        # One pass over old and new where few new ones meet; else the old ones first, so that what repeats them is out.
        late_marks = None
        if share == 1:
            rows, whole = materialise(rows.select("uid", "turn", "cid"), "rows"), rows
            discard(whole)  # the words are in bodies
            near = self._near(candidates(marks, old, True, hot, self.hot), bodies, self.parts > 0)
        else:
            near, live = None, firsts
            if self.parts:
                near = self._near(candidates(marks, old, False, hot, self.hot), bodies, True)
                live = firsts.join(self._known(firsts, self._reach(self._company(firsts, near), near)).select("cid").distinct(), "cid", "left_anti")
            living = materialise(live.filter("body is not null").select("body").distinct().join(bodies.select("body", "id"), "body"), "living")
            live_marks = materialise(marks.join(small_side(living.select("id")), "id", "left_semi"), "live")
            _, share, _ = self._share(live_marks)
            head, tail = self._cut(rows, share) if share < 1 else (None, None)
            if head is not None:
                discard(rows, firsts, bodies, marks, hot, near, living, live_marks)
                pairs, more = self._next(head)
                return pairs, tail if more is None else materialise(more.unionByName(tail), "rest", compression="zstd")
            own = self._near(candidates(live_marks, None, True), bodies, False)
            near = own if near is None else materialise(near.unionByName(own), "near")
            late_marks = marks.join(small_side(living.select("id")), "id", "left_anti")

        met = self._company(firsts, near)
        reach = self._reach(met, near)
        known = materialise(self._known(firsts, reach), "known") if self.parts else None
        out = self._refused(met, reach, known)
        accepted = firsts.join(small_side(out), "cid", "left_anti")

        added = bodies.join(small_side(accepted.filter("body is not null").select("body")), "body", "left_semi")
        added = self._append("bodies", added.select("id", "body", "words", "document"))
        fresh = marks.join(small_side(added.select("id")), "id", "left_semi")
        added_marks = self._append("postings", fresh.repartition(F.shiftrightunsigned("gram", 64 - BUCKET_BITS)))
        stored = self._append("keys", self._keys(accepted).select(*KEYED))
        if late_marks is None:
            winners = met.join(small_side(out), "cid", "left_anti")
        else:  # what repeats older rows may repeat new ones as well
            more = self._near(candidates(late_marks, added_marks, False), bodies, False)
            near, winners = materialise(near.unionByName(more), "near"), stored
            met = self._company(firsts, near)
            reach = self._reach(met, near)
        partners = self._related(met.unionByName(reach), winners)
        partners = materialise(partners if known is None else partners.unionByName(known), "partners")
        pairs = rows.select("uid", "turn", "cid").join(small_side(partners), "cid").filter("turn_b < turn")
        pairs = materialise(pairs.select("uid", "uid_b"), "pairs")
        discard(rows, firsts, bodies, marks, hot, near, met, reach, known, out, partners)
        self.parts += 1
        return pairs, None

    @staticmethod
    def _keys(rows: DataFrame) -> DataFrame:
        """Each row under its revision and under its body, null ones left out."""
        both = F.inline(F.array(F.struct(F.lit(REVISION).alias("kind"), F.col("revision").alias("key")), F.struct(F.lit(BODY).alias("kind"), F.col("body").alias("key"))))
        return rows.select("cid", "uid", "turn", "document", "n", both).filter("key is not null")

    @staticmethod
    def _reach(met: DataFrame, near: DataFrame) -> DataFrame:
        """The rows of `met` under the bodies that their own are near to."""
        own = met.filter(F.col("kind") == BODY).withColumnRenamed("key", "body_a")
        return counted(own.join(small_side(near), "body_a").select("cid", "uid", "turn", "document", "kind", F.col("body_b").alias("key")), "reach")

    def _company(self, firsts: DataFrame, near: DataFrame) -> DataFrame:
        """The keys that several rows of the batch have or are near to, with their rows: acceptance is open for these alone."""
        keys = self._keys(firsts)
        crowd = keys.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n > 1").select("kind", "key")
        touched = near.select(F.lit(BODY).alias("kind"), F.explode(F.array("body_a", "body_b")).alias("key"))
        crowd = materialise(crowd.unionByName(touched).distinct(), "crowd")
        return counted(keys.join(small_side(crowd), ["kind", "key"], "left_semi").select(*KEYED), "met")

    @staticmethod
    def _related(rows: DataFrame, accepted: DataFrame) -> DataFrame:
        """cid, uid_b, turn_b: each class with the accepted rows of its keys that it repeats; equal turns are its own."""
        other = accepted.select("kind", "key", F.col("uid").alias("uid_b"), F.col("turn").alias("turn_b"), F.col("document").alias("document_b"))
        return rows.join(other, ["kind", "key"]).filter((F.col("kind") == REVISION) | (F.col("document") != F.col("document_b"))).select("cid", "uid_b", "turn_b").distinct()

    def _known(self, firsts: DataFrame, reach: DataFrame) -> DataFrame:
        """The classes that repeat rows accepted in earlier batches, with those."""
        asked = self._keys(firsts).select(*KEYED).unionByName(reach)
        n = 2 * firsts.rows_written + reach.rows_written
        return self._related(small_side(asked, rows=n), self._lookup("keys", asked.select("key"), n) if n <= FEW_VALUES else self._stored("keys"))

    def _near(self, pairs: DataFrame, bodies: DataFrame, old: bool) -> DataFrame:
        """(body_a, body_b), both ways, of the pairs whose texts really are within a quarter; words are fetched for them alone."""
        met = counted(pairs, "pairs")
        known = bodies.select("id", "body", "words")
        if old:
            known = known.unionByName(self._lookup("bodies", met.select(F.col("id_a").alias("id")), met.rows_written).select("id", "body", "words"))
        side = lambda df, x: df.select(F.col("id").alias(f"id_{x}"), F.col("body").alias(f"body_{x}"), F.col("words").alias(f"words_{x}"))
        few = small_side(met)
        left = side(known, "a").join(few, "id_a")
        right = side(bodies, "b").join(F.broadcast(met.select("id_b")) if few is not met else met.select("id_b"), "id_b", "left_semi")
        sure = left.join(right, "id_b").filter(near_equal("words_a", "words_b"))
        both = F.inline(F.array(F.struct("body_a", "body_b"), F.struct(F.col("body_b").alias("body_a"), F.col("body_a").alias("body_b"))))
        return materialise(sure.select(both), "near")

    def _share(self, marks: DataFrame) -> tuple[int, float, bool]:
        """Postings of the batch; 1, or the share of the batch whose pairs stay below the limit, as postings of one gram
        meet each other and that grows with the square; whether stored postings of one gram may exceed one task.

        Grams are put together in cells, which meet more, never less; the cells of each part are stored beside it.
        """
        marks.groupBy(F.pmod("gram", F.lit(1 << 16)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells/part={self.parts}")
        all_cells = self.spark.read.schema("cell long, n long, part int").option("basePath", f"{self.path}/cells").parquet(*[f"{self.path}/cells/part={i}" for i in range(self.parts + 1)])
        new = F.col("part") == self.parts
        cells = all_cells.groupBy("cell").agg(F.sum(F.when(new, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(new, 0).otherwise(F.col("n"))).alias("b"))
        a = F.col("a").cast("double")
        n, meetings, most = cells.agg(F.sum("a"), F.sum(a * (a - 1) / 2), F.max("b")).first()
        if not n or meetings <= self.limit:
            return n or 0, 1.0, (most or 0) > self.hot
        one = marks.groupBy("gram").count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0]
        return n, 1.0 if one <= self.limit else math.sqrt(self.limit / one), (most or 0) > self.hot

    @staticmethod
    def _cut(rows: DataFrame, share: float) -> tuple[DataFrame | None, DataFrame | None]:
        """The first `share` of the rows by turn and the rest; none if there is one row."""
        numbered = materialise(rows.sort("turn").withColumn("number", F.monotonically_increasing_id()), "numbered")
        cut = numbered.select(F.percentile_approx("number", F.lit(share), F.lit(10_000))).first()[0]
        tail = materialise(numbered.filter(F.col("number") > cut).drop("number"), "tail")
        if tail.isEmpty():
            return None, None
        return materialise(numbered.filter(F.col("number") <= cut).drop("number"), "head"), tail

    def _refused(self, met: DataFrame, reach: DataFrame, known: DataFrame | None) -> DataFrame:
        """The classes that are not accepted: those that repeat older rows, and in turn each that repeats a row of the batch
        accepted before it. `met`: rows by their own keys; `reach`: by the keys they are near to."""
        old = None if known is None else materialise(known.select("cid").distinct(), "old")
        if old is not None:
            met, reach = (counted(df.join(small_side(old), "cid", "left_anti"), "open") for df in (met, reach))
        one_task = met.rows_written + reach.rows_written <= self.at_once
        new = self._in_turn(met, reach) if one_task else self._in_rounds(met, reach)
        return materialise(new if old is None else new.unionByName(old), "refused")

    @staticmethod
    def _in_turn(met: DataFrame, reach: DataFrame) -> DataFrame:
        """The rule itself, over a bounded number of rows in one task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            accepted: dict[tuple[int, bytes], set[bytes]] = {}
            own, now, bad, out = [], None, False, []

            def close() -> None:
                if bad:
                    out.append(now)
                else:
                    for key, document in own:
                        accepted.setdefault(key, set()).add(document)

            for b in batches:
                for cid, document, kind, key, mine in zip(*[b.column(c).to_pylist() for c in ("cid", "document", "kind", "key", "mine")]):
                    if cid != now:
                        if now is not None:
                            close()
                        own, now, bad = [], cid, False
                    there = accepted.get((kind, key))
                    if there and not bad:
                        bad = kind == REVISION or document is not None and bool(there - {document, None})
                    if mine:
                        own.append(((kind, key), document))
            if now is not None:
                close()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["cid"])

        rows = met.withColumn("mine", F.lit(True)).unionByName(reach.withColumn("mine", F.lit(False)))
        return rows.select("cid", "turn", "document", "kind", "key", "mine").coalesce(1).sortWithinPartitions("turn", "cid").drop("turn").mapInArrow(run, "cid binary")

    @staticmethod
    def _in_rounds(met: DataFrame, reach: DataFrame) -> DataFrame:
        """The same in rounds over all tasks. In each round those rows are accepted that none still open and related comes
        before, and what repeats them is refused. Of each key only the first rows of its first two documents are needed
        to tell who is before whom, so no group meets itself; each round cuts its lineage."""
        own, probes, refused = met, met.unionByName(reach), None
        same = F.col("document") == F.col("document_1")
        while not own.isEmpty():
            per = own.filter((F.col("kind") == REVISION) | F.col("document").isNotNull()).groupBy("kind", "key", "document").agg(F.min("turn").alias("turn"))
            two = per.withColumn("k", F.row_number().over(Window.partitionBy("kind", "key").orderBy("turn"))).filter("k <= 2")
            lead = two.groupBy("kind", "key").agg(F.max(F.when(F.col("k") == 1, F.col("turn"))).alias("turn_1"), F.max(F.when(F.col("k") == 1, F.col("document"))).alias("document_1"), F.max(F.when(F.col("k") == 2, F.col("turn"))).alias("turn_2"))
            first = F.col("turn_1") < F.col("turn")
            waits = F.when(F.col("kind") == REVISION, first).otherwise((~same & first) | (same & (F.col("turn_2") < F.col("turn"))))
            waiting = probes.join(lead, ["kind", "key"]).filter(waits).select("cid").distinct()
            sure = materialise(own.join(waiting, "cid", "left_anti"), "sure")
            by = sure.groupBy("kind", "key").agg(F.min("document").alias("low"), F.max("document").alias("high"), F.min("cid").alias("who"))
            repeats = F.when(F.col("kind") == REVISION, F.col("who") != F.col("cid")).otherwise((F.col("low") != F.col("document")) | (F.col("high") != F.col("document")))
            out = materialise(probes.join(by, ["kind", "key"]).filter(repeats).select("cid").distinct(), "out")
            refused = out if refused is None else refused.unionByName(out)
            gone = out.unionByName(sure.select("cid")).distinct()
            own, probes = (materialise(df.join(gone, "cid", "left_anti"), "open") for df in (own, probes))
        return met.select("cid").limit(0) if refused is None else refused.distinct()
