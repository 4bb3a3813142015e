"""Edge cases and brute-force comparisons of the operators behind p1_ to p6_."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quaymark.operators.attributes import AttributeHistories, histories, known_attributes
from quaymark.operators.dedup import deduplicate, deduplicate_arrivals, surplus
from quaymark.operators.features import feature_table
from quaymark.operators.skew import compress, hot_keys, profile, weighted_percentiles
from quaymark.operators.timestamps import TimestampDictionary, parse_texts
from quaymark.session import scratch_path
from quaymark.streaming.panes import Lateness, PaneStore, panes, windows

T0 = datetime(2024, 3, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def known(spark, facts, events, **options):
    past = histories(spark.createDataFrame(facts, "e string, t timestamp, a string, b string"), "e", "t", {"a": False, "b": False})
    df = spark.createDataFrame(events, "uid int, e string, t timestamp, a string")
    return {(r["uid"], r["a"], r["b"]) for r in known_attributes(df, past, "e", "t", ["a", "b"], **options).collect()}


def test_attributes_change_on_their_own_and_never_from_the_future(spark):
    facts = [("x", at(0), "a0", "b0"), ("x", at(10), "a1", "b0"), ("x", at(20), "a1", None), (None, at(0), "no", "no"), ("x", None, "no", "no")]
    events = [(1, "x", at(-1), "own"), (2, "x", at(0), "own"), (3, "x", at(15), None), (4, "x", at(20), None), (5, "y", at(5), None), (6, None, at(5), None), (7, "x", None, None), (3, "x", at(15), None)]
    assert known(spark, facts, events) == {(1, None, None), (2, "a0", "b0"), (3, "a1", "b0"), (4, "a1", None), (5, None, None), (6, None, None), (7, None, None)}
    assert known(spark, [], events[:2]) == {(1, None, None), (2, None, None)} and known(spark, facts, []) == set()


def test_slicing_a_hot_entity_changes_nothing(spark):
    rnd = random.Random(1)
    facts = [(rnd.choice("hhhhhx"), at(rnd.randrange(500)), f"a{i}", f"b{i}" if i % 3 else None) for i in range(400)]
    events = [(i, rnd.choice("hhhhhxy"), at(rnd.randrange(-5, 520)), None) for i in range(600)]
    assert known(spark, facts, events) == known(spark, facts, events, slice_rows=20, slices=7)


def test_one_copy_of_each(spark):
    rows = [("a", 2, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 3, "z"), ("b", None, 4, "only"), ("c", None, 5, "late"), ("c", 9, 6, "first"), (None, 1, 7, "n"), (None, 1, 8, "n"), ("d", 1, 9, "tie"), ("d", 1, 9, "tie")]
    df = spark.createDataFrame(rows, "k string, t int, id int, extra string")
    kept = deduplicate(df, ["k"], ["t", "id"])
    assert sorted(r["id"] for r in kept.collect()) == [2, 4, 6, 7, 8, 9] and kept.columns == df.columns
    assert sorted(r["id"] for r in surplus(df, ["k"], ["t", "id"]).collect()) == [1, 3, 5]
    assert deduplicate(df.limit(0), ["k"], ["t", "id"]).count() == 0
    stored = spark.createDataFrame([("a",), ("d",)], "k string")
    assert sorted(r["id"] for r in deduplicate_arrivals(df, stored, ["k"], ["t", "id"]).collect()) == [4, 6, 7, 8]


def test_profiles_and_percentiles_are_exact(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["cold", None]), rnd.choice([None, *range(40)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int")
    small = compress(df, ["k"], ["v"])
    got = {r["k"]: (r["n_rows"], r["n_values"], r["mode_value"], r["mode_rows"]) for r in profile(small, "k", "v").collect()}
    values = defaultdict(list)
    for k, v in rows:
        values[k].append(v)
    for k, v in values.items():
        seen = Counter(x for x in v if x is not None)
        mode = min(seen, key=lambda x: (-seen[x], x))
        assert got[k] == (len(v), len(seen), mode, seen[mode])
    cuts = {(r["k"], r["fraction"]): r["value_at"] for r in weighted_percentiles(small, "k", "v", (0.0, 0.1, 0.5, 1.0), cells=5).collect()}
    for k, v in values.items():
        s = sorted(x for x in v if x is not None)
        for p in (0.0, 0.1, 0.5, 1.0):
            assert cuts[k, p] == s[max(1, -(-int(p * len(s) * 1000) // 1000)) - 1]
    assert [r["k"] for r in hot_keys(small, "k", 2).collect()] == ["hot"]
    empty = compress(df.limit(0), ["k"], ["v"])
    assert profile(empty, "k", "v").count() == 0 and hot_keys(empty, "k", 2).count() == 0 and weighted_percentiles(empty, "k", "v", (0.5,)).count() == 0


def test_feature_table(spark):
    rows = [("a", "x", at(1), 2.0), ("a", "x", at(3), None), ("a", "y/z", at(2), 5.0), ("a", None, at(9), 1.0), ("b", "other", None, 4.0), (None, "x", at(1), 1.0)]
    df = spark.createDataFrame(rows, "who string, kind string, t timestamp, v double")
    got = {r["who"]: r.asDict() for r in feature_table(df, "who", "kind", "t", {"total": F.col("v")}, ["x", "y/z"]).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["n_all"], a["n_x"], a["n_y_z"], a["total_x"], a["total_all"]) == (4, 2, 1, 2.0, 8.0)
    assert a["last_x"].replace(tzinfo=None) == at(3) and a["last_all"].replace(tzinfo=None) == at(9)
    assert (b["n_all"], b["n_x"], b["last_x"], b["total_y_z"], b["last_all"]) == (1, 0, None, None, None)
    assert feature_table(df.limit(0), "who", "kind", "t", {}, ["x"]).count() == 0
    with pytest.raises(ValueError):
        feature_table(df, "who", "kind", "t", {}, ["x!", "x?"])


CLOCKS = [
    ("2024-03-05 12:28:11 America/Bogota", "UTC", "dmy", "2024-03-05T17:28:11"), ("2024-03-05 12:28:11[Asia/Tokyo]", None, None, "2024-03-05T03:28:11"), (" Tue, 27 Feb 24 16:51:40 +0100\t", None, "dmy", "2024-02-27T15:51:40"),
    ("03/04/2024 9:05 PM", "UTC", "mdy", "2024-03-04T21:05:00"), ("03/04/2024 9:05", "UTC", "dmy", "2024-04-03T09:05:00"), ("5.3.2024, 15:23:39", "Europe/Berlin", "mdy", "2024-03-05T14:23:39"), ("March 2, 2024 at 12:01 am", "UTC", "mdy", "2024-03-02T00:01:00"),
    ("8 March 2024", "Asia/Kolkata", "dmy", "2024-03-07T18:30:00"), ("20240319T042956Z", None, None, "2024-03-19T04:29:56"), ("20240305174755", "America/New_York", "dmy", "2024-03-05T22:47:55"), ("20240305", "UTC", "dmy", "2024-03-05T00:00:00"),
    ("1709348431", None, None, "2024-03-02T03:00:31"), ("1709348431.1239999", None, None, "2024-03-02T03:00:31.123999"), ("1709348431123", None, None, "2024-03-02T03:00:31.123"), ("1709348431123456", None, None, "2024-03-02T03:00:31.123456"),
    ("2024-03-12T23:32:51+00", None, None, "2024-03-12T23:32:51"), ("2024-03-12T23:32-0330", None, None, "2024-03-13T03:02:00"), ("2024-03-12 23:32:51 EDT", "Asia/Tokyo", None, "2024-03-13T03:32:51"), ("2024-03-12T23:32:51.123456789Z", None, None, "2024-03-12T23:32:51.123456"),
    ("2023-11-05 01:30", "America/New_York", "mdy", "2023-11-05T05:30:00"), ("2024-03-10 02:30", "America/New_York", "mdy", "2024-03-10T07:30:00"), ("2023-10-29 02:30", "Europe/Berlin", "dmy", "2023-10-29T00:30:00"), ("2024-02-29", "UTC", "dmy", "2024-02-29T00:00:00"),
    ("2023-02-29", "UTC", "dmy", None), ("2024-03-12 24:00", "UTC", "dmy", None), ("31/31/2023 09:15", "UTC", "dmy", None), ("2024-03-12 10:00", None, "dmy", None), ("2024-03-12 10:00 XYZ", "UTC", "dmy", None), ("yesterday", "UTC", "dmy", None), ("", "UTC", "dmy", None),
    ("1e400", "UTC", "dmy", None), ("13:05 PM", "UTC", "dmy", None), ("0000-00-00 00:00:00", "UTC", "dmy", None), ("2024-03-12 10:00 Not/AZone", "UTC", "dmy", None), (None, "UTC", "dmy", None), ("2024-03-12 13:00 PM", "UTC", "dmy", None), ("x" * 100_000, "UTC", "dmy", None),
]


def test_clock_texts(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CLOCKS)], "i int, raw string, zone string, date_order string")
    got = {r["i"]: r["instant_us"] for r in parse_texts(df).collect()}
    for i, (raw, *_, want) in enumerate(CLOCKS):
        exact = None if want is None else round((datetime.fromisoformat(want).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
        assert got[i] == exact, raw


def test_wall_times_over_all_hours_of_changes(spark):
    rows, want = [], []
    for zone in ("America/New_York", "Europe/London", "Australia/Sydney", "America/St_Johns"):
        for day in (datetime(2023, 3, 25), datetime(2023, 10, 28), datetime(2023, 4, 1), datetime(2023, 9, 30), datetime(2023, 3, 11), datetime(2023, 11, 4)):
            for half in range(96):
                wall = day + timedelta(minutes=30 * half)
                rows.append((len(rows), wall.isoformat(sep=" "), zone, "dmy"))
                want.append(round((wall.replace(tzinfo=ZoneInfo(zone), fold=0) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000)
    got = {r["i"]: r["instant_us"] for r in parse_texts(spark.createDataFrame(rows, "i int, raw string, zone string, date_order string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_dictionary_parses_only_what_is_new(spark):
    df = spark.createDataFrame([(1, "1709348431", None, None), (2, "1709348431", None, None), (3, "soon", None, None), (4, None, None, None), (5, "2024-03-05", "UTC", "dmy")], "i int, raw string, zone string, date_order string")
    book = TimestampDictionary(spark, scratch_path(spark, "book"))
    book.update(df.filter("i < 4"))
    book.update(df)
    assert [spark.read.parquet(f"{book.path}/part={i}").count() for i in (0, 1)] == [2, 1]
    assert sorted(r["i"] for r in book.resolve(df).collect()) == [1, 2, 5]


def test_panes_and_windows(spark):
    rule = Lateness(pane=3600, close=300, cutoff=86_400)
    rows = [("m", at(10), at(11), 1), ("m", at(59), at(65), 2), ("m", at(59), at(66), 4), ("m", at(10), at(60 + 1440), 8), ("m", at(10), at(61 + 1440), 16), ("m", None, at(1), 32), ("m", at(70), None, 64), (None, at(10), at(10), 128)]
    df = spark.createDataFrame(rows, "k string, t timestamp, came timestamp, v int")
    got = {(r["k"], r["period_start"] - 1709251200): (r["first_v"], r["v"], r["n_late"], r["n_refused"], r["corrected"]) for r in windows(panes(df, ["k"], "t", "came", ["v"], rule), ["k"], ["v"], rule).collect()}
    assert got == {("m", 0): (3, 15, 2, 1, True), ("m", 3600): (None, None, 0, 1, False), (None, 0): (128, 128, 0, 0, False)}
    wide = {r["period_start"] - 1709251200: r["n"] for r in windows(panes(df.filter("k = 'm'"), ["k"], "t", "came", ["v"], rule), ["k"], ["v"], rule, width=2, step=2).collect()}
    assert wide == {0: 4}
    assert windows(panes(df.limit(0), ["k"], "t", "came", ["v"], rule), ["k"], ["v"], rule).count() == 0


def test_pane_store_re_emits_what_a_batch_changes_and_survives_replays(spark):
    rule = Lateness()
    df = spark.createDataFrame([("m", at(10), at(11), 1), ("m", at(70), at(71), 2), ("m", at(10), at(100), 4)], "k string, t timestamp, came timestamp, v int")
    store = PaneStore(spark, scratch_path(spark, "panes"), ["k"], ["v"], rule)
    assert store.merge(df.filter("v < 3"), 0, "t", "came").count() == 2
    for _ in range(2):  # the second is a replay
        out = store.merge(df.filter("v = 4"), 1, "t", "came").collect()
        assert [(r["first_v"], r["v"], r["corrected"]) for r in out] == [(1, 5, True)]
    store.compact(1)
    store.compact(2)
    assert store.state().agg(F.sum("n")).first()[0] == 3


def test_pane_store_reads_the_slots_of_changed_windows_alone_and_survives_a_crash_while_folding(spark):
    rows = [("m", at(60 * h), at(60 * h + 1), 1) for h in range(0, 24 * 40, 6)]
    df = spark.createDataFrame(rows, "k string, t timestamp, came timestamp, v int")
    store = PaneStore(spark, scratch_path(spark, "panes"), ["k"], ["v"], width=3, slot=24)
    store.merge(df, 0, "t", "came").count()
    late = spark.createDataFrame([("m", at(60 * 24 * 20), at(60 * 24 * 20 + 100), 5)], df.schema)
    out = store.merge(late, 1, "t", "came")
    assert sorted(r["v"] for r in out.collect()) == [6, 6, 6]
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", out._jdf.queryExecution().toString())
    assert any("slot" in s for s in scans)  # the history is read by slot
    broken = store._write
    store._write = lambda rows, folder: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.compact(1)
    store._write = broken
    assert store.state().agg(F.sum("n")).first()[0] == len(rows) + 1
    last = int((at(60 * 24 * 39) - datetime(1970, 1, 1)).total_seconds())
    store.compact(2, last)
    left = store.state().agg(F.min("pane"), F.sum("n")).first()
    assert left[0] + 3 * 3600 + 86_400 >= last and left[1] < len(rows) and store._folders() == (2, ["fold=2"])
    with pytest.raises(ValueError):
        store.merge(late, 1, "t", "came")


def test_stored_histories_take_updates_in_any_order(spark):
    facts = [("x", at(0), "a0", "b0"), ("x", at(10), "a1", "b0"), ("x", at(20), "a0", "b2")]
    df = spark.createDataFrame(facts, "e string, t timestamp, a string, b string")
    stored = AttributeHistories(spark, scratch_path(spark, "histories"), {"a": True, "b": False})
    stored.update(df.filter("a = 'a1'"), "e", "t")
    stored.update(df, "e", "t", ["a"])
    stored.update(df.filter("b = 'b2'"), "e", "t", ["b"])
    events = spark.createDataFrame([(1, "x", at(5)), (2, "x", at(15)), (3, "x", at(25))], "uid int, e string, t timestamp")
    got = {r["uid"]: (r["a"], r["b"]) for r in known_attributes(events, stored.past(), "e", "t", ["a", "b"]).collect()}
    assert got == {1: ("a0", None), 2: ("a1", "b0"), 3: ("a1", "b2")}
