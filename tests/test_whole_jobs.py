"""Queries over all rows: no part of the tables is left out."""

import bisect
import math
import random
from statistics import median, pstdev

import pytest

import __spark_entry__ as entry
from oracle import connect, difference
from pyspark.sql import functions as F

from quaymark.operators.actors import grouped_two_sided_tails, nearest
from quaymark.operators.asof import asof_join
from quaymark.operators.detect import bucket_prices, dense_grid, moves
from quaymark.plans.relations_sql import EFILLS, with_
from quaymark.sources.domain import books, observations
from quaymark.streaming.sequences import run_once, sequence_states

#: Books of every market, not of view events alone as in relations_sql.BOOKS.
ALL_BOOKS = """books AS (SELECT 'ev:book-' || event_id AS snapshot_uid, 'ev:' || event_type AS market_uid, value / (value + 50) AS p, event_id, ts AS event_time FROM events)"""


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


def test_jn04_joins_every_fill(spark, con, tiny):
    sql = with_(EFILLS, ALL_BOOKS, "b AS (SELECT market_uid, event_time, max(snapshot_uid) AS snapshot_uid FROM books GROUP BY ALL)") + "SELECT f.fill_uid, CASE WHEN f.event_time - INTERVAL 1 SECOND - b.event_time <= INTERVAL 10 MINUTE THEN b.snapshot_uid END AS snapshot_uid FROM efills f ASOF LEFT JOIN b ON f.market_uid = b.market_uid AND f.event_time - INTERVAL 1 SECOND >= b.event_time"
    assert difference(spark, con, entry.queries()["jn04_book_as_of"], sql, tiny) == ""


def test_books_of_every_market(spark, con, tiny):
    assert books(spark, tiny).select("market_uid").distinct().count() == con.execute("SELECT count(DISTINCT event_type) FROM events").fetchone()[0]
    depth = "CAST((event_id % 10 + 1) + (event_id % 20 + 2) AS DOUBLE)"
    assert difference(spark, con, entry.queries()["agg05_book_features"], with_(ALL_BOOKS) + f"SELECT snapshot_uid, 0.02 AS spread, {depth} AS bid_depth, {depth} AS ask_depth FROM books", tiny) == ""
    assert difference(spark, con, entry.queries()["flt17_domain_rules"], with_(ALL_BOOKS) + "SELECT snapshot_uid, p < 0 OR p > 1 AS price_out_of_range, true AS levels_ordered, instr(market_uid, 'ev:') <> 1 AS prefix_wrong FROM books", tiny) == ""


def test_asof_join_across_slices(spark):
    """Facts just before, at and after the borders of slices (20 * 600 s), against brute force."""
    at = [k * 12_000 + d for k in range(4) for d in (-601, -600, -599, -1, 0, 1, 599, 600, 601)]
    left = spark.createDataFrame([(k, t) for k in "ab" for t in at], "k string, s long").selectExpr("k", "s", "timestamp_seconds(s) AS at")
    facts = [(k, t, f"{k}{t}") for k in "ab" for t in at if (t // 7 + ord(k)) % 3 == 0]
    right = spark.createDataFrame(facts, "k string, u long, v string").selectExpr("k", "v", "timestamp_seconds(u) AS t")
    got = {(r["k"], r["s"]): r["v"] for r in asof_join(left, right, ["k"], "at", "t", ["v"], 600).collect()}
    best = lambda k, s: max(((u, v) for q, u, v in facts if q == k and u <= s), default=(None, None))
    assert got == {(k, s): v if u is not None and s - u <= 600 else None for k in "ab" for s in at for u, v in [best(k, s)]}


def test_win14_covers_every_fill(spark, con, tiny):
    sql = entry.oracle_sql()["win14_two_sided_tail"].replace(" WHERE actor_uid IS NULL", "")
    assert difference(spark, con, entry.queries()["win14_two_sided_tail"], sql, tiny) == ""


def test_two_sided_tails_by_brute_force(spark):
    dice = random.Random(5)
    rows = [(g, f"{g}{i}", dice.randint(0, sides) / 8) for g, n, sides in (("a", 41, 6), ("b", 40, 1), ("c", 37, 999), ("d", 2, 3), ("e", 1, 1)) for i in range(n)]
    got = {r["u"]: (r["loo_median"], r["tail"]) for r in grouped_two_sided_tails(spark.createDataFrame(rows, "g string, u string, v double"), "g", "u", "v").collect()}
    want = {}
    for g, u, v in rows:
        others = [x for h, w, x in rows if h == g and w != u]
        middle = median(others) if others else None
        want[u] = (middle, (1 + sum(abs(x - middle) >= abs(v - middle) - 1e-12 for x in others)) / (1 + len(others))) if others else (None, None)
    assert got == want


def test_win05_looks_back_a_week(spark, con, tiny):
    sql = entry.oracle_sql()["win05_baseline_gate"].replace("86400 PRECEDING", "604800 PRECEDING").replace("n_buckets < 30 OR elapsed < 7200", "n_buckets < 288 OR elapsed < 86400")
    assert "604800" in sql and "n_buckets < 288" in sql
    assert difference(spark, con, entry.queries()["win05_baseline_gate"], sql, tiny) == ""


def test_win06_and_cmp01_score_against_a_week(spark):
    folder = "/root/testdata/sf0.1"
    grid = moves(dense_grid(bucket_prices(observations(spark, folder)))).filter("market_uid = 'ev:view'").select("bucket", F.abs("move_5").alias("v")).orderBy("bucket").collect()
    at, values = [r["bucket"] for r in grid], [r["v"] for r in grid]
    got = {r["bucket"]: r for r in entry.queries()["win06_robust_scores"](spark, folder).filter("market_uid = 'ev:view'").collect()}
    want = 0
    for i, (t, v) in enumerate(zip(at, values)):
        start = bisect.bisect_left(at, t - 604_800)
        past = [x for x in values[start:i] if x is not None]
        if i - start < 288 or t - at[start] < 86_400 or len(past) < 288 or v is None:
            assert t not in got
            continue
        want += 1
        assert got[t]["n_values"] == len(past)
        if i % 50 == 0:
            middle = median(past)
            assert got[t]["median"] == pytest.approx(middle, abs=1e-6) and got[t]["mad"] == pytest.approx(median(abs(x - middle) for x in past), abs=1e-6)
    assert 0 < want == len(got)
    first = bucket_prices(observations(spark, folder)).agg(F.min("bucket")).first()[0]
    assert entry.queries()["cmp01_causal_detection"](spark, folder).agg(F.min("started")).first()[0] >= first + 86_400


def test_jn13_takes_every_actor(spark, con, tiny):
    assert difference(spark, con, entry.queries()["jn13_nearest_peers"], entry.oracle_sql()["jn13_nearest_peers"], tiny) == ""


def test_nearest_by_brute_force(spark):
    dice = random.Random(3)
    rows = [(f"a{i:03}", g, float(dice.randint(0, 4)), float(dice.randint(0, 3))) for i, g in enumerate("x" * 60 + "y" * 5 + "z")] + [("far", "x", 90.0, 90.0)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "u string, g string, x double, y double"), "u", ["x", "y"], 5, "g", 4.0).collect():
        got.setdefault(r["u"], []).append((r["place"], r["peer"], r["distance"], r["reason"]))
    sx, sy = pstdev(r[2] for r in rows), pstdev(r[3] for r in rows)
    for u, g, x, y in rows:
        near = sorted((math.sqrt(((x - q) / sx) ** 2 + ((y - w) / sy) ** 2), v) for v, h, q, w in rows if h == g and v != u)[:5]
        reason = "nuisance_peer_support_insufficient" if len(near) < 5 else "nuisance_support_ood" if near[-1][0] > 4 else None
        mine = sorted(got[u], key=lambda r: r[0] or 0)
        if not near:
            assert mine == [(None, None, None, reason)]
            continue
        assert [r[0] for r in mine] == list(range(1, len(near) + 1)) and {r[3] for r in mine} == {reason}
        assert [r[2] for r in mine] == pytest.approx([d for d, _ in near], abs=1e-9)
        assert all(p < q for (_, p, d, _), (_, q, e, _) in zip(mine, mine[1:]) if d == e)


@pytest.mark.parametrize("name, limit", [("top02_top_anomalies", " LIMIT 50"), ("top03_actionable", " LIMIT 40")])
def test_top_rows_are_all_there_in_order(spark, name, limit):
    folder, sql = "/root/testdata/sf0.01", entry.oracle_sql()[name].removesuffix(limit)
    con = connect(folder)
    assert len(con.execute(sql).fetchall()) > 50
    assert difference(spark, con, entry.queries()[name], sql, folder) == ""
    got = entry.queries()[name](spark, folder).collect()
    if name == "top02_top_anomalies":
        assert [abs(r["score"]) for r in got] == sorted((abs(r["score"]) for r in got), reverse=True)
    else:
        assert [r["row_uid"] for r in got] == [r[0] for r in con.execute(sql).fetchall()]


def test_jn01_joins_all_ticks(spark, con, tiny):
    sql = entry.oracle_sql()["jn01_ticks_markets"].removesuffix(" LIMIT 500")
    assert len(con.execute(sql).fetchall()) > 500
    assert difference(spark, con, entry.queries()["jn01_ticks_markets"], sql, tiny) == ""


def test_st02_is_in_order_over_chunks_and_files(spark, tmp_path):
    """25 000 shuffled frames a stream in several files: more than one Arrow batch each."""
    numbers = F.expr("id div 2 + (id div 2) div 5000")  # a gap after each 5 000 frames
    rows = spark.range(50_000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("stream"), numbers.alias("seq"), F.when(numbers % 6007 == 0, "snapshot").otherwise("delta").alias("kind"))
    rows.orderBy(F.rand(7)).repartition(5).write.parquet(f"{tmp_path}/frames")
    got = run_once(sequence_states(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/frames")), "shuffled")
    last, gap, want = None, False, {}
    for r in rows.filter("stream = 's0'").orderBy("seq").collect():
        status = "gap" if last is not None and r["seq"] > last + 1 else "contiguous"
        gap, last = (gap or status == "gap") and r["kind"] != "snapshot", r["seq"]
        want[r["seq"]] = (r["kind"], status, gap)
    for s in ("s0", "s1"):
        mine = got.filter(F.col("stream") == s).collect()
        assert len(mine) == 25_000 and {r["seq"]: (r["kind"], r["status"], r["withheld"]) for r in mine} == want


def test_two_sided_tails_over_the_whole_table(spark):
    from quaymark.operators.ranks import two_sided_tails as tails

    dice = random.Random(8)
    for n, sides in ((41, 6), (40, 6), (60, 999), (61, 999), (2, 3), (1, 3)):
        rows = [(i, dice.randint(0, sides) / 4) for i in range(n)] + [(-1, None)]
        got = {r["i"]: r["tail_v"] for r in tails(spark.createDataFrame(rows, "i int, v double"), "i", "v").collect()}
        for i, v in rows:
            others = [x for j, x in rows if j != i and x is not None]
            want = None if v is None or not others else (1 + sum(abs(x - median(others)) >= abs(v - median(others)) for x in others)) / (1 + len(others))
            assert got[i] == want
