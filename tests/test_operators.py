"""Goldens, invariants and edge cases of the surveillance operators."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaymark.functions.scalars import bitcoin_address_ok, bucket_end, canonical_url, feature_bucket_end, logit, two_sided_tail
from quaymark.operators.asof import asof_join, classify_append, extreme_row, keyset_page
from quaymark.operators.coverage import contiguous, covered_ratio, gaps
from quaymark.operators.detect import Rules, benjamini_hochberg, bucket_fills, detect, sessions, trailing_scores
from quaymark.operators.graph import components, simple_paths
from quaymark.operators.ledger import chain, registry_violations, verify
from quaymark.operators.shocks import belief_shocks
from quaymark.sources.inventory import scenarios
from quaymark.sources.wire import final_candles, frames, rest_trades

T0 = datetime(2024, 3, 1)


def test_shock_golden(spark):
    prices = [0.5] * 20 + [0.8, 0.82, 0.85]
    df = belief_shocks(spark.createDataFrame([("m", i, p) for i, p in enumerate(prices)], "m string, t int, price double"), "m", "t", "t", window=10, limit=2.0)
    hit = {r["t"]: r["anomaly"] for r in df.collect()}
    assert hit[20] and not hit[10]


def test_benjamini_hochberg_golden(spark):
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5, None))], "g string, i int, p double")
    got = {r["i"]: (r["bh_rank"], round(r["q"], 6)) for r in benjamini_hochberg(df, "g", "p", ["i"]).collect()}
    assert got == {0: (1, 0.04), 1: (3, 0.053333), 2: (2, 0.053333), 3: (4, 0.5)}


def test_empirical_tail_golden(spark):
    rows = [("m", "o", 300 * i, 0.0 if i < 120 else 5.0) for i in range(121)]
    df = trailing_scores(spark.createDataFrame(rows, "market_uid string, outcome_uid string, bucket long, value double"), rules=Rules(least_buckets=30, least_elapsed=7_200, least_values=30, least_tail=30))
    last = df.filter("bucket = 36000").first()
    assert last["method"] == "tail" and abs(last["p"] - 1 / 121) < 1e-12


def test_normal_tail(spark):
    got = spark.createDataFrame([(1.96,), (0.0,), (None,)], "z double").select(two_sided_tail("z").alias("p")).collect()
    assert abs(got[0]["p"] - math.erfc(1.96 / math.sqrt(2))) < 1e-15 and got[1]["p"] == 1.0 and got[2]["p"] is None


def test_coverage_golden(spark):
    df = spark.createDataFrame([("s", 0, 10), ("s", 5, 20), ("s", 30, 40), ("s", 9, 3), ("s", None, 4)], "s string, a long, b long")
    assert sorted((r[1], r[2]) for r in gaps(df, ["s"], "a", "b", 0, 50).collect()) == [(20, 30), (40, 50)]
    assert covered_ratio(df, ["s"], "a", "b", 0, 50).first()["covered"] == 30
    assert gaps(df.limit(0), ["s"], "a", "b", 0, 50).count() == 0
    assert contiguous(spark.createDataFrame([("s", 0, 9), ("s", 10, 20), ("t", 0, 9), ("t", 11, 20)], "s string, a long, b long"), ["s"], "a", "b").filter("contiguous").count() == 1


def test_concentration_golden(spark):
    rows = [("m", "o", "x", "BUY", 0.5, 150.0, T0), ("m", "o", "y", "sell", 0.5, 50.0, T0), ("m", "o", None, "sell", 0.5, 0.0, T0)]
    got = bucket_fills(spark.createDataFrame(rows, "market_uid string, outcome_uid string, actor_uid string, side string, price double, size double, event_time timestamp")).first()
    assert got["concentration"] == 0.625 and got["imbalance"] == 0.5 and got["actors"] == 2


def test_bucket_conventions_are_opposite(spark):
    got = spark.createDataFrame([(T0,)], "t timestamp").select(bucket_end(F.col("t")), feature_bucket_end(F.col("t"))).first()
    assert got[0] - got[1] == 300


def test_logit_of_nothing_is_nothing(spark):
    got = spark.createDataFrame([(None,), (0.0,), (0.5,)], "p double").select(logit(F.col("p")).alias("x")).collect()
    assert got[0]["x"] is None and got[1]["x"] < -13 and got[2]["x"] == 0


def test_asof_join_is_backward_inclusive_and_bounded(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 5), (3, "k", 700), (4, "z", 10), (5, None, 3)], "id int, k string, s long").withColumn("at", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("k", 10, "ten"), ("k", 6, "six"), ("k", 5, "five")], "k string, s long, v string").withColumn("t", F.timestamp_seconds("s"))
    got = {r["id"]: r["v"] for r in asof_join(left, right.drop("s"), ["k"], "at", "t", ["v"], 600).collect()}
    assert got == {1: "ten", 2: "five", 3: None, 4: None, 5: None}


def test_append_is_idempotent_and_conflicts_are_kept_apart(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z"), (None, 1, "n")], "uid string, at int, v string")
    first = {(r["uid"], r["at"]): r["status"] for r in classify_append(df, None, "uid", ["at"], ()).collect()}
    assert first == {("a", 1): "inserted", ("a", 2): "duplicate", ("a", 3): "conflict", ("b", 1): "inserted", (None, 1): "rejected"}
    stored = df.filter("at = 1 and uid is not null")
    again = {(r["uid"], r["at"]): r["status"] for r in classify_append(df, stored, "uid", ["at"], ()).collect()}
    assert again == first | {("a", 1): "duplicate", ("b", 1): "duplicate"}


def test_extreme_row_and_pages(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "b"), ("l", 2, "c")], "k string, n int, v string")
    assert {r["v"] for r in extreme_row(df, ["k"], ["n"], last=True).collect()} == {"b", "c"}
    page = keyset_page(df, ["n"], None, 2).collect()
    assert [r["n"] for r in page] == [1, 2] and page[0]["has_more"]
    rest = keyset_page(df, ["n"], [F.lit(2)], 2).collect()
    assert [r["n"] for r in rest] == [3] and not rest[0]["has_more"]


def test_sessions_break_only_beyond_the_gap(spark):
    df = spark.createDataFrame([("k", 0), ("k", 1800), ("k", 3601)], "k string, t long")
    assert [r["session"] for r in sessions(df, ["k"], "t", 1800).orderBy("t").collect()] == [1, 1, 2]


def market(spark, extra=()):
    rows = [(f"o{i}", "m", "m-yes", 0.5 if i < 120 else 0.8, "last_trade", T0 + timedelta(minutes=5 * i + 1)) for i in range(122)] + list(extra)
    obs = spark.createDataFrame(rows, "observation_uid string, market_uid string, outcome_uid string, price double, kind string, event_time timestamp")
    fills = spark.createDataFrame([], "market_uid string, outcome_uid string, actor_uid string, side string, price double, size double, event_time timestamp")
    events = spark.createDataFrame([("m", None)], "market_uid string, event_uid string")
    return obs, fills, events


def test_detector_finds_one_incident_and_the_future_changes_nothing(spark):
    rules = Rules(least_buckets=30, least_elapsed=7_200, least_values=30, least_tail=30)
    seen = [r.asDict() for r in detect(*market(spark), rules).collect()]
    assert len(seen) == 1 and seen[0]["signals"] == 1
    future = [("late", "m", "m-yes", 0.1, "last_trade", T0 + timedelta(days=3))]
    again = [r.asDict() for r in detect(*market(spark, future), rules).collect()]
    assert seen[0] in again


def test_components_of_chains_hubs_and_nothing(spark):
    rows = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"x{i}") for i in range(50)] + [("self", "self"), (None, "n"), ("hub", "x1")]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(61)} == {"c000"} and {got[f"x{i}"] for i in range(50)} == {"hub"} and got["self"] == "self" and "n" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_paths_are_simple_bounded_and_pay_for_hubs(spark):
    edges = spark.createDataFrame([("s", "a", "e"), ("a", "t", "e"), ("s", "h", "e"), ("h", "t", "e"), *[("h", f"z{i}", "e") for i in range(20)]], "src string, dst string, type string")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    got = sorted((r["nodes"][1], round(r["score"], 4)) for r in simple_paths(edges, one("s"), one("t"), depth=3).collect())
    assert got == [("a", 0.5), ("h", round(1 / (2 + 0.1 * 12), 4))]


def test_ledger_and_registry(spark):
    schema = "sequence long, payload string, previous_hash string, entry_hash string"
    entries = chain(["a", "b", "c"])
    assert verify(spark.createDataFrame(entries, schema)).count() == 0
    entries[1] = (1, "x", *entries[1][2:])
    assert [(r["sequence"], r["reasons"]) for r in verify(spark.createDataFrame(entries, schema)).collect()] == [(1, ["hash_wrong"])]
    assert [(r["sequence"], r["reasons"]) for r in verify(spark.createDataFrame([entries[0], entries[2]], schema)).collect()] == [(2, ["sequence_gap"])]
    rows = [("a", "c", None), ("b", "c", "a"), ("d", "other", "a")]
    assert {(r["uid"], r["reason"]) for r in registry_violations(spark.createDataFrame(rows, "uid string, case_uid string, supersedes_uid string")).collect()} == {("a", "two_successors"), ("d", "case_changed")}


def test_wire_rows_that_are_malformed_have_a_reason(spark):
    bodies = ['{"market":"m","side":"buy","price":"0.4","size":"2","ts":"1709251200"}', '{"market":"m","side":"up","price":"0.4","size":"2"}', '{"market":"m","side":"SELL","price":"1.4","size":"2"}', '{"market":"m","side":"SELL","price":"0.4","size":"-2"}', "junk", None]
    df = spark.createDataFrame([(i, b, T0) for i, b in enumerate(bodies)], "i int, body string, received timestamp")
    got = {r["i"]: (r["reason"], r["time_source"], r["fill_uid"] is None) for r in rest_trades(df, "body", "received").collect()}
    assert got == {0: (None, "ts", False), 1: ("side_unknown", "receipt", True), 2: ("price_invalid", "receipt", True), 3: ("size_invalid", "receipt", True), 4: ("unreadable", "receipt", True), 5: ("unreadable", "receipt", True)}
    kinds = frames(df.limit(5), "body", "received").select("kind").distinct().collect()
    assert [r["kind"] for r in kinds] == ["unreadable"]


def test_candles(spark):
    rows = [("s", 1.0, 0, 60_000_000, 61_000_000, 60_500_000, True), ("s", 2.0, 0, 60_000_000, 61_000_000, 60_500_000, False), ("s", 3.0, 0, 60_000_000, 1, 60_500_000, True), ("s", 4.0, 0, 30_000_000, 61_000_000, 0, True)]
    got = final_candles(spark.createDataFrame(rows, "symbol string, high double, start_us long, end_us long, received_us long, exchange_us long, is_final boolean")).collect()
    assert [(r["price"], r["admissible_us"]) for r in got] == [(1.0, 61_000_000)]


def test_urls_and_addresses(spark):
    urls = ["HTTP://Ex.COM:80/a?b=2&a=1#x", "https://ex.com", "ftp://x/y", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == ["http://ex.com/a?a=1&b=2", "https://ex.com/", "", "", ""]
    cases = ["1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3", "", None]
    ok = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "a string").select(bitcoin_address_ok("a")).collect()]
    assert ok == [True, True, False, False, None]


def test_scenarios_inherit_tags(spark):
    text = "@all\nFeature: x\n\n  @one\n  Scenario: first\n  Scenario Outline: second\n"
    got = scenarios(spark.createDataFrame(pd.DataFrame({"path": ["f"], "content": [text.encode()]}), "path string, content binary")).orderBy("line").collect()
    assert [(r["title"], r["tags"], r["line"]) for r in got] == [("first", ["@all", "@one"], 5), ("second", ["@all"], 6)]


def test_ranks_over_ranges_equal_plain_ones(spark):
    from quaymark.operators.ranks import order_values, placed, running_counts, upper_tails

    dice = random.Random(9)
    rows = [(i, dice.choice("ab"), None if i % 17 == 0 else round(dice.random() ** 3, 2)) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    for g in "ab":
        own = sorted((v for _, h, v in rows if h == g and v is not None), reverse=True)
        for r in placed(df, "v", ["g"]).filter((F.col("g") == g) & F.col("v").isNotNull()).collect():
            assert r["rank"] == 1 + sum(x > r["v"] for x in own) and r["ties"] == own.count(r["v"]) and r["tie_group"] == len({x for x in own if x >= r["v"]})
            assert r["percentile"] == pytest.approx((sum(x < r["v"] for x in own) + (own.count(r["v"]) - 1) / 2 + 0.5) / len(own))
    values = sorted(v for *_, v in rows if v is not None)
    run = {r["v"]: r["upto_n"] for r in running_counts(df.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v", ["n"]).collect()}
    assert all(run[v] == sum(x <= v for x in values) for v in set(values))
    place = 0.37 * (len(values) - 1)
    want = values[int(place)] + (values[int(place) + 1] - values[int(place)]) * (place - int(place))
    assert order_values(df, "v", [0.0, 0.37, 1.0]) == pytest.approx([values[0], want, values[-1]])
    tails = {r["i"]: r["tail_v"] for r in upper_tails(df.select("i", "v"), "i", ["v"]).collect()}
    assert all(tails[i] == (None if v is None else sum(x >= v for x in values) / len(values)) for i, _, v in rows)
    assert order_values(df.limit(0), "v", [0.5]) == [None] and placed(df.limit(0), "v").count() == 0


def test_slices_of_a_hot_key_change_nothing(spark):
    from quaymark.operators.detect import sessions
    from quaymark.operators.shocks import belief_shocks

    dice = random.Random(4)
    rows = [(dice.choice("hhhhx"), t, f"t{t}", dice.random()) for t in sorted(dice.sample(range(100_000), 500))]
    df = spark.createDataFrame(rows, "m string, s long, uid string, price double").withColumn("at", F.timestamp_seconds("s"))
    plain, cut = (sorted(map(tuple, belief_shocks(df, "m", "at", "uid", slice_rows=n).select("uid", "shock", "past_mean", "past_std", "score", "anomaly").collect())) for n in (10**6, 60))
    assert len(plain) == 500 and all(a[0] == b[0] and a[5] == b[5] and a[1:5] == pytest.approx(b[1:5]) for a, b in zip(plain, cut))
    one, two = (sorted(map(tuple, sessions(df.select("m", "s"), ["m"], "s", 300, slice_rows=n).collect())) for n in (10**6, 60))
    assert one == two


def test_two_sided_tail_over_all_ranges(spark):
    z = [i / 50 for i in range(0, 1500)] + [-1.5]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", two_sided_tail("z").alias("p")).collect()
    assert all(r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-13, abs=1e-300) for r in got)


def test_first_of_either_key_by_brute_force(spark):
    from quaymark.operators.dedup import first_of_either

    dice = random.Random(6)
    rows = [(i, dice.choice([None, *"abcdefgh"]), dice.choice([None, *range(12)]), i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, u string, t int, extra int")
    seen, want = set(), []
    for i, u, t, _ in rows:
        own = {(k, v) for k, v in (("u", u), ("t", t)) if v is not None}
        if not own & seen:
            seen |= own
            want.append(i)
    got = first_of_either(df.unionByName(df.limit(3)), ["u", "t"], ["i"])
    assert sorted(r["i"] for r in got.collect()) == want and got.columns == df.columns
    assert first_of_either(df.limit(0), ["u", "t"], ["i"]).count() == 0


def test_out_of_distribution_scores(spark):
    import numpy as np

    from quaymark.operators.uncertainty import fit, ood_scores

    dice = np.random.default_rng(1)
    reference = fit(dice.normal(size=(50, 4)))
    df = spark.createDataFrame([(1, [0.0] * 4), (2, [9.0] * 4), (3, None), (4, [1.0])], "uid int, v array<double>")
    got = {r["uid"]: r for r in ood_scores(df, "uid", "v", reference).collect()}
    assert got[1]["ood"] < 0.5 < got[2]["ood"] <= 1 and not got[3]["available"] and got[4]["ood"] is None
    assert fit(dice.normal(size=(3, 4))) is None and not ood_scores(df, "uid", "v", None).first()["available"]


def test_decoded_logs_default_nothing(spark):
    from quaymark.sources.landing import LOG, decode_logs

    word, person = lambda n: f"{n:064x}", lambda n: "0x" + "0" * 24 + f"{n:040x}"
    good = "0x" + word(0) + word(7) + word(30) + word(60) + word(0)
    rows = [(1, "0xAA", ["0xT", "x", person(1), person(2)], good), (2, "0xBB", ["0xT", "x", person(1), person(2)], good), (3, "0xAA", ["0xT"], good), (4, "0xAA", ["0xT", "x", person(1), person(2)], good[:-1]), (5, "0xAA", ["0xT", "x", person(1), person(2)], None), (6, "0xAA", None, good), (7, "0xAA", ["0xT", "x", person(1), person(2)], "0x" + word(0) + word(0) + word(1) + word(1) + word(0)), (8, "0xAA", ["0xT", "x", person(1), person(2)], "0x" + word(0) + word(7) + "f" * 64 + word(1) + word(0))]
    df = spark.createDataFrame([(n, 0, a, t, d, "h") for n, a, t, d in rows], LOG)
    got = {r["block_number"]: r for r in decode_logs(df, ["0xaa"], "0xt").collect()}
    assert [got[n]["status"] for n in range(1, 9)] == ["decoded", "contract_not_allowed", "topics_malformed", "data_malformed", "data_malformed", "topic_unknown", "assets_ambiguous", "amount_out_of_range"]
    assert (got[1]["side"], got[1]["money"], got[1]["quantity"], got[1]["maker"][-1]) == ("BUY", 30, 60, "1") and got[2]["maker"] is None
