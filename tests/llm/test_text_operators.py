"""Edge cases and brute-force comparisons of the operators behind p7_ to p10_."""

import random
import unicodedata
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm.history import AcceptedIndex, edits, prefix_length, spoilable
from quaymark.llm.lookalike import lookalike_pairs, skeleton, with_skeleton
from quaymark.llm.packing import lay_out, pack, plan
from quaymark.llm.tokens import Encoder, encode_corpus, read_ranks

T0 = datetime(2024, 3, 1)
SCHEMA = "evidence_uid string, document_uid string, revision_uid string, body string, first_seen_at timestamp"


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=70), st.lists(st.sampled_from("abcd"), max_size=70))
def test_edits(a, b):
    assert edits(a, b) == plain_edits(a, b)


def brute(rows):
    accepted, pairs = [], set()
    for uid, doc, rev, body, t in sorted(rows, key=lambda r: (r[4] is None, r[4] or T0, r[0])):
        w = "".join(c if c.isalnum() else " " for c in (body or "").lower()).split()
        hit = [u for u, d, v, x in accepted if (rev is not None and v == rev) or (None not in (d, doc) and d != doc and w and x and 4 * plain_edits(w, x) <= max(len(w), len(x)))]
        pairs |= {(min(u, uid), max(u, uid)) for u in hit}
        if not hit:
            accepted.append((uid, doc, rev, w))
    return pairs


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(vocab) for _ in range(rnd.randrange(1, 30))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 1 + len(w) // 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        body = rnd.choice([None, "", " - "]) if rnd.random() < 0.05 else (" ".join(w).upper() if rnd.random() < 0.3 else ", ".join(w) + ".")
        doc = None if rnd.random() < 0.05 else f"d{rnd.randrange(n // 3)}"
        rev = None if rnd.random() < 0.05 else f"{doc}:{rnd.randrange(3)}"
        rows.append((f"u{i:04}", doc, rev, body, None if i == n - 1 else T0 + timedelta(minutes=rnd.randrange(n // 2))))
    return rows


@pytest.mark.parametrize("cuts,options", [((60, 130), {}), ((90,), {"pairs_at_once": 300}), ((70, 100), {"hot_postings": 3, "settle_at_once": 0})])
def test_history_equals_taking_rows_one_by_one(spark, cuts, options):
    rows = sorted(corpus(3, 200), key=lambda r: (r[4] is None, r[4] or T0, r[0]))
    index, got, at = AcceptedIndex(spark, **options), set(), 0
    for stop in (*cuts, len(rows)):
        batch = spark.createDataFrame([*rows[at:stop], rows[at]], SCHEMA)
        got |= {tuple(r) for r in index.take(batch).collect()}
        at = stop
    assert got == brute(rows)


def test_a_cluster_of_copies_and_equal_times_is_taken_in_parts(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(f"u{i:03}", f"d{i % 40}", f"r{i}", " ".join(base[: 19 - i % 3] + [f"x{i % 7}"]), T0) for i in range(120)]
    index = AcceptedIndex(spark, pairs_at_once=200)
    assert {tuple(r) for r in index.take(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    assert index.parts > 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 200))
def test_what_edits_can_spoil(size, pairs):
    assert spoilable(size, pairs) == max(n // 4 + min(n // 4 - (n - size), pairs) for n in range(size, max(size, size * 4 // 3) + 1))


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_near_texts_share_a_prefix_gram(data):
    word = st.sampled_from("abcdefghijklmnop")
    a = data.draw(st.lists(word, min_size=3, max_size=40))
    b = list(a)
    for _ in range(data.draw(st.integers(0, len(a) // 3))):
        at, kind = data.draw(st.integers(0, max(0, len(b) - 1))), data.draw(st.integers(0, 2))
        b[at : at + (kind > 0)] = [data.draw(word)] if kind < 2 else []
    if a == b or not b or 4 * plain_edits(a, b) > max(len(a), len(b)):
        return
    seed = data.draw(st.integers(0, 99))

    def prefix(x):
        grams = sorted((hash((seed, x[i], x[i + 1])), i) for i in range(len(x) - 1))
        m = prefix_length([i for _, i in grams], len(x))
        return {(g, i) for g, i in grams if m and g <= grams[m - 1][0]}

    k = max(len(a), len(b)) // 4
    assert any(g == h and abs(i - j) + abs(len(a) - len(b) - (i - j)) <= k for g, i in prefix(a) for h, j in prefix(b))


def test_history_goes_on_in_a_new_session_object_and_takes_nothing(spark):
    first = AcceptedIndex(spark)
    assert first.take(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", "d1", "r1", "one two three four five", T0), ("b", "d2", "r2", "one two three four six", T0 + timedelta(days=1))]
    first.take(spark.createDataFrame(rows[:1], SCHEMA))
    again = AcceptedIndex(spark, first.path)
    assert [tuple(r) for r in again.take(spark.createDataFrame(rows[1:], SCHEMA)).collect()] == [("a", "b")]


def test_a_lookup_reads_as_much_of_a_large_history_as_of_a_small_one(spark):
    def read(n):
        rnd = random.Random(n)
        rows = [(f"u{i}", f"d{i}", f"r{i}", " ".join(f"w{rnd.randrange(4000)}" for _ in range(12)), T0 + timedelta(minutes=i)) for i in range(n)]
        index = AcceptedIndex(spark)
        index.take(spark.createDataFrame(rows, SCHEMA))
        stored = spark.read.parquet(f"{index.path}/postings/part=0")
        with index._pushing():
            looked = index._lookup("postings", stored.select("gram").limit(4), 4)
            found = looked.collect()
        plan = looked._jdf.queryExecution().executedPlan()
        scan = (plan.executedPlan() if "Adaptive" in plan.nodeName() else plan).collectLeaves().head()
        return len(found), scan.metrics().apply("numOutputRows").value(), stored.count()

    small, large = read(2_000), read(16_000)
    assert small[0] >= 4 and large[0] >= 4 and large[2] > 7 * small[2]
    assert large[1] <= 2 * max(small[1], 4 * 1024) and large[1] < large[2] / 5


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers as P

    return Encoder(read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abeht ins\n'", max_size=120)))
def test_backtracking_equals_merging(encoder, text):
    want = [encoder.ranks[t] for p in encoder.cut.findall(text) for t in encoder.merged(p.encode().decode("latin-1"))]
    assert encoder.encode(text) == want


def test_encoding_edge_cases_equal_the_public_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    texts = [None, "", " ", "<|endoftext|>", "a" * 5000, " 　x", "日本語 テキスト", "🙂🙂", "é", "x" * 200_000 + " end"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (tool.encode(t, add_special_tokens=False).ids if t else [])
    sizes = {r["doc_id"]: r["n"] for r in encode_corpus(df, ids="n", lengths_only=True).select("doc_id", "n").collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(40, 90))
def test_plan_places_every_item_once(histogram, capacity):
    patterns = plan(histogram, capacity)
    placed = defaultdict(int)
    for p in patterns:
        assert sum(length * n for length, n in p.items) <= capacity
        for length, n in p.items:
            placed[length] += n * p.count
    assert dict(placed) == histogram
    total, used = sum(k * v for k, v in histogram.items()), sum(p.count for p in patterns)
    assert used <= 2 * max(1, -(-total // capacity)) or not histogram
    if histogram:
        slots = lay_out(patterns, histogram, capacity)
        lengths = np.array([k for k, v in histogram.items() for _ in range(v)])
        ranks = np.array([i for v in histogram.values() for i in range(v)])
        container, position = slots.locate(lengths, ranks)
        assert set(container) == set(range(used))
        for c in range(used):
            spans = sorted((p, p + n) for p, n in zip(position[container == c], lengths[container == c]))
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and spans[-1][1] <= capacity


def test_pack_cuts_only_what_is_too_large(spark):
    sizes = [(1, 25), (2, 10), (3, 3), (4, 3), (5, 0), (6, None), (7, 4), (3, 3), (None, 2)]
    rows = pack(spark.createDataFrame(sizes, "doc int, n int"), "doc", "n", [10, 12]).collect()
    for capacity in (10, 12):
        own = [r for r in rows if r["capacity"] == capacity]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r["container_id"]] += r["piece_size"]
            pieces[r["doc"]].append(r["piece_size"])
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        assert sorted(pieces[1], reverse=True) == ([10, 10, 5] if capacity == 10 else [12, 12, 1])
        assert pieces[2] == [10] and sorted(pieces[3]) == [3, 3] and pieces[None] == [2] and 5 not in pieces and 6 not in pieces
        assert sum(fill.values()) == 50
    assert pack(spark.createDataFrame([], "doc int, n int"), "doc", "n", [10]).count() == 0


def test_skeleton():
    same = [("abc", "аbс"), ("ＡＢ　１", "AB 1"), ("é", "é"), ("ạ́", "ạ́"), ("a​b", "ab"), ("a b", "a b"), ("ｶﾞ", "ガ"), ("q̇͏̣", "q̣̇"), ("﻿x­", "x"), ("Γ", "Г"), ("ПФ", "ΠΦ"), ("ꓐ", "B"), ("ꮪ", "s"), ("ⲟ", "o"), ("к", "k"), ("Ⲅ", "Г")]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("2", "²"), ("a b", "a  b"), ("a b", "a\tb"), ("a\nb", "a b"), ("a.", "a"), ("l", "1")]:
        assert skeleton(a) != skeleton(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable_and_blind_to_composition(text):
    assert skeleton(skeleton(text)) == skeleton(text) == skeleton(unicodedata.normalize("NFC", text))


def test_lookalike_pairs(spark):
    texts = [(1, "price"), (2, "prіce"), (3, "price"), (4, "ｐrice"), (5, "other"), (6, None), (7, ""), (8, "​"), (9, " "), (10, "　"), (11, "x" * 100_000), (12, "х" + "x" * 99_999)]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, skeleton int")
    assert {tuple(r) for r in lookalike_pairs(df, "doc_id").collect()} == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (11, 12)}
    assert [r["skeleton"] for r in with_skeleton(df.filter("doc_id in (2, 6)")).orderBy("doc_id").collect()] == ["price", None]
    assert lookalike_pairs(df.limit(0), "doc_id").count() == 0
