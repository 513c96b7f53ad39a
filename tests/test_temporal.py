"""Ordered jobs against plain Python, with and without split keys."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from entrylake.operators import temporal as T
from entrylake.operators.skew import chunk_hot_keys, number_rows


def limiter(events, limit, seconds):
    state, out = {}, {}
    for key, ts, eid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        start, n = state.get(key, (None, 0))
        state[key] = (ts, 1) if start is None or ts >= start + seconds else (start, n + 1)
        out[eid] = (state[key][1], state[key][1] <= limit)
    return out


def skewed_events(n, seed, spread):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["warm"] * 3 + [f"k{i}" for i in range(20)]
    return [(rng.choice(keys), rng.randrange(spread), i) for i in range(n)]


def frame(spark, events):
    return spark.createDataFrame(events, "k string, ts long, id long")


@pytest.mark.parametrize("rows_per_chunk", [10**6, 400, 60, 7])
@pytest.mark.parametrize("spread,seconds", [(20000, 60), (300, 60), (40, 60), (20000, 3000)])
def test_rate_limit_equals_replay(spark, rows_per_chunk, spread, seconds):
    events = skewed_events(3000, spread, spread)
    got = T.rate_limit(frame(spark, events), "k", "ts", "id", 5, seconds,
                       rows_per_chunk=rows_per_chunk).collect()
    assert {r["id"]: (r["n"], r["allowed"]) for r in got} == limiter(events, 5, seconds)


def test_rate_limit_regular_hits_across_chunks(spark):
    """Evenly spaced hits: no two entry points of a chunk ever lead to the same window."""
    events = [("hot", i * 7, i) for i in range(2000)]
    got = T.rate_limit(frame(spark, events), "k", "ts", "id", 5, 60, rows_per_chunk=50).collect()
    assert {r["id"]: (r["n"], r["allowed"]) for r in got} == limiter(events, 5, 60)


def test_rate_limit_edges(spark):
    events = [("a", i, i) for i in range(6)] + [("a", 60, 6)]
    got = {r["id"]: r["allowed"] for r in
           T.rate_limit(frame(spark, events), "k", "ts", "id", 5, 60).collect()}
    assert [got[i] for i in range(7)] == [True] * 5 + [False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200)), min_size=1, max_size=120),
       st.integers(1, 50))
def test_window_counts_property(pairs, width):
    pairs.sort()
    run = np.array([p[0] for p in pairs])
    t = np.array([p[1] for p in pairs], dtype=np.int64)
    first = np.append(True, run[1:] != run[:-1])
    start, hits = T.window_counts(t, first, {}, width)
    want = limiter([(k, ts, i) for i, (k, ts) in enumerate(pairs)], 5, width)
    assert hits.tolist() == [want[i][0] for i in range(len(pairs))]
    assert ((t >= start) & (t < start + width)).all()


def test_token_throttle_anchor_is_last_issued(spark):
    events = [("a", 0, 0), ("a", 40, 1), ("a", 70, 2), ("a", 129, 3), ("a", 130, 4)]
    got = {r["id"]: r["allowed"] for r in
           T.token_throttle(frame(spark, events), "k", "ts", "id").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("rows_per_chunk", [10**6, 300, 20])
def test_asof_equals_scan(spark, rows_per_chunk):
    left, right = skewed_events(1500, 1, 5000), skewed_events(700, 2, 5000)
    rights = defaultdict(list)
    for k, ts, i in right:
        rights[k].append((ts, i))
    want = {i: max([r for r in rights[k] if r[0] <= ts], default=None) for k, ts, i in left}
    r = frame(spark, right).selectExpr("k", "ts", "id", "id as rid")
    got = T.asof(frame(spark, left), r, "k", "ts", "id", ["rid"], rows_per_chunk=rows_per_chunk)
    assert {x["id"]: x["match"] and (x["match"]["_t"] // 10**6, x["match"]["rid"])
            for x in got.collect()} == want


def test_asof_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(None, 5, 1), ("a", 5, 2)], "k string, ts long, id long")
    right = spark.createDataFrame([(None, 1, 1), ("", 1, 2)], "k string, ts long, id long")
    got = T.fresh_confirmation(left, right, "k", "ts", "id").collect()
    assert {r["id"]: r["fresh"] for r in got} == {1: False, 2: False}


def test_redeem_outcomes(spark):
    tokens = spark.createDataFrame([("a", 0, 1, "x"), ("a", 100, 2, "y")],
                                   "k string, ts long, id long, token string")
    redeems = spark.createDataFrame(
        [("a", 50, 1, "x"), ("a", 150, 2, "x"), ("a", 3700, 3, "y"), ("a", 3701, 4, "y"),
         ("b", 1, 5, "x")], "k string, ts long, id long, token string")
    got = {r["id"]: r["outcome"] for r in
           T.redeem_tokens(redeems, tokens, "k", "ts", "id").collect()}
    assert got == {1: "ok", 2: "invalid", 3: "ok", 4: "expired", 5: "no_token"}


@pytest.mark.parametrize("rows_per_chunk", [10**6, 300, 20])
@pytest.mark.parametrize("spread", [4000, 400000])
def test_sessionize_equals_scan(spark, rows_per_chunk, spread):
    events = skewed_events(2500, 3, spread)
    want, last = [], {}
    for k, ts, _ in sorted(events):
        if k in last and ts - last[k][1] < 600:
            last[k][1], last[k][2] = ts, last[k][2] + 1
        else:
            last[k] = [ts, ts, 1]
            want.append((k, last[k]))
    want = sorted((k, *v) for k, v in want)
    got = T.sessionize(frame(spark, events), "k", "ts", "id", minutes=10,
                       rows_per_chunk=rows_per_chunk).collect()
    assert sorted(tuple(r) for r in got) == want


def test_session_gap_edge(spark):
    events = [("a", 0, 0), ("a", 7200, 1), ("b", 0, 2), ("b", 7199, 3)]
    got = T.sessionize(frame(spark, events), "k", "ts", "id").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 2, "b": 1}


def test_expiry_edge_is_live(spark):
    rows = spark.createDataFrame([("s", 1, 1000)], "id string, user_id long, last_activity long")
    at = lambda now: T.session_status(rows, now).first()["live"]
    assert at(1000 + 7200) == 1 and at(1000 + 7201) == 0
    assert T.live_sessions(rows, 8200).count() == 1 and T.live_sessions(rows, 8201).count() == 0


def test_hot_key_is_spread(spark):
    events = frame(spark, skewed_events(3000, 5, 9))
    chunked = chunk_hot_keys(events, "k", ["ts", "id"], rows_per_chunk=100)
    sizes = chunked.df.groupBy("k", "_chunk").count()
    assert sizes.agg({"count": "max"}).first()[0] < 300
    assert chunked.df.count() == 3000
    spans = (chunked.df.groupBy("k", "_chunk").agg({"ts": "max"}).orderBy("k", "_chunk").collect())
    for a, b in zip(spans, spans[1:]):
        assert a["k"] != b["k"] or a["max(ts)"] <= b["max(ts)"]


@pytest.mark.parametrize("rows_per_chunk", [10**6, 90])
def test_number_rows(spark, rows_per_chunk):
    df = frame(spark, skewed_events(2000, 6, 50))
    got = number_rows(df, ["ts", "id"], "rn", rows_per_chunk).orderBy("ts", "id").collect()
    assert [r["rn"] for r in got] == list(range(1, 2001))


@pytest.mark.parametrize("rows_per_chunk", [10**6, 50])
@pytest.mark.parametrize("spread", [20000, 300])
def test_rate_limit_goes_on_from_open_windows(spark, rows_per_chunk, spread):
    events = skewed_events(2000, spread + 1, spread)
    want = limiter(events, 5, 60)
    early = [e for e in events if e[1] < spread // 2]
    late = [e for e in events if e[1] >= spread // 2]
    none = spark.createDataFrame([], "key string, start long, hits long")
    options = {"rows_per_chunk": rows_per_chunk}
    first = T.rate_limit(frame(spark, early), "k", "ts", "id", 5, 60, opened=none, **options).collect()
    last = {}
    for r in sorted(first, key=lambda r: (r["ts"], r["id"])):
        last[r["k"]] = (r["k"], r["start"], r["n"])
    opened = spark.createDataFrame(list(last.values()), "key string, start long, hits long")
    second = T.rate_limit(frame(spark, late), "k", "ts", "id", 5, 60, opened=opened, **options).collect()
    assert {r["id"]: (r["n"], r["allowed"]) for r in first + second} == want
