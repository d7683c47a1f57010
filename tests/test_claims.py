"""Unique values taken and freed within a batch, against a row-by-row loop."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from convops.operators import claims
from convops.operators.claims import resolve_claims
from convops.operators.scans import in_runs, running
from convops.streaming.admit_stream import _decide_group

T0 = dt.datetime(2024, 1, 1)
REQUESTS = "req_id long, req_ts timestamp_ntz, owner long, value string"


def one_by_one(requests, holders):
    own = dict(holders)
    out = {}
    for ts, req_id, owner, value in sorted(requests):
        taken = any(v == value and o != owner for o, v in own.items())
        out[req_id] = not taken
        if not taken:
            own[owner] = value
    return out


def decided(spark, requests, holders, small_rows=0):
    df = spark.createDataFrame([(i, ts, o, v) for ts, i, o, v in requests], REQUESTS)
    got = resolve_claims(df, spark.createDataFrame(holders, "owner long, value string"), small_rows).collect()
    assert len(got) == len(requests)
    return {r.req_id: r.granted for r in got}


@pytest.fixture
def rounds(monkeypatch):
    seen = []
    own = claims._round
    monkeypatch.setattr(claims, "_round", lambda rows: seen.append(1) or own(rows))
    return seen


@pytest.mark.parametrize("seed, small_rows", [(1, 0), (3, 10_000), (7, 40)])
def test_equals_a_loop(spark, monkeypatch, seed, small_rows):
    monkeypatch.setattr(claims, "RUN_ROWS", 20 if seed == 7 else 100_000)  # several runs
    rng = random.Random(seed)
    owners, values, n = rng.choice([(4, 4, 40), (14, 16, 60), (30, 8, 90), (3, 9, 50)])
    holders = [(o, f"v{o}") for o in range(min(owners, values) - 2)]
    requests = [(T0 + dt.timedelta(minutes=rng.randrange(30)), i, rng.randrange(owners),
                 "v0" if rng.random() < 0.3 else f"v{rng.randrange(values)}") for i in range(n)]
    assert decided(spark, requests, holders, small_rows) == one_by_one(requests, holders)


def test_many_small_parts_take_no_round(spark, rounds):
    rng = random.Random(2)
    holders = [(o, f"p{o // 4}v{o % 4}") for o in range(400)]
    requests = [(T0 + dt.timedelta(seconds=i), i, o, f"p{o // 4}v{rng.randrange(5)}")
                for i, o in enumerate(rng.choices(range(400), k=1500))]
    requests += [(T0 + dt.timedelta(seconds=5000 + o), 5000 + o, o, f"own{o}") for o in range(400)]
    assert decided(spark, requests, holders, 600) == one_by_one(requests, holders) and not rounds


def test_values_held_by_several(spark):
    holders = [(1, "a"), (2, "a"), (3, "b")]
    requests = [(T0, i, o, v) for i, (o, v) in enumerate([(3, "a"), (1, "c"), (3, "a"), (2, "d"), (3, "a"), (1, "b"), (1, "a")])]
    assert decided(spark, requests, holders) == one_by_one(requests, holders)


def test_no_requests(spark):
    df = spark.createDataFrame([], REQUESTS)
    assert resolve_claims(df, spark.createDataFrame([(1, "a")], "owner long, value string")).count() == 0


@pytest.mark.parametrize("first_is_free", [True, False])
def test_a_long_chain_takes_few_rounds(spark, rounds, first_is_free):
    """Owner i wants what i + 1 holds, who left for what i + 2 holds a moment before."""
    n = 300
    holders = [(i, f"v{i}") for i in range(n)] + ([] if first_is_free else [(n, f"v{n}")])
    requests = [(T0 + dt.timedelta(seconds=n - i), i, i, f"v{i + 1}") for i in range(n)]
    got = decided(spark, requests, holders)
    assert got == one_by_one(requests, holders) and set(got.values()) == {first_is_free}
    assert len(rounds) <= 3


def test_a_value_through_many_hands_takes_few_rounds(spark, rounds):
    """Everyone asks for one value and leaves it again later, while others ask in vain."""
    rng = random.Random(4)
    requests, n = [], 300
    for o in range(n):
        at = rng.randrange(20_000)
        requests.append((T0 + dt.timedelta(seconds=at), 2 * o, o, "hot"))
        requests.append((T0 + dt.timedelta(seconds=at + rng.randrange(1, 300)), 2 * o + 1, o, f"own{o}"))
    got = decided(spark, requests, [(-1, "x")])
    assert got == one_by_one(requests, [(-1, "x")])
    assert 40 < sum(got[2 * o] for o in range(n)) < 200 and len(rounds) <= 5


def test_a_hot_owner_and_a_hot_held_value(spark, rounds):
    rng = random.Random(9)
    requests = [(T0 + dt.timedelta(seconds=i), i, 0, f"v{rng.randrange(6)}") for i in range(150)]
    requests += [(T0 + dt.timedelta(seconds=2 * i, milliseconds=500), 1000 + i, 1 + i, "held") for i in range(150)]
    got = decided(spark, requests, [(999, "held")])
    assert got == one_by_one(requests, [(999, "held")]) and len(rounds) <= 3


def test_running_extremes_equal_a_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", i, rng.choice([None, rng.randrange(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, x long")
    runs = in_runs(df, ["g"], "at", 5)
    assert runs.where("g = 'hot'").select("__run").distinct().count() > 1
    for largest, following in [(True, False), (False, True), (True, True)]:
        got = running(runs, 5, ["g"], "at", {"y": F.col("x")}, largest=largest, following=following)
        alone = running(in_runs(df, ["g"], "at", 1), 1, ["g"], "at", {"y": F.col("x")}, largest=largest, following=following)
        want = {}
        for g, at, _ in rows:
            near = [x for h, a, x in rows if h == g and x is not None and (a > at if following else a < at)]
            want[at] = (max if largest else min)(near) if near else None
        assert {r["at"]: r["y"] for r in got.collect()} == want == {r["at"]: r["y"] for r in alone.collect()}


def test_blank_rows_of_a_user_day_are_decided_chunk_by_chunk():
    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, ms):
            pass
    rows = [(i, 1, "USER", T0 + dt.timedelta(seconds=i), 3, 0, i % 4 == 0) for i in range(40)]
    names = ["req_id", "conversation_id", "sender_role", "req_ts", "message_limit", "prior_n", "written"]
    chunks = [pd.DataFrame(rows[s:s + 10], columns=names) for s in (20, 0, 30, 10)]
    state = State()
    out = list(_decide_group(0)((1, T0.date()), iter(chunks), state))
    assert max(map(len, out)) <= 10 and state.value == (3,)
    got = {r.req_id: (r.status, r.reason) for r in pd.concat(out).itertuples()}
    assert got == {i: ("accepted", None) if i in (0, 4, 8) else ("rejected", "null" if i < 8 else "rate_limit") for i in range(40)}


@pytest.mark.parametrize("turn_rows", [500_000, 70])
def test_few_owners_of_few_values_take_turns(spark, rounds, turn_rows):
    """Every request waits for several undecided ones: rounds alone would take one for each step."""
    rng = random.Random(11)
    holders = [(o, f"v{o % 3}") for o in range(5)] + [(o, "v1") for o in range(20, 40)]  # some never move
    requests = [(T0 + dt.timedelta(seconds=i), i, rng.randrange(5), f"v{rng.randrange(4)}" if rng.random() < 0.7 else f"own{i}")
                for i in range(400)]
    df = spark.createDataFrame([(i, ts, o, v) for ts, i, o, v in requests], REQUESTS)
    got = resolve_claims(df, spark.createDataFrame(holders, "owner long, value string"), 20, turn_rows).collect()
    assert {r.req_id: r.granted for r in got} == one_by_one(requests, holders)
    assert len(got) == len(requests) and len(rounds) <= 3
