"""The batch-by-batch limiter: equal to the batch job, over restarts, late rows and tables that change."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import pytest

from convops.plans import rules as J
from convops.session import checkpoint_dir
from convops.streaming import admit_batches as B
from convops.streaming.admit_stream import REQUEST_SCHEMA, read_requests
from tests.conftest import SEED_ROWS, make_tables, rows, ts

DAY = ts("2024-08-01 10:00:00")


@pytest.fixture
def root(spark):
    return os.path.join(checkpoint_dir(spark), f"batches-{uuid.uuid4().hex[:8]}")


def asked(n, start=1, conversation=2, role=1, at=DAY, text="hi"):
    return [(start + i, at + dt.timedelta(seconds=i), conversation, role, text) for i in range(n)]


def put(spark, root, part, requests):
    spark.createDataFrame(requests, REQUEST_SCHEMA).coalesce(1).write.parquet(f"{root}/source/part-{part:04d}")


def go(spark, root, tables, **how):
    source = read_requests(spark, f"{root}/source/*", max_files_per_trigger=1)
    return B.admit_in_batches(source, root, tables, **how)


def batch_job(spark, t, requests):
    return J.admit_messages(t, spark.createDataFrame(requests, REQUEST_SCHEMA)).decisions


COLS = ("req_id", "conversation_id", "sender_role", "status", "reason")


def test_equals_the_batch_job_over_a_failure_and_restarts(spark, root, monkeypatch):
    t = make_tables(spark, SEED_ROWS)
    parts = [asked(60), asked(30, 100, at=DAY + dt.timedelta(hours=1)) + asked(5, 200, 1, 2, DAY + dt.timedelta(hours=1)),
             asked(40, 300, at=DAY + dt.timedelta(hours=2)) + asked(3, 400, 99, at=DAY + dt.timedelta(hours=2))
             + asked(4, 500, at=DAY + dt.timedelta(hours=2), text="  "), asked(6, 600, at=DAY + dt.timedelta(hours=30))]
    put(spark, root, 0, parts[0])
    assert go(spark, root, lambda s: t).count() == 60
    put(spark, root, 1, parts[1])
    put(spark, root, 2, parts[2])
    own, calls = B._before, []

    def fails_once(*a):
        calls.append(a)
        if len(calls) == 2:  # the third batch
            raise RuntimeError("lost")
        return own(*a)
    monkeypatch.setattr(B, "_before", fails_once)
    with pytest.raises(Exception, match="lost"):
        go(spark, root, lambda s: t)
    # half of its decisions were already written
    spark.createDataFrame([(1, 1, "USER", "accepted", None)], "req_id long, conversation_id long, sender_role string, "
                          "status string, reason string").write.parquet(f"{root}/decisions/batch_id=2")
    put(spark, root, 3, parts[3])
    got = go(spark, root, lambda s: t)
    want = batch_job(spark, t, sum(parts, []))
    assert rows(got, *COLS) == rows(want, *COLS)
    reasons = {r["reason"] for r in got.collect()}
    assert reasons == {None, "rate_limit", "no_conversation", "null"} or reasons == {None, "rate_limit", "no_conversation"}
    assert rows(go(spark, root, lambda s: t), *COLS) == rows(want, *COLS)  # nothing new: nothing changes


def test_a_batch_that_runs_again_gives_the_same(spark, root):
    t = make_tables(spark, SEED_ROWS)
    B.write_start(root, t)
    first, second = (spark.createDataFrame(r, REQUEST_SCHEMA) for r in (asked(80), asked(50, 100, at=DAY + dt.timedelta(hours=1))))
    B.decide_batch(first, 0, root, t, "1 hour")
    B.decide_batch(second, 1, root, t, "1 hour")
    once = rows(B.decisions(spark, root), *COLS)
    B.decide_batch(second, 1, root, t, "1 hour")
    assert rows(B.decisions(spark, root), *COLS) == once and sum(r[3] == "accepted" for r in once) == 100
    with pytest.raises(RuntimeError, match="no counts"):
        B.decide_batch(second, 7, root, t, "1 hour")


def test_sees_conversations_made_after_its_start(spark, root):
    old = make_tables(spark, SEED_ROWS)
    new = make_tables(spark, SEED_ROWS | {"conversation": SEED_ROWS["conversation"] + [
        (4, 1, None, None, "Later", DAY, "ACTIVE", None, None)]})
    put(spark, root, 0, asked(2, 1, 4))
    assert {r["reason"] for r in go(spark, root, lambda s: old).collect()} == {"no_conversation"}
    put(spark, root, 1, asked(2, 10, 4, at=DAY + dt.timedelta(hours=1)))
    got = {r["req_id"]: r["status"] for r in go(spark, root, lambda s: new).collect()}
    assert got == {1: "rejected", 2: "rejected", 10: "accepted", 11: "accepted"}


def test_late_rows_and_closed_days(spark, root):
    t = make_tables(spark, SEED_ROWS)
    next_day = DAY + dt.timedelta(days=1)
    put(spark, root, 0, asked(3))
    put(spark, root, 1, asked(3, 10, at=next_day))
    put(spark, root, 2, asked(3, 20) + asked(2, 30, 3) + asked(2, 40, at=next_day) + asked(1, 50, role=2))
    got = {r["req_id"]: r["reason"] for r in go(spark, root, lambda s: t, lateness="1 hour").collect()}
    # conversations 2 and 3 have limits; an AI row has none and is never late
    assert {i for i, r in got.items() if r == "late"} == {20, 21, 22, 30, 31} and got[50] is None and got[40] is None
    left = spark.read.schema(B.COUNTS).parquet(f"{root}/counts/2").where("owner_id IS NOT NULL").collect()
    assert {(r["owner_id"], str(r["day"]), r["n"]) for r in left if r["day"] >= DAY.date()} == {(1, str(next_day.date()), 5)}


def test_no_requests(spark, root):
    t = make_tables(spark, SEED_ROWS)
    B.write_start(root, t)
    B.decide_batch(spark.createDataFrame([], REQUEST_SCHEMA), 0, root, t, "1 hour")
    assert B.decisions(spark, root).count() == 0
    start = spark.read.schema(B.COUNTS).parquet(f"{root}/counts/start")
    after = spark.read.schema(B.COUNTS).parquet(f"{root}/counts/0").where("owner_id IS NOT NULL")
    assert rows(after, "owner_id", "day", "n") == rows(start, "owner_id", "day", "n")
