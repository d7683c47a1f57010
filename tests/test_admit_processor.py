"""The limiter as a stateful processor: initial counts, stored messages, timers, late rows, restarts."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import pytest

from convops.plans import rules as J
from convops.session import checkpoint_dir
from convops.sources.schemas import SCHEMAS
from convops.streaming.admit_processor import admit_processor
from convops.streaming.admit_stream import REQUEST_SCHEMA, read_requests, run_to_completion
from tests.conftest import SEED_ROWS, make_tables, rows, ts

DAY = ts("2024-08-01 10:00:00")
COLS = ("req_id", "conversation_id", "sender_role", "status", "reason")


@pytest.fixture
def root(spark):
    return os.path.join(checkpoint_dir(spark), f"processor-{uuid.uuid4().hex[:8]}")


def asked(n, start=1, conversation=2, role=1, at=DAY, text="hi"):
    return [(start + i, at + dt.timedelta(seconds=i), conversation, role, text) for i in range(n)]


def put(spark, root, part, requests):
    spark.createDataFrame(requests, REQUEST_SCHEMA).coalesce(1).write.parquet(f"{root}/source/part-{part:04d}")


def put_stored(spark, root, part, n, conversation, at, start=10_000):
    columns = SCHEMAS["message"]
    made = [{"message_id": start + i, "conversation_id": conversation, "sender_role": "USER", "time_sent": at,
             "content": "x"} for i in range(n)]
    spark.createDataFrame([tuple(m.get(f.name) for f in columns) for m in made], columns) \
        .coalesce(1).write.parquet(f"{root}/stored/part-{part:04d}")


def go(spark, root, t, stored=False, **how):
    if stored:
        how["stored"] = spark.readStream.schema(SCHEMAS["message"]).parquet(f"{root}/stored/*")
    run_to_completion(admit_processor(t, read_requests(spark, f"{root}/source/*", max_files_per_trigger=1), **how),
                      f"{root}/sink", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/sink")


def batch_job(spark, t, requests):
    return J.admit_messages(t, spark.createDataFrame(requests, REQUEST_SCHEMA)).decisions


def limit_of(t, conversation):
    return (t.conversation.where(f"conversation_id = {conversation}").join(t.llm_user, "user_id").join(t.tier, "tier_id")
            .first()["message_limit"])


def test_equals_the_batch_job_over_batches_and_a_restart(spark, root):
    t = make_tables(spark, SEED_ROWS)
    n = limit_of(t, 2)
    hours = [DAY + dt.timedelta(hours=h) for h in range(4)]
    parts = [asked(n - 10) + asked(3, 5_000, 99), asked(6, 6_000, at=hours[1], text=" ") + asked(5, 7_000, 1, 2, hours[1]),
             asked(20, 8_000, at=hours[2]) + asked(20, 9_000, at=hours[2], text=""), asked(4, 9_500, at=hours[3])]
    put(spark, root, 0, parts[0])
    put(spark, root, 1, parts[1])
    go(spark, root, t)
    put(spark, root, 2, parts[2])
    put(spark, root, 3, parts[3])
    got = go(spark, root, t)
    want = batch_job(spark, t, sum(parts, []))
    assert rows(got, *COLS) == rows(want, *COLS)
    assert {r["reason"] for r in got.select("reason").distinct().collect()} == {None, "no_conversation", "null", "rate_limit"}


def test_counts_start_from_the_messages_that_are_there(spark, root):
    t = make_tables(spark, SEED_ROWS)
    n = limit_of(t, 2)
    put(spark, root, 0, asked(5))
    prior = spark.createDataFrame([(i, 2, "USER", DAY, "x") for i in range(n - 2)],
                                  "message_id long, conversation_id long, sender_role string, time_sent timestamp_ntz, content string")
    got = go(spark, root, t, prior=prior)
    assert rows(got.where("status = 'accepted'"), "req_id") == [(1,), (2,)]
    assert got.where("reason = 'rate_limit'").count() == 3


def test_messages_stored_by_others_count_after_a_restart(spark, root):
    t = make_tables(spark, SEED_ROWS)
    n = limit_of(t, 2)
    put(spark, root, 0, asked(1))
    put_stored(spark, root, 0, 1, 2, DAY)
    assert go(spark, root, t, stored=True).where("status = 'accepted'").count() == 1
    put_stored(spark, root, 1, n - 5, 2, DAY, start=20_000)  # 1 admitted, 1 + n - 5 stored: three are left
    put(spark, root, 1, asked(6, 100, at=DAY + dt.timedelta(hours=1)))
    got = go(spark, root, t, stored=True)
    assert got.count() == 7
    assert rows(got.where("status = 'accepted' AND req_id >= 100"), "req_id") == [(100,), (101,), (102,)]


def test_a_closed_day_is_answered_late_and_its_state_goes(spark, root):
    t = make_tables(spark, SEED_ROWS)
    put(spark, root, 0, asked(3))
    put(spark, root, 1, asked(2, 100, at=DAY + dt.timedelta(days=1)))
    put(spark, root, 2, asked(4, 200) + asked(2, 300, text=" ") + asked(2, 400, 99))
    got = go(spark, root, t, lateness=dt.timedelta(minutes=1))
    assert got.count() == 13
    assert rows(got.where("reason = 'late'"), "req_id") == [(i,) for i in (200, 201, 202, 203, 300, 301)]
    assert got.where("reason = 'no_conversation'").count() == 2
    state = (spark.read.format("statestore").option("stateVarName", "used").load(f"{root}/_checkpoint"))
    assert [str(r["day"]) for r in state.select("key.day").collect()] == ["2024-08-02"]
