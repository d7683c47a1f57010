"""Layer 4: invariants over the bound test tables (sf0.001) — every request gets exactly one decision, idempotent
jobs change nothing the second time, jobs introduce no new audit violations, the stream equals the batch."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from convops.plans import audits as A
from convops.plans import requests as Q
from convops.plans import rules as J
from convops.plans.registry import RULE_JOBS, run_job
from convops.session import checkpoint_dir
from convops.sources.binding import bind
from convops.streaming.admit_stream import admit_stream, complete_decisions, read_requests, run_to_completion
from tests.conftest import SF001, SF01, rows


@pytest.fixture(scope="module")
def t(spark):
    return bind(spark, SF001)


@pytest.fixture(scope="module")
def t01(spark):
    return bind(spark, SF01)  # two days of messages over many hours: enough micro-batches for the stream tests


@pytest.mark.parametrize("job", RULE_JOBS + ["admit_messages", "add_bookmarks"])
def test_one_decision_per_request(t, job):
    req = getattr(Q, job)(t)
    d = run_job(t, job).decisions
    assert d.count() == req.count()
    assert d.select("req_id").distinct().count() == req.count()
    assert d.where(~F.col("status").isin("accepted", "rejected")).count() == 0
    assert d.where((F.col("status") == "accepted") != F.col("reason").isNull()).count() == 0


def test_archive_is_idempotent(t):
    req = Q.archive_conversations(t)
    once = J.archive_conversations(t, req).tables["conversation"]
    twice = J.archive_conversations(t.replace(conversation=once), req).tables["conversation"]
    assert rows(once) == rows(twice)


def test_mark_paid_is_idempotent(t):
    req = Q.mark_paid(t)
    once = J.mark_paid(t, req).tables["invoice"]
    twice = J.mark_paid(t.replace(invoice=once), req).tables["invoice"]
    assert rows(once) == rows(twice)


@pytest.mark.parametrize("job,audit", [
    ("add_users", A.audit_unique_keys), ("create_personas", A.audit_unique_keys),
    ("add_members", A.audit_primary_keys), ("share_templates", A.audit_primary_keys),
    ("assign_tickets", A.audit_ticket_closed), ("resolve_tickets", A.audit_ticket_closed),
    ("generate_invoices", A.audit_foreign_keys), ("delete_users", A.audit_foreign_keys),
    ("create_workspaces", A.audit_workspace_owner), ("update_users", A.audit_unique_keys),
])
def test_jobs_add_no_audit_violations(t, job, audit):
    before = audit(t)
    after = audit(t.replace(**run_job(t, job).tables))
    assert after.join(before, ["rule", "table", "key", "detail"], "left_anti").count() == 0


def test_admit_messages_never_exceeds_limits(t):
    res = run_job(t, "admit_messages")
    assert A.audit_rate_limit(t.replace(message=res.tables["message"])).count() == 0


def _write_hours(spark, req, root):
    """Write the requests as one file per hour, in time order (each file = one micro-batch)."""
    hour = F.date_trunc("hour", "req_ts")
    hours = [r[0] for r in req.select(hour.alias("h")).distinct().orderBy("h").collect()]
    for i, h in enumerate(hours):
        req.where(hour == F.lit(h)).coalesce(1).write.parquet(os.path.join(root, "source", f"part-{i:04d}"))
    return hours


def test_stream_equals_batch_over_several_micro_batches(spark, t01):
    t = t01
    req = Q.admit_messages(t)
    prior = t.message.join(req.select(F.col("req_id").alias("message_id")), "message_id", "left_anti")
    root = os.path.join(checkpoint_dir(spark), f"stream-test-{uuid.uuid4().hex[:8]}")
    hours = _write_hours(spark, req, root)
    assert len(hours) >= 2
    stream = admit_stream(t, read_requests(spark, os.path.join(root, "source", "*"), max_files_per_trigger=1), prior)
    run_to_completion(stream, os.path.join(root, "sink"), os.path.join(root, "_ckpt"))
    got = complete_decisions(spark, os.path.join(root, "source", "*"), os.path.join(root, "sink"))
    batch = J.admit_messages(t, req, prior).decisions
    cols = ["req_id", "sender_role", "status", "reason"]
    assert rows(got, *cols) == rows(batch, *cols)


def test_stream_reports_late_rows(spark, t01):
    t = t01
    req = Q.admit_messages(t)
    prior = t.message.join(req.select(F.col("req_id").alias("message_id")), "message_id", "left_anti")
    root = os.path.join(checkpoint_dir(spark), f"stream-late-{uuid.uuid4().hex[:8]}")
    user_rows = req.where("role_code = 1 AND conversation_id >= 0")
    first_day = user_rows.agg(F.min(F.to_date("req_ts"))).first()[0]
    early = user_rows.where(F.to_date("req_ts") == F.lit(first_day))
    rest = req.join(early.select("req_id"), "req_id", "left_anti")
    rest.coalesce(1).write.parquet(os.path.join(root, "source", "part-0000"))
    early.coalesce(1).write.parquet(os.path.join(root, "source", "part-0001"))  # arrives after later days
    src = os.path.join(root, "source", "*")
    # with one minute of lateness day 1 is closed once day 2 (up to 01:44) has been seen
    run_to_completion(admit_stream(t, read_requests(spark, src, max_files_per_trigger=1), prior, lateness="1 minute",
                                   lateness_ms=60_000),
                      os.path.join(root, "sink"), os.path.join(root, "_ckpt"))
    got = complete_decisions(spark, src, os.path.join(root, "sink"))
    assert got.count() == req.count()  # nothing lost
    late = got.where("reason = 'late'")
    assert rows(late, "req_id") == rows(early, "req_id") and early.count() > 0
    # everything else is decided as the batch job decides it
    batch = J.admit_messages(t, req, prior).decisions.join(early.select("req_id"), "req_id", "left_anti")
    on_time = got.join(early.select("req_id"), "req_id", "left_anti")
    assert rows(on_time, "req_id", "status", "reason") == rows(batch, "req_id", "status", "reason")
