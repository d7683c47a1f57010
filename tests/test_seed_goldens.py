"""Layer 1: the reference's seed rows, each report compared with the hand-derived answers (FIXTURES.md §2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from convops.plans import audits as A
from convops.plans import reports as R
from convops.plans import rules as J
from tests.conftest import rows


def test_bookmarks(seed):
    assert rows(R.bookmarks(seed), "user_id", "conversation", "message_preview", "bookmarked") == [
        (1, "Microservices Discussion", "pros: cool. cons: expensive", "2024-04-02 08:00")]
    assert R.bookmarks(seed, user_id=2).count() == 0


def test_unpaid_invoices_both_forms(seed):
    expected = [(3, "eva@example.com", 100.0, dt.datetime(2024, 4, 1, 10, 0))]
    assert rows(R.unpaid_invoices(seed)) == expected
    assert rows(R.unpaid_invoices_as_written(seed)) == expected


def test_best_persona_and_helpfulness(seed):
    assert rows(R.best_persona(seed), "persona", "thumbs_up_pct", "total_ratings") == [("SWE", 100.0, 1)]
    assert rows(R.persona_helpfulness(seed), "persona", "thumbs_up_pct", "total_ratings") == [
        ("SWE", 100.0, 1), ("writer", 0.0, 1)]


def test_persona_conversations(seed):
    got = rows(R.persona_conversations(seed), "conversation_id", "user_id", "persona_name_snapshot", "ai_message_count")
    assert got == [(1, 3, "SWE", 1), (2, 1, "writer", 1)]
    assert R.persona_conversations(seed, user_id=2).count() == 0
    assert rows(R.nonpersona_conversations(seed), "conversation_id", "ai_message_count") == [(3, 1)]


def test_top_personas_by_tier(seed):
    got = rows(R.top_personas_by_tier(seed), "tier_name", "persona_name", "owner_email", "tier_user_count",
               "thumbs_up_pct")
    assert got == [("Enterprise", "SWE", "eva@example.com", 1, 100.0), ("Free", "writer", "eva@example.com", 1, 0.0)]
    assert R.top_personas_by_tier(seed, tier_name="Plus").count() == 0


def test_lists(seed):
    assert rows(R.list_users(seed), "user_id", "name", "tier_name") == [
        (1, "Carol", "Free"), (2, "Dave", "Plus"), (3, "Eva", "Enterprise")]
    assert rows(R.open_tickets(seed)) == [(1, "carol@example.com", None, "Billing", "2024-07-10 10:00", "Open")]
    members = [tuple(r) for r in R.workspace_members(seed, workspace_id=1).select("user_id", "name", "role").collect()]
    assert members == [(2, "Dave", "MEMBER"), (3, "Eva", "OWNER")]  # ordered by role, then name
    assert rows(R.ticket_resolution(seed), "ticket_id", "resolution_hours") == [(1, None), (2, 26.0)]
    assert rows(R.list_tiers(seed, with_cost=False)) == [(1, "Free"), (2, "Plus"), (3, "Enterprise")]
    assert rows(R.user_invoices(seed, user_id=3), "invoice_id", "tier_name", "invoice_day") == [
        (2, "Enterprise", "2024-04-01")]


def test_delete_users_guards(seed):
    req = seed.spark.createDataFrame([(i, dt.datetime(2024, 8, 1), i, "YES") for i in (1, 2, 3)],
                                     "req_id long, req_ts timestamp_ntz, user_id long, confirm string")
    got = rows(J.delete_users(seed, req).decisions, "user_id", "status", "reason")
    assert got == [(1, "rejected", "open_ticket"), (2, "accepted", None), (3, "rejected", "unpaid_invoice")]


def test_delete_personas_guard(seed):
    req = seed.spark.createDataFrame([(i, dt.datetime(2024, 8, 1), i, "YES") for i in (1, 2)],
                                     "req_id long, req_ts timestamp_ntz, persona_id long, confirm string")
    res = J.delete_personas(seed, req)
    assert rows(res.decisions, "persona_id", "status", "active_count") == [(1, "accepted", 1), (2, "accepted", 1)]
    conv = res.tables["conversation"]
    # persona ids are nulled, snapshots kept
    assert rows(conv, "conversation_id", "persona_id", "persona_name_snapshot") == [
        (1, None, "SWE"), (2, None, "writer"), (3, None, None)]


def test_generate_invoices(seed):
    req = seed.spark.createDataFrame([(i, dt.datetime(2024, 8, 1), i) for i in (1, 2, 3)],
                                     "req_id long, req_ts timestamp_ntz, user_id long")
    got = rows(J.generate_invoices(seed, req).decisions, "user_id", "tier_id", "amount", "payment_status", "invoice_id")
    assert got == [(1, 1, 0.0, "Paid", 3), (2, 2, 20.0, "Unpaid", 4), (3, 3, 100.0, "Unpaid", 5)]


def test_clean_audits_on_seed(seed):
    for fn in (A.audit_billing_total, A.audit_workspace_access, A.audit_rate_limit, A.audit_primary_keys,
               A.audit_foreign_keys, A.audit_enums, A.audit_ticket_closed, A.audit_private_shared, A.audit_fds,
               A.audit_not_null, A.audit_unique_keys, A.audit_lengths, A.audit_workspace_owner,
               A.audit_feedback_role, A.persona_snapshot_drift):
        assert fn(seed).count() == 0, fn.__name__


def test_seed_admits_all_messages(seed):
    req = seed.message.select(F.col("message_id").alias("req_id"), F.col("time_sent").alias("req_ts"),
                              "conversation_id", F.when(F.col("sender_role") == "USER", 1).otherwise(2).alias("role_code"),
                              "content")
    prior = seed.message.where(F.lit(False))
    assert J.admit_messages(seed, req, prior).rejected.count() == 0
