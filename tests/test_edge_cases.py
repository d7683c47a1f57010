
from __future__ import annotations

import copy
import datetime as dt

from convops.plans import reports as R
from convops.plans import rules as J
from tests.conftest import SEED_ROWS, D, make_tables, rows, ts

T0 = dt.datetime(2024, 8, 1, 9, 0)


def _with(spark, **changes):
    data = copy.deepcopy(SEED_ROWS)
    for name, value in changes.items():
        data[name] = value
    return make_tables(spark, data)


def _req(spark, schema, items):
    return spark.createDataFrame(items, schema)


def test_q2_fan_out(spark):
    # Eva (user 3) owes 100 on one invoice and has two conversations: the literal SQL doubles it
    convs = SEED_ROWS["conversation"] + [(4, 3, None, None, "Again", ts("2024-05-01 10:00:00"), "ACTIVE", None, None)]
    t = _with(spark, conversation=convs)
    assert rows(R.unpaid_invoices(t), "user_id", "total_owed") == [(3, 100.0)]
    assert rows(R.unpaid_invoices_as_written(t), "user_id", "total_owed") == [(3, 200.0)]


def test_q3_ties_break_by_ratings_then_id(spark):
    # both personas at 100 %: persona 2 has more ratings and wins; with equal ratings the lower id wins
    fb = [(1, 2, "Thumbs Up", None, ts("2024-04-01 10:05:00")), (2, 4, "Thumbs Up", None, ts("2024-06-25 14:05:00"))]
    msgs = SEED_ROWS["message"] + [(7, 2, "AI", ts("2024-06-25 14:02:00"), "more")]
    t = _with(spark, message_feedback=fb + [(3, 7, "Thumbs Up", None, ts("2024-06-25 14:06:00"))], message=msgs)
    assert rows(R.best_persona(t), "persona_id") == [(2,)]
    t2 = _with(spark, message_feedback=fb)
    assert rows(R.best_persona(t2), "persona_id") == [(1,)]


def test_q4_zero_ai_messages_vanish(spark):
    msgs = [m for m in SEED_ROWS["message"] if m[0] != 2]  # conversation 1 loses its only AI message
    t = _with(spark, message=msgs, message_feedback=[], message_bookmark=[])
    assert rows(R.persona_conversations(t), "conversation_id") == [(2,)]


def test_delete_personas_five_vs_six_active(spark):
    base = SEED_ROWS["conversation"]
    extra = [(10 + i, 1, None, 1, f"c{i}", ts("2024-05-01 10:00:00"), "ACTIVE", "SWE", "x") for i in range(4)]
    t5 = _with(spark, conversation=base + extra)  # persona 1: 1 + 4 = 5 active -> deletable
    t6 = _with(spark, conversation=base + extra + [(20, 1, None, 1, "c", ts("2024-05-01"), "ACTIVE", "SWE", "x")])
    req = _req(spark, "req_id long, req_ts timestamp_ntz, persona_id long, confirm string", [(1, T0, 1, "YES")])
    assert rows(J.delete_personas(t5, req).decisions, "status", "active_count") == [("accepted", 5)]
    assert rows(J.delete_personas(t6, req).decisions, "reason", "active_count") == [("active_conversations", 6)]


def test_rate_limit_reached_exactly(spark):
    # Free tier limited to 2 USER messages a day; user 1 already sent one today (message 3's day)
    tiers = [(1, "Free", D(0), 2, "N")] + SEED_ROWS["tier"][1:]
    t = _with(spark, tier=tiers)
    day = dt.datetime(2024, 6, 25, 15, 0)
    req = _req(spark, "req_id long, req_ts timestamp_ntz, conversation_id long, role_code long, content string",
               [(100, day, 2, 1, "a"), (101, day + dt.timedelta(minutes=1), 2, 2, "ai"),
                (102, day + dt.timedelta(minutes=2), 2, 1, "b"), (103, day + dt.timedelta(minutes=3), 2, 1, "c"),
                (104, day + dt.timedelta(days=1), 2, 1, "next day"), (105, day, 99, 1, "nowhere")])
    got = rows(J.admit_messages(t, req).decisions, "req_id", "sender_role", "status", "reason")
    assert got == [(100, "USER", "accepted", None), (101, "AI", "accepted", None),
                   (102, "USER", "rejected", "rate_limit"), (103, "USER", "rejected", "rate_limit"),
                   (104, "USER", "accepted", None), (105, "USER", "rejected", "no_conversation")]


def test_rate_limit_counts_all_conversations_of_the_owner(spark):
    tiers = [(1, "Free", D(0), 1, "N")] + SEED_ROWS["tier"][1:]
    convs = SEED_ROWS["conversation"] + [(4, 1, None, None, "second", ts("2024-06-25 09:00:00"), "ACTIVE", None, None)]
    t = _with(spark, tier=tiers, conversation=convs)
    day = dt.datetime(2024, 6, 26, 8, 0)
    req = _req(spark, "req_id long, req_ts timestamp_ntz, conversation_id long, role_code long, content string",
               [(1, day, 2, 1, "x"), (2, day + dt.timedelta(minutes=1), 4, 1, "y")])
    assert rows(J.admit_messages(t, req).decisions, "req_id", "status") == [(1, "accepted"), (2, "rejected")]


def test_zero_cost_tier_is_paid(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, user_id long", [(1, T0, 1), (2, T0, 42)])
    got = rows(J.generate_invoices(seed, req).decisions, "req_id", "status", "reason", "payment_status")
    assert got == [(1, "accepted", None, "Paid"), (2, "rejected", "no_user", None)]


def test_blank_text_is_null(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, owner_user_id long, name string, instructions string",
               [(1, T0, 1, "   ", "x"), (2, T0, 1, "ok", ""), (3, T0, 1, "ok", "fine")])
    got = rows(J.create_personas(seed, req).decisions, "req_id", "status", "reason")
    assert got == [(1, "rejected", "null"), (2, "rejected", "null"), (3, "accepted", None)]


def test_feedback_blank_comment_and_upsert(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, message_id long, rating_code long, comment string",
               [(1, T0, 2, 2, "  "), (2, T0 + dt.timedelta(minutes=1), 6, 1, "good"),
                (3, T0 + dt.timedelta(minutes=2), 6, 2, "changed my mind"), (4, T0, 1, 1, "user msg"),
                (5, T0, 77, 1, "missing")])
    res = J.upsert_feedback(seed, req)
    got = rows(res.decisions, "req_id", "status", "reason", "action", "feedback_id", "comment_text")
    assert got == [(1, "accepted", None, "update", 1, None), (2, "accepted", None, "insert", 3, "good"),
                   (3, "accepted", None, "update", 3, "changed my mind"), (4, "rejected", "not_ai", None, None, None),
                   (5, "rejected", "no_message", None, None, None)]
    assert rows(res.tables["message_feedback"], "feedback_id", "message_id", "rating") == [
        (1, 2, "Thumbs Down"), (2, 4, "Thumbs Down"), (3, 6, "Thumbs Down")]


def test_closed_ticket_cannot_be_assigned(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, ticket_id long, agent_id long",
               [(1, T0, 2, 2), (2, T0, 1, 2), (3, T0, 1, 9), (4, T0, 9, 1)])
    res = J.assign_tickets(seed, req)
    assert rows(res.decisions, "req_id", "reason") == [(1, "closed"), (2, None), (3, "no_agent"), (4, "no_ticket")]
    assert rows(res.tables["support_ticket"], "ticket_id", "agent_id", "status") == [
        (1, 2, "In Progress"), (2, 1, "Resolved")]


def test_resolve_overwrites_closed_time(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, ticket_id long, status_code long",
               [(1, T0, 2, 2), (2, T0, 1, 1)])
    out = J.resolve_tickets(seed, req).tables["support_ticket"]
    assert rows(out, "ticket_id", "status", "closed_time") == [(1, "Resolved", T0), (2, "Escalated", T0)]


def test_unknown_persona_continues_unknown_workspace_rejects(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, user_id long, title string, persona_id long, "
                           "workspace_id long",
               [(1, T0, 1, "a", 99, None), (2, T0, 1, "b", 1, 99), (3, T0, 1, "c", 2, 1), (4, T0, 9, "d", 1, None)])
    got = rows(J.start_conversations(seed, req).decisions, "req_id", "status", "reason", "persona_id",
               "persona_name_snapshot", "conversation_id")
    assert got == [(1, "accepted", None, None, None, 4), (2, "rejected", "no_workspace", None, None, None),
                   (3, "accepted", None, 2, "writer", 5), (4, "rejected", "no_user", None, None, None)]


def test_duplicate_requests_in_one_batch(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, user_id long, message_id long",
               [(1, T0, 2, 4), (2, T0 + dt.timedelta(seconds=1), 2, 4), (3, T0, 1, 2), (4, T0, 3, 99)])
    got = rows(J.add_bookmarks(seed, req).decisions, "req_id", "reason")
    assert got == [(1, None), (2, "duplicate"), (3, "duplicate"), (4, "no_message")]


def test_share_private_and_already_shared_order(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, template_id long, workspace_id long",
               [(1, T0, 1, 1), (2, T0, 2, 1), (3, T0, 9, 1), (4, T0, 1, 9)])
    got = rows(J.share_templates(seed, req).decisions, "req_id", "reason")
    assert got == [(1, "already_shared"), (2, "private"), (3, "no_template"), (4, "no_workspace")]


def test_move_requires_owner_membership(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, conversation_id long, workspace_id long",
               [(1, T0, 1, 1), (2, T0, 2, 1), (3, T0, 3, 1)])
    res = J.move_conversations(seed, req)
    assert rows(res.decisions, "req_id", "reason") == [(1, None), (2, "not_member"), (3, None)]
    assert rows(res.tables["conversation"], "conversation_id", "workspace_id") == [(1, 1), (2, None), (3, 1)]


def test_update_users_fields(seed):
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, user_id long, field long, value string",
               [(1, T0, 1, 1, "3"), (2, T0, 1, 1, "7"), (3, T0, 2, 3, "eva@example.com"), (4, T0, 2, 5, "x"),
                (5, T0, 2, 2, " "), (6, T0, 2, 4, "French"), (7, T0 + dt.timedelta(minutes=1), 2, 4, "Dutch")])
    res = J.update_users(seed, req)
    assert rows(res.decisions, "req_id", "reason") == [(1, None), (2, "no_tier"), (3, "duplicate_email"),
                                                        (4, "invalid_field"), (5, "null"), (6, None), (7, None)]
    assert rows(res.tables["llm_user"], "user_id", "tier_id", "language") == [
        (1, 3, "English"), (2, 2, "Dutch"), (3, 3, "German")]


def test_cascade_delete_user(seed):
    import datetime as _dt
    req = _req(seed.spark, "req_id long, req_ts timestamp_ntz, user_id long, confirm string",
               [(1, _dt.datetime(2024, 8, 1), 3, "YES")])
    # free user 3 of the unpaid invoice and the ticket first
    t = _with(seed.spark, invoice=[SEED_ROWS["invoice"][0]], support_ticket=[SEED_ROWS["support_ticket"][0]])
    res = J.delete_users(t, req)
    assert rows(res.decisions, "status") == [("accepted",)]
    new = res.tables
    assert rows(new["llm_user"], "user_id") == [(1,), (2,)]
    assert new["workspace"].count() == 0 and new["workspace_member"].count() == 0
    assert new["persona"].count() == 0 and new["workspace_prompt_template"].count() == 0
    assert rows(new["conversation"], "conversation_id", "workspace_id", "persona_id") == [(2, None, None), (3, None, None)]
    assert rows(new["message"], "message_id") == [(3,), (4,), (5,), (6,)]
    assert rows(new["message_feedback"], "feedback_id") == [(2,)]
    assert new["message_bookmark"].count() == 0  # bookmark was on message 2 of conversation 1
    assert rows(new["prompt_template"], "template_id") == [(2,)]


def test_rate_limit_with_one_hot_user_day(spark):
    """One user-day holds a third of all requests (and many share a timestamp): the range-partitioned rank must
    equal the plain per-group window, and the limiter must accept exactly `limit` USER messages that day."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    tiers = [(1, "Free", D(0), 40, "N"), (2, "Plus", D(20), 7, "Y"), (3, "Enterprise", D(100), 99999, "Y")]
    users = [(u, 1 if u % 2 else 2, f"u{u}", f"u{u}@x", ts("2024-01-01"), "en") for u in range(1, 31)]
    convs = [(c, (c % 30) + 1, None, None, f"c{c}", ts("2024-01-01"), "ACTIVE", None, None) for c in range(1, 61)]
    t = _with(spark, tier=tiers, llm_user=users, conversation=convs, message=[], message_feedback=[],
              message_bookmark=[])
    reqs = []
    for i in range(3000):
        if i % 3 == 0:   # hot: user 1 (conversations 30 and 60), one day, timestamps collide in runs of ten
            conv, when = (30 if i % 2 else 60), dt.datetime(2024, 5, 1, 12, 0) + dt.timedelta(seconds=i // 30)
        else:
            conv, when = rnd.randint(1, 60), dt.datetime(2024, 5, rnd.randint(1, 3), rnd.randint(0, 23), rnd.randint(0, 59))
        reqs.append((i, when, conv, 1 if rnd.random() < 0.8 else 2, "m"))
    req = _req(spark, "req_id long, req_ts timestamp_ntz, conversation_id long, role_code long, content string", reqs)
    got = J.admit_messages(t, req).decisions
    # brute force: plain window over (owner, day) on the USER rows
    owner = t.conversation.select("conversation_id", F.col("user_id").alias("owner"))
    lim = t.llm_user.join(t.tier, "tier_id").select(F.col("user_id").alias("owner"), "message_limit")
    b = (req.join(owner, "conversation_id").join(lim, "owner")
         .withColumn("rn", F.row_number().over(Window.partitionBy("owner", F.to_date("req_ts"), "role_code")
                                               .orderBy("req_ts", "req_id")))
         .select("req_id", F.when((F.col("role_code") != 1) | (F.col("rn") <= F.col("message_limit")), "accepted")
                 .otherwise("rejected").alias("status")))
    assert rows(got, "req_id", "status") == rows(b, "req_id", "status")
    hot_day = (got.join(req.select("req_id", "req_ts"), "req_id").join(owner, "conversation_id")
               .where("owner = 1 and sender_role = 'USER' and to_date(req_ts) = date'2024-05-01'"))
    assert hot_day.count() > 700  # ~80 % of the 1,000 hot requests are USER messages
    assert hot_day.where("status = 'accepted'").count() == 40  # user 1 is on the Free tier: limit 40


def test_key_audits_find_planted_violations(spark):
    from convops.plans import audits as A
    inv = SEED_ROWS["invoice"] + [
        (1, 2, 2, ts("2024-03-01"), D(25), "Paid"),       # same invoice id, different amount: PK + FD violation
        (2, 3, 3, ts("2024-04-01"), D(100), "Unpaid"),    # exact copy of invoice 2: PK violation only
    ]
    users = SEED_ROWS["llm_user"] + [(4, 1, "Mallory", "carol@example.com", ts("2024-05-01"), "English")]
    t = _with(spark, invoice=inv, llm_user=users)
    got = rows(A.audit_all(t).where("rule in ('primary_key', 'unique_key', 'fd')"), "rule", "table", "key", "detail")
    assert got == sorted([
        ("primary_key", "invoice", "1", "duplicate x2"),
        ("primary_key", "invoice", "2", "duplicate x2"),
        ("fd", "invoice", "1", "invoice_id -> user_id,tier_id,invoice_date,amount,payment_status"),
        ("unique_key", "llm_user", "carol@example.com", "email duplicate x2"),
        ("fd", "llm_user", "carol@example.com", "email -> user_id,tier_id,name,creation_date,language"),
    ], key=repr)
    assert rows(A.audit_fds(t), "table", "key") == [("invoice", "1"), ("llm_user", "carol@example.com")]


def test_optional_id_that_is_not_a_number_is_none(spark):
    from pyspark.sql import functions as F

    from convops import functions as cf
    df = spark.createDataFrame([(" 12 ",), ("x",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(cf.opt_long(F.col("v"))).collect()] == [12, None, None, None]


def test_messages_without_text_are_refused_after_the_limit_and_use_none_of_it(spark):
    tiers = [(1, "Free", D(0), 2, "N")] + SEED_ROWS["tier"][1:]
    t = _with(spark, tier=tiers)
    day = dt.datetime(2024, 7, 25, 15, 0)
    texts = [" a ", "  ", None, "b", "", "c"]
    req = _req(spark, "req_id long, req_ts timestamp_ntz, conversation_id long, role_code long, content string",
               [(i, day + dt.timedelta(minutes=i), 2, 1, x) for i, x in enumerate(texts)] + [(9, day, 2, 2, " ")])
    res = J.admit_messages(t, req)
    assert rows(res.decisions, "req_id", "reason") == [(0, None), (1, "null"), (2, "null"), (3, None), (4, "rate_limit"),
                                                       (5, "rate_limit"), (9, "null")]
    new = res.tables["message"].where("message_id > 6")
    assert [r[0] for r in rows(new, "content")] == ["a", "b"]


def test_optional_ids_that_are_not_numbers_mean_none(spark, seed):
    req = _req(spark, "req_id long, req_ts timestamp_ntz, user_id long, title string, persona_id string, workspace_id string",
               [(1, T0, 3, "  Talk ", " 1 ", "none"), (2, T0, 3, "x", "", None), (3, T0, 3, "t" * 301, "1", "1")])
    res = J.start_conversations(seed, req)
    assert rows(res.decisions, "req_id", "reason", "persona_id", "workspace_id") == [
        (1, None, 1, None), (2, None, None, None), (3, "too_long", None, None)]
    assert ("Talk",) in rows(res.tables["conversation"], "title")


def test_stored_values_are_trimmed_and_overlong_ones_refused(spark, seed):
    req = _req(spark, "req_id long, req_ts timestamp_ntz, owner_id long, name string, visibility_code long",
               [(1, T0, 3, "  my ws ", 1), (2, T0, 3, "w" * 151, 1), (3, T0, 3, "w" * 150, 1)])
    res = J.create_workspaces(seed, req)
    assert rows(res.decisions, "req_id", "reason") == [(1, None), (2, "too_long"), (3, None)]
    assert ("my ws",) in rows(res.tables["workspace"], "name")


def test_an_email_freed_earlier_in_the_batch_can_be_taken(spark, seed):
    req = _req(spark, "req_id long, req_ts timestamp_ntz, user_id long, field long, value string",
               [(1, T0, 1, 3, "free@example.com"), (2, T0, 2, 3, " carol@example.com "), (3, T0, 1, 3, "carol@example.com"),
                (4, T0, 3, 3, "dave@example.com"), (5, T0, 3, 3, "free@example.com")])
    res = J.update_users(seed, req)
    assert rows(res.decisions, "req_id", "reason") == [(1, None), (2, None), (3, "duplicate_email"), (4, None),
                                                       (5, "duplicate_email")]
    assert rows(res.tables["llm_user"], "user_id", "email") == [
        (1, "free@example.com"), (2, "carol@example.com"), (3, "dave@example.com")]


def test_every_tier_is_listed_with_or_without_customers(spark):
    from convops.sources.binding import bind
    from tests.conftest import SF001
    assert R.list_tiers(bind(spark, SF001)).count() == spark.read.parquet(f"{SF001}/region.parquet").count()
