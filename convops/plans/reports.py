"""Reports (the reference's SELECTs), one function per inventory key.

Per-id parameters of the reference are optional filters here: by default a report is computed for **all** ids in
one job, and the id is part of the output. Filters sit directly on the scanned columns so Catalyst pushes them to
the parquet reader; wide tables are projected to the columns a report uses before any join.

Join strategy: left to the planner — statistics-based broadcast below ``autoBroadcastJoinThreshold``, sort-merge
above it, re-planned by AQE from actual shuffle sizes. Fact-to-fact joins are preceded by pre-aggregation (feedback
counts per conversation, AI-message counts per conversation) so the shuffle carries one row per key, not per fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convops import functions as cf
from convops.operators.lookups import flag_exists
from convops.sources.binding import Tables
from convops.sources.schemas import OPEN_TICKET_STATUSES


def _eq(df: DataFrame, col: str, value) -> DataFrame:
    return df if value is None else df.where(F.col(col) == F.lit(value))


# --- Q1 -------------------------------------------------------------------------------------------------------
def bookmarks(t: Tables, user_id: int | None = None) -> DataFrame:
    """Bookmarked messages: conversation title, first 60 characters, bookmark minute; newest first."""
    mb = _eq(t.message_bookmark, "user_id", user_id)
    m = t.message.select("message_id", "conversation_id", "content")
    c = t.conversation.select("conversation_id", "title")
    return (mb.join(m, "message_id").join(c, "conversation_id")
              .select("user_id", "message_id", F.col("title").alias("conversation"),
                      cf.preview(F.col("content"), 60).alias("message_preview"),
                      cf.minute_text(F.col("bookmarked_time")).alias("bookmarked"), "bookmarked_time")
              .orderBy(F.col("bookmarked_time").desc(), "user_id", "message_id")
              .drop("bookmarked_time"))


# --- Q2 -------------------------------------------------------------------------------------------------------
def _unpaid_per_user(t: Tables) -> DataFrame:
    return (t.invoice.where(F.col("payment_status") == "Unpaid")
              .groupBy("user_id").agg(F.sum("amount").alias("owed"), F.count(F.lit(1)).alias("n_unpaid")))


def _conversations_per_user(t: Tables) -> DataFrame:
    return (t.conversation.groupBy("user_id")
              .agg(F.max("start_time").alias("last_conversation"), F.count(F.lit(1)).alias("n_conv")))


def unpaid_invoices(t: Tables) -> DataFrame:
    """Users with at least one Unpaid invoice, total owed (each invoice once), latest conversation; largest first.

    Invoices and conversations are aggregated separately per user (partial aggregation on both), then joined
    one-row-per-user — no invoice x conversation fan-out.
    """
    u = t.llm_user.select("user_id", "email")
    out = (u.join(_unpaid_per_user(t), "user_id").join(_conversations_per_user(t), "user_id", "left")
             .select("user_id", "email", F.col("owed").cast("double").alias("total_owed"), "last_conversation"))
    return out.orderBy(F.col("total_owed").desc(), "user_id")


def unpaid_invoices_as_written(t: Tables) -> DataFrame:
    """The reference's literal SQL: invoices joined to conversations before summing, so each Unpaid invoice counts
    once per conversation of its user (once if there is none).

    Computed without emitting invoice x conversation pairs: sum per user x max(conversation count, 1) is the same
    number.
    """
    u = t.llm_user.select("user_id", "email")
    conv = _conversations_per_user(t)
    out = (u.join(_unpaid_per_user(t), "user_id").join(conv, "user_id", "left")
             .select("user_id", "email",
                     (F.col("owed") * F.greatest(F.coalesce(F.col("n_conv"), F.lit(0)), F.lit(1)))
                     .cast("double").alias("total_owed"),
                     "last_conversation"))
    return out.orderBy(F.col("total_owed").desc(), "user_id")


# --- Q3 -------------------------------------------------------------------------------------------------------
def _ratings_per_conversation(t: Tables) -> DataFrame:
    """Feedback on AI messages, pre-aggregated to one row per conversation: (thumbs up, ratings)."""
    f = t.message_feedback.select("message_id", "feedback_id", "rating")
    m = t.message.where(F.col("sender_role") == "AI").select("message_id", "conversation_id")
    return (f.join(m, "message_id")
              .groupBy("conversation_id")
              .agg(F.sum(F.when(F.col("rating") == "Thumbs Up", 1).otherwise(0)).alias("up"),
                   F.count("feedback_id").alias("rated")))


def persona_helpfulness(t: Tables) -> DataFrame:
    """Thumbs-Up percentage per live persona over feedback on AI messages of conversations using it."""
    c = t.conversation.where(F.col("persona_id").isNotNull()).select("conversation_id", "persona_id")
    per_persona = (_ratings_per_conversation(t).join(c, "conversation_id")
                   .groupBy("persona_id").agg(F.sum("up").alias("up"), F.sum("rated").alias("rated")))
    p = t.persona.select("persona_id", F.col("name").alias("persona"))
    return (per_persona.join(p, "persona_id").where(F.col("rated") > 0)
            .select("persona_id", "persona", cf.pct(F.col("up"), F.col("rated")).alias("thumbs_up_pct"),
                    F.col("rated").cast("long").alias("total_ratings")))


def best_persona(t: Tables) -> DataFrame:
    """The most helpful persona. Ties (arbitrary in the reference) are broken by more ratings, then lower id."""
    return (persona_helpfulness(t)
            .orderBy(F.col("thumbs_up_pct").desc(), F.col("total_ratings").desc(), F.col("persona_id").asc())
            .limit(1))


# --- Q4 -------------------------------------------------------------------------------------------------------
def _ai_counts(t: Tables) -> DataFrame:
    return (t.message.where(F.col("sender_role") == "AI")
              .groupBy("conversation_id").agg(F.count("message_id").alias("ai_message_count")))


def _conversations_with_ai(t: Tables, with_persona: bool, user_id: int | None) -> DataFrame:
    c = _eq(t.conversation, "user_id", user_id)
    c = c.where(F.col("persona_id").isNotNull() if with_persona else F.col("persona_id").isNull())
    c = c.select("conversation_id", "user_id", "title", "start_time", "persona_name_snapshot")
    # inner join: conversations without AI messages vanish, as in the reference
    return (c.join(_ai_counts(t), "conversation_id")
              .select("user_id", "conversation_id", "title", "start_time", "persona_name_snapshot",
                      "ai_message_count")
              .orderBy(F.col("start_time").desc(), "conversation_id"))


def persona_conversations(t: Tables, user_id: int | None = None) -> DataFrame:
    """Conversations started with a (still existing) persona: snapshot name, start, number of AI messages."""
    return _conversations_with_ai(t, True, user_id)


def nonpersona_conversations(t: Tables, user_id: int | None = None) -> DataFrame:
    """The parallel list without a persona, for adoption comparison."""
    return _conversations_with_ai(t, False, user_id).drop("persona_name_snapshot")


# --- Q5 -------------------------------------------------------------------------------------------------------
def top_personas_by_tier(t: Tables, tier_name: str | None = None, k: int = 3) -> DataFrame:
    """Per tier: the top-k personas by Thumbs-Up % among that tier's users (then more distinct users, lower id).

    The per-tier top-k is ``row_number() <= k`` over a window partitioned by tier; Spark plans that filter as a
    WindowGroupLimit, which keeps only k rows per tier in each task *before* the shuffle, so a tier holding most
    personas never lands whole in one task.
    """
    tier = _eq(t.tier, "tier_name", tier_name).select("tier_id", "tier_name")
    users = t.llm_user.select("user_id", "tier_id").join(tier, "tier_id")
    conv = t.conversation.where(F.col("persona_id").isNotNull()).select("conversation_id", "user_id", "persona_id")
    by_user = (_ratings_per_conversation(t).join(conv, "conversation_id").groupBy("user_id", "persona_id")
               .agg(F.sum("up").alias("up"), F.sum("rated").alias("rated")))
    rated = (by_user.join(users, "user_id").groupBy("tier_name", "persona_id")
             .agg(F.count(F.lit(1)).alias("tier_user_count"), F.sum("up").alias("up"),
                  F.sum("rated").alias("rated"))
             .where(F.col("rated") > 0))
    owners = (t.persona.select("persona_id", F.col("name").alias("persona_name"), "owner_user_id")
              .join(t.llm_user.select(F.col("user_id").alias("owner_user_id"), F.col("email").alias("owner_email")),
                    "owner_user_id"))
    scored = (rated.join(owners, "persona_id")
              .select("tier_name", "persona_id", "persona_name", "owner_email",
                      F.col("tier_user_count").cast("long").alias("tier_user_count"),
                      cf.pct(F.col("up"), F.col("rated")).alias("thumbs_up_pct")))
    w = Window.partitionBy("tier_name").orderBy(F.col("thumbs_up_pct").desc(), F.col("tier_user_count").desc(),
                                                F.col("persona_id").asc())
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long")).orderBy("tier_name", "rank")


# --- lists ------------------------------------------------------------------------------------------------------
def list_users(t: Tables) -> DataFrame:
    tier = t.tier.select("tier_id", "tier_name")
    return (t.llm_user.join(tier, "tier_id")
            .select("user_id", "name", "email", "tier_name", "language").orderBy("user_id"))


def user_invoices(t: Tables, user_id: int | None = None) -> DataFrame:
    """Invoices with the tier *as billed* (the invoice's own tier_id), day only; newest first."""
    tier = t.tier.select("tier_id", "tier_name")
    inv = _eq(t.invoice, "user_id", user_id)
    return (inv.join(tier, "tier_id")
            .select("user_id", "invoice_id", "tier_name", cf.day_text(F.col("invoice_date")).alias("invoice_day"),
                    F.col("amount").cast("double").alias("amount"), "payment_status", "invoice_date")
            .orderBy(F.col("invoice_date").desc(), "invoice_id").drop("invoice_date"))


def conversation_messages(t: Tables, conversation_id: int | None = None) -> DataFrame:
    m = _eq(t.message, "conversation_id", conversation_id)
    return (m.select("conversation_id", "message_id", "sender_role", cf.second_text(F.col("time_sent")).alias("sent"),
                     cf.preview(F.col("content"), 80).alias("content_preview"), "time_sent")
            .orderBy("conversation_id", "time_sent", "message_id").drop("time_sent"))


def user_personas(t: Tables, user_id: int | None = None) -> DataFrame:
    p = _eq(t.persona, "owner_user_id", user_id)
    return (p.select("owner_user_id", "persona_id", "name", cf.day_text(F.col("created_at")).alias("created"),
                     cf.preview(F.col("instructions"), 60).alias("instructions_preview"))
            .orderBy("persona_id"))


def user_templates(t: Tables, user_id: int | None = None) -> DataFrame:
    p = _eq(t.prompt_template, "owner_user_id", user_id)
    return (p.select("owner_user_id", "template_id", "name", "category", "visibility",
                     cf.day_text(F.col("created_at")).alias("created"))
            .orderBy("template_id"))


def workspace_members(t: Tables, workspace_id: int | None = None) -> DataFrame:
    wm = _eq(t.workspace_member, "workspace_id", workspace_id)
    u = t.llm_user.select("user_id", "name", "email")
    return (wm.join(u, "user_id")
            .select("workspace_id", "user_id", "name", "email", "role", cf.day_text(F.col("joined_at")).alias("joined"))
            .orderBy("workspace_id", "role", "name", "user_id"))


def open_tickets(t: Tables) -> DataFrame:
    """Open / In Progress tickets with the user's email and the agent's name (NULL if unassigned); oldest first."""
    st = t.support_ticket.where(F.col("status").isin(*OPEN_TICKET_STATUSES))
    u = t.llm_user.select("user_id", F.col("email").alias("user_email"))
    a = t.support_agent.select("agent_id", F.col("name").alias("agent"))
    return (st.join(u, "user_id").join(a, "agent_id", "left")
            .select("ticket_id", "user_email", "agent", "topic_name",
                    cf.minute_text(F.col("opened_time")).alias("opened"), "status", "opened_time")
            .orderBy("opened_time", "ticket_id").drop("opened_time"))


def list_tiers(t: Tables, with_cost: bool = True) -> DataFrame:
    cols = ["tier_id", "tier_name"] + ([F.col("cost").cast("double").alias("cost")] if with_cost else [])
    return t.tier.select(*cols).orderBy("tier_id")


def list_agents(t: Tables) -> DataFrame:
    return t.support_agent.select("agent_id", "name", "specialty").orderBy("agent_id")


def ticket_resolution(t: Tables) -> DataFrame:
    """Hours from opening to closing, computed at query time; NULL while the ticket is open."""
    st = t.support_ticket
    return (st.select("ticket_id", "status", cf.hours_between(F.col("opened_time"), F.col("closed_time"))
                      .alias("resolution_hours"))
            .orderBy("ticket_id"))


def id_exists(t: Tables, ids: DataFrame, table: str, key: str) -> DataFrame:
    """For a set of ids (column ``id``), which exist in ``table.key`` — one probe join for the whole set."""
    return flag_exists(ids.select("id").distinct(), t[table], {"id": key}, "exists", unique=True)


def missing_bookmarked_messages(t: Tables) -> DataFrame:
    """``id_exists`` over every message id that some bookmark references, against the message table."""
    ids = t.message_bookmark.select(F.col("message_id").alias("id"))
    return id_exists(t, ids, "message", "message_id").orderBy("id")
