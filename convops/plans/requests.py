"""Request tables for the rule jobs, derived from the driver's tables (whole tables, no sampling).

Every request table has ``req_id`` (unique within the table) and ``req_ts`` (the request's own "now"; the
reference's SYSDATE / SYSTIMESTAMP). Requests are ordered by (req_ts, req_id), a total order. Ids that can never
exist (negative ids) stand for requests against missing rows; they are derived from the data too, so every request
table grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convops.sources.binding import (Tables, agents_span, messages_span, minutes_after, nations_span, regions_span,
                                     turns_span, users_span)

BATCH_TS = "2024-06-01 00:00:00"


def batch_ts() -> Column:
    return F.to_timestamp_ntz(F.lit(BATCH_TS))


def _events(t: Tables, kind: str) -> DataFrame:
    return t.raw_events.where(F.col("event_type") == kind).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _every(key: Column, n: int) -> Column:
    """True for one request in ``n``: such requests ask for something that must be refused."""
    return key % n == 0


def _padded(text: Column) -> Column:
    return F.concat(F.lit("  "), text, F.lit(" "))


def generate_invoices(t: Tables) -> DataFrame:
    """One invoice request per customer (all are users); one in 41 for a user who doesn't exist."""
    k = F.col("c_custkey")
    return t.raw_customer.select(k.alias("req_id"), batch_ts().alias("req_ts"),
                                 F.when(_every(k, 41), -k - 1).otherwise(k).alias("user_id"))


def mark_paid(t: Tables) -> DataFrame:
    """Every order asks to pay its invoice; high-priority orders ask for an invoice id that does not exist."""
    return t.raw_orders.select(F.col("o_orderkey").alias("req_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("req_ts"),
                               F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderkey"))
                                .otherwise(-F.col("o_orderkey")).alias("invoice_id"))


def start_conversations(t: Tables) -> DataFrame:
    """Signup events, optional ids as typed: unknown and non-numeric personas and workspaces, blank and overlong
    titles, unknown users."""
    e, k = _events(t, "signup"), F.col("event_id")
    persona, ws = k % (nations_span(t) + 5), k % (regions_span(t) + 2)
    return e.select(k.alias("req_id"), F.col("ts").alias("req_ts"),
                    F.when(_every(k, 11), -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"),
                    F.when(_every(k, 13), F.lit("  ")).when(_every(k, 17), F.repeat(F.lit("long "), 61))
                     .otherwise(_padded(F.concat(F.lit("chat "), k.cast("string")))).alias("title"),
                    F.when(_every(k, 19), F.lit("none")).otherwise(persona.cast("string")).alias("persona_id"),
                    F.when(ws <= regions_span(t), _padded(ws.cast("string"))).otherwise(F.lit("-")).alias("workspace_id"))


def admit_messages(t: Tables) -> DataFrame:
    """Replay of four fifths of the message log as requests (code 1 = USER, 2 = AI); some with blank or no content,
    some for a conversation that doesn't exist."""
    m, k = t.message, F.col("message_id")
    return m.where(~_every(k, 5)).select(
        k.alias("req_id"), F.col("time_sent").alias("req_ts"),
        F.when(_every(k, 29), -F.col("conversation_id") - 1).otherwise(F.col("conversation_id")).alias("conversation_id"),
        F.when(F.col("sender_role") == "USER", 1).otherwise(2).alias("role_code"),
        F.when(_every(k, 23), F.lit("   ")).when(~_every(k, 31), _padded(F.col("content"))).alias("content"))


def upsert_feedback(t: Tables) -> DataFrame:
    """Purchase events rate a message of the whole log: code 1 if value > 20; blank comment for one in three."""
    e, k = _events(t, "purchase"), F.col("event_id")
    return e.select(k.alias("req_id"), F.col("ts").alias("req_ts"), (k % messages_span(t)).alias("message_id"),
                    F.when(F.col("value") > 20, 1).otherwise(2).alias("rating_code"),
                    F.when(_every(k, 3), F.lit("  ")).otherwise(_padded(F.concat(F.lit("note "), k.cast("string"))))
                     .alias("comment"))


def add_bookmarks(t: Tables) -> DataFrame:
    """Click events bookmark the message of an earlier bookmark or one of its neighbours; some users are unknown."""
    e, k = _events(t, "click"), F.col("event_id")
    return e.select(k.alias("req_id"), F.col("ts").alias("req_ts"),
                    F.when(_every(k, 11), -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"),
                    ((k + k % 3) % messages_span(t)).alias("message_id"))


def _turns(t: Tables) -> DataFrame:
    return t.raw_conversations.select("conv_id", "turn", "role")


def archive_conversations(t: Tables) -> DataFrame:
    """First turn of every conversation archives it; later turns of one in nine ask for one that does not exist."""
    c = _turns(t).where((F.col("turn") == 0) | _every(F.col("conv_id"), 9))
    rid = F.col("conv_id") * turns_span(t) + F.col("turn")
    return c.select(rid.alias("req_id"), minutes_after(batch_ts(), F.col("turn")).alias("req_ts"),
                    F.when(F.col("turn") == 0, F.col("conv_id")).otherwise(-rid - 1).alias("conversation_id"))


def move_conversations(t: Tables) -> DataFrame:
    """Every conversation asks to move to a workspace, one of which is unknown; some conversations are unknown."""
    k = F.col("conv_id")
    return _turns(t).where(F.col("turn") == 0).select(
        k.alias("req_id"), batch_ts().alias("req_ts"),
        F.when(_every(k, 17), -k - 1).otherwise(k).alias("conversation_id"),
        (k % (regions_span(t) + 1)).alias("workspace_id"))


def add_users(t: Tables) -> DataFrame:
    """Suppliers sign up: some tiers unknown, some emails taken, blank, overlong or asked for twice; fields as typed."""
    k = F.col("s_suppkey")
    email = (F.when(_every(k, 10), F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")))
             .when(_every(k, 11), F.lit(" ")).when(_every(k, 13), F.concat(F.repeat(F.lit("x"), 150), F.lit("@example.com")))
             .otherwise(F.concat(F.lit("new"), F.floor(k / 2).cast("string"), F.lit("@example.com"))))
    return t.raw_supplier.select(
        k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"), (k % 7 + 1).alias("tier_id"),
        _padded(F.col("s_name")).alias("name"), _padded(email).alias("email"), F.lit("English ").alias("language"),
        F.when(k % 3 == 0, " Credit Card").when(k % 3 == 1, "PayPal ").otherwise(" ").alias("payment_method"),
        _padded(F.concat(F.lit("Supplier street "), k.cast("string"))).alias("billing_address"))


def update_users(t: Tables) -> DataFrame:
    """View events: field event_id % 5 + 1 (5 invalid). Email changes go to new addresses, several users wanting the
    same, and to addresses of users who may have moved away before; some values are blank or overlong."""
    e, eid = _events(t, "view"), F.col("event_id")
    users = users_span(t)
    field = eid % 5 + 1
    moved = F.concat(F.lit("moved"), (eid % F.greatest(F.lit(1), F.floor(users / 2))).cast("string"))
    value = (F.when(_every(eid, 37), F.lit(" ")).when(_every(eid, 41), F.repeat(F.lit("y"), 151))
             .when(field == 1, (eid % 7 + 1).cast("string"))
             .when(field == 2, F.concat(F.lit("name "), eid.cast("string")))
             .when(field == 3, F.concat(F.when(_every(eid, 3), moved).otherwise(
                 F.concat(F.lit("user"), (eid % users).cast("string"))), F.lit("@example.com")))
             .when(field == 4, F.concat(F.lit("lang "), (eid % 7).cast("string")))
             .otherwise(F.lit("x")))
    return e.select(eid.alias("req_id"), F.col("ts").alias("req_ts"),
                    F.when(_every(eid, 43), -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"),
                    field.alias("field"), _padded(value).alias("value"))


def delete_users(t: Tables) -> DataFrame:
    """Every user asks to be deleted, one in 53 under an unknown id; confirmation 'YES' unless user_id % 7 = 0."""
    k = F.col("c_custkey")
    return t.raw_customer.select(k.alias("req_id"), batch_ts().alias("req_ts"),
                                 F.when(_every(k, 53), -k - 1).otherwise(k).alias("user_id"),
                                 F.when(k % 7 == 0, "NO").otherwise("YES").alias("confirm"))


def create_workspaces(t: Tables) -> DataFrame:
    """Every customer opens a workspace; SHARED (code 2) when the account balance is positive; some owners are
    unknown, some names blank or overlong."""
    k = F.col("c_custkey")
    return t.raw_customer.select(
        k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"),
        F.when(_every(k, 43), -k - 1).otherwise(k).alias("owner_id"),
        F.when(_every(k, 47), F.lit(" ")).when(_every(k, 59), F.repeat(F.lit("w"), 151))
         .otherwise(_padded(F.concat(F.col("c_name"), F.lit(" space")))).alias("name"),
        F.when(F.col("c_acctbal") > 0, 2).otherwise(1).alias("visibility_code"))


def modify_workspaces(t: Tables) -> DataFrame:
    """Signup events edit a workspace (some unknown): field 1 name if value > 25, else visibility; some names blank."""
    e, eid = _events(t, "signup"), F.col("event_id")
    return e.select(eid.alias("req_id"), F.col("ts").alias("req_ts"), (eid % (regions_span(t) + 2)).alias("workspace_id"),
                    F.when(F.col("value") > 25, 1).otherwise(2).alias("field"),
                    F.when(_every(eid, 13), F.lit("")).when(_every(eid, 17), F.repeat(F.lit("w"), 151))
                     .otherwise(_padded(F.concat(F.lit("ws "), eid.cast("string")))).alias("name"),
                    F.when(eid % 2 == 0, 2).otherwise(1).alias("visibility_code"))


def add_members(t: Tables) -> DataFrame:
    """View events: user_id joins a workspace; one workspace and some users are unknown."""
    e, k = _events(t, "view"), F.col("event_id")
    return e.select(k.alias("req_id"), F.col("ts").alias("req_ts"), (k % (regions_span(t) + 1)).alias("workspace_id"),
                    F.when(_every(k, 19), -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"))


def _parts(t: Tables) -> DataFrame:
    return t.raw_part


def create_personas(t: Tables) -> DataFrame:
    """Parts: a few owners each, so that (owner, name) duplicates occur; some owners unknown, some names blank."""
    k = F.col("p_partkey")
    owners = F.greatest(F.lit(1), F.floor(users_span(t) / 20))
    return _parts(t).select(
        k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"),
        F.when(_every(k, 29), -k - 1).otherwise(k % owners).alias("owner_user_id"),
        F.when(_every(k, 23), F.lit(" ")).when(_every(k, 31), F.repeat(F.lit("p"), 151))
         .otherwise(_padded(F.col("p_name"))).alias("name"),
        F.concat(F.lit("you are "), F.lower("p_type")).alias("instructions"))


def update_personas(t: Tables) -> DataFrame:
    """Parts edit a persona (some unknown): field 1 name if p_size is even — the nation's own name, another's or
    a new one — else instructions; some values blank or overlong."""
    k, nations = F.col("p_partkey"), nations_span(t)
    field = F.when(F.col("p_size") % 2 == 0, 1).otherwise(2)
    name = F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("role "), (k % 4).cast("string")))
    value = (F.when(_every(k, 23), F.lit(" ")).when(_every(k, 31), F.repeat(F.lit("p"), 151))
             .when(field == 1, _padded(name)).otherwise(F.concat(F.lit("you are "), F.col("p_brand"))))
    return _parts(t).select(k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"),
                            (k % (nations + 5)).alias("persona_id"), field.alias("field"), value.alias("value"))


def delete_personas(t: Tables) -> DataFrame:
    """Every persona asks to be deleted, some under an unknown id; confirmation 'YES' unless persona_id % 7 = 0."""
    pid = F.col("n_nationkey").cast("long")
    return t.raw_nation.select(pid.alias("req_id"), batch_ts().alias("req_ts"),
                               F.when(pid % 11 == 5, -pid).otherwise(pid).alias("persona_id"),
                               F.when(pid % 7 == 0, "NO").otherwise("YES").alias("confirm"))


def add_templates(t: Tables) -> DataFrame:
    """Parts: any owner, some unknown; SHARED (code 2) when p_size % 3 = 2; some names blank or overlong."""
    k = F.col("p_partkey")
    return _parts(t).select(
        k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"),
        F.when(_every(k, 29), -k - 1).otherwise(k % users_span(t)).alias("owner_user_id"),
        F.when(_every(k, 23), F.lit(" ")).when(_every(k, 31), F.repeat(F.lit("n"), 151))
         .otherwise(_padded(F.col("p_name"))).alias("name"),
        _padded(F.col("p_brand")).alias("text"), _padded(F.col("p_type")).alias("category"),
        (F.col("p_size") % 3).alias("visibility_code"))


def update_templates(t: Tables) -> DataFrame:
    """Parts edit their own template, some an unknown one: field p_partkey % 5 (0 invalid); some values blank or
    overlong."""
    k = F.col("p_partkey")
    field = k % 5
    value = (F.when(_every(k, 23), F.lit(" ")).when(_every(k, 31), F.repeat(F.lit("n"), 151))
             .when(field == 1, F.concat(F.col("p_name"), F.lit(" v2")))
             .when(field == 2, F.concat(F.lit("text of "), F.col("p_brand")))
             .when(field == 3, F.upper("p_type"))
             .when(field == 4, F.when(F.col("p_size") % 2 == 0, "1").otherwise("2"))
             .otherwise(F.lit("x")))
    return _parts(t).select(k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"),
                            F.when(_every(k, 37), -k - 1).otherwise(k).alias("template_id"), field.alias("field"),
                            _padded(value).alias("value"))


def share_templates(t: Tables) -> DataFrame:
    """Every part shares its template, some an unknown one, with a workspace, one of which is unknown."""
    k = F.col("p_partkey")
    return _parts(t).select(k.alias("req_id"), minutes_after(batch_ts(), k % 1000).alias("req_ts"),
                            F.when(_every(k, 37), -k - 1).otherwise(k).alias("template_id"),
                            (k % (regions_span(t) + 1)).alias("workspace_id"))


def create_tickets(t: Tables) -> DataFrame:
    """Signup events open a ticket with topic code event_id % 7 (0 and 6 fall back to Other); some users unknown."""
    e, k = _events(t, "signup"), F.col("event_id")
    return e.select(k.alias("req_id"), F.col("ts").alias("req_ts"),
                    F.when(_every(k, 11), -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("user_id"),
                    (k % 7).alias("topic_code"))


def assign_tickets(t: Tables) -> DataFrame:
    """Every error event (= every ticket) is assigned an agent, some unknown, an hour after opening; some tickets
    are unknown."""
    e, k = _events(t, "error"), F.col("event_id")
    return e.select(k.alias("req_id"), minutes_after(F.col("ts"), F.lit(60)).alias("req_ts"),
                    F.when(_every(k, 13), -k - 1).otherwise(k).alias("ticket_id"),
                    (k % (agents_span(t) + 2)).alias("agent_id"))


def resolve_tickets(t: Tables) -> DataFrame:
    """Every ticket, and some unknown ones, are closed a day after opening: Resolved (code 1) when value > 25, else
    Escalated."""
    e, k = _events(t, "error"), F.col("event_id")
    return e.select(k.alias("req_id"), minutes_after(F.col("ts"), F.lit(1440)).alias("req_ts"),
                    F.when(_every(k, 13), -k - 1).otherwise(k).alias("ticket_id"),
                    F.when(F.col("value") > 25, 1).otherwise(2).alias("status_code"))
