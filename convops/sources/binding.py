"""Platform tables as typed DataFrames.

Two ways to get them:

* ``bind(spark, sf_dir)`` derives the fifteen platform tables from the driver's raw tables (customer, orders, events,
  conversations, labels, ...). Every table is a lazy DataFrame over the raw parquet, so Catalyst prunes the columns
  and pushes the filters of whatever query uses it down to the raw scans.
* ``load(spark, platform_dir)`` reads platform tables that were materialised as parquet (``store.write_tables``),
  with the explicit schemas from ``schemas.SCHEMAS`` — never inferred.

Both return a ``Tables`` object: attribute access per table, each built once per object.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.sources.schemas import SCHEMAS, TABLES
from convops.sources.store import read_table

EPOCH = "2024-01-01 00:00:00"


def epoch() -> Column:
    return F.to_timestamp_ntz(F.lit(EPOCH))


def minutes_after(base: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), base)


def _typed(df: DataFrame, table: str) -> DataFrame:
    """Project to the declared column order and types of ``table``."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


class Tables:
    """Lazily built platform tables; ``t.message`` etc. Extra raw helpers live alongside (``message_raw``)."""

    def __init__(self, spark: SparkSession, builders: dict[str, Callable[["Tables"], DataFrame]]):
        self.spark = spark
        self._builders = builders
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._builders[name](self)
        return self._cache[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def replace(self, **new_versions: DataFrame) -> "Tables":
        """A new Tables object where the given tables are swapped for new versions (e.g. a rule job's output); the
        others stay as they are, also those that are derived from a swapped one."""
        for name in TABLES:
            if name in self._builders:
                self[name]
        builders = dict(self._builders)
        cache = dict(self._cache)
        for name, df in new_versions.items():
            builders[name] = (lambda d: (lambda _t: d))(df)
            cache[name] = df
        out = Tables(self.spark, builders)
        out._cache = cache
        out._sf_dir = getattr(self, "_sf_dir", None)
        return out

    def names(self) -> list[str]:
        return list(self._builders)


# --------------------------------------------------------------------------------------------------------------
# Binding of the driver's tables (see FIXTURES.md §3). Deliberate shape: tier limits of 3 and 6 so the rate limit
# fires, users without a billing record, SYSTEM roles kept in message_raw, drifting snapshots, orphan bookmarks,
# shared PRIVATE templates and conversations in workspaces their owner does not belong to.
# --------------------------------------------------------------------------------------------------------------

def _raw(t: Tables, name: str) -> DataFrame:
    return t.spark.read.parquet(os.path.join(t._sf_dir, f"{name}.parquet"))  # type: ignore[attr-defined]


def scalar(t: Tables, raw: str, value: Column) -> Column:
    """An aggregate over a raw table as a one-row subquery, usable as a column."""
    return _raw(t, raw).agg(value.alias("v")).scalar()


def users_span(t: Tables) -> Column:
    return scalar(t, "customer", F.max("c_custkey") + 1)


def regions_span(t: Tables) -> Column:
    return scalar(t, "region", F.max("r_regionkey").cast("long") + 1)


def nations_span(t: Tables) -> Column:
    return scalar(t, "nation", F.max("n_nationkey").cast("long") + 1)


def agents_span(t: Tables) -> Column:
    return scalar(t, "supplier", F.max("s_suppkey") + 1)


def turns_span(t: Tables) -> Column:
    return scalar(t, "conversations", F.max("turn").cast("long") + 1)


def messages_span(t: Tables) -> Column:
    """One more than the largest message id: conversations times turns."""
    return scalar(t, "conversations", (F.max("conv_id") + 1) * (F.max("turn").cast("long") + 1))


def talkers_span(t: Tables) -> Column:
    """About a quarter of the conversations: so many users have some."""
    return scalar(t, "conversations", F.greatest(F.lit(1).cast("long"), F.floor((F.max("conv_id") + 1) / 4)))


def _segment_tier() -> Column:
    """Tier of a customer by market segment (FIXTURES.md §3)."""
    return (F.when(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"), 1)
            .when(F.col("c_mktsegment") == "AUTOMOBILE", 3).otherwise(2))


def _tier(t: Tables) -> DataFrame:
    """One tier per region, used by customers or not. Limits are low, so that the rate limit fires on the test data."""
    k = F.col("r_regionkey")
    df = _raw(t, "region").select(
        (k + 1).alias("tier_id"),
        F.when(k == 0, "Free").when(k == 1, "Plus").when(k == 2, "Enterprise")
         .otherwise(F.concat(F.lit("Regional "), F.col("r_name"))).alias("tier_name"),
        F.when(k == 0, 0).when(k == 1, 20).when(k == 2, 100).otherwise(k * 50).alias("cost"),
        F.when(k == 0, 3).when(k == 1, 6).when(k == 2, 99999).otherwise(k * 10).alias("message_limit"),
        F.when(k == 0, "N").otherwise("Y").alias("pro_access"))
    return _typed(df, "tier")


def _customer_nation(t: Tables) -> DataFrame:
    c = _raw(t, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = _raw(t, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return c.join(n, "c_nationkey")  # nation: 25 rows, planner broadcasts it


def _llm_user(t: Tables) -> DataFrame:
    cn = _customer_nation(t)
    df = cn.select(
        F.col("c_custkey").alias("user_id"), _segment_tier().alias("tier_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        minutes_after(epoch(), F.col("c_custkey") % 40000).alias("creation_date"),
        F.col("n_name").alias("language"))
    return _typed(df, "llm_user")


def _billing_record(t: Tables) -> DataFrame:
    c = _raw(t, "customer").select("c_custkey")
    method = (F.when(F.col("c_custkey") % 3 == 0, "Credit Card")
              .when(F.col("c_custkey") % 3 == 1, "PayPal").otherwise("Invoice"))
    df = c.where(F.col("c_custkey") % 50 != 49).select(
        F.col("c_custkey").alias("user_id"), method.alias("payment_method"),
        F.concat(F.lit("Address "), F.col("c_custkey").cast("string")).alias("billing_address"))
    return _typed(df, "billing_record")


def _invoice(t: Tables) -> DataFrame:
    o = _raw(t, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "Paid")
              .when(F.col("o_orderstatus") == "O", "Unpaid").otherwise("Overdue"))
    df = o.select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 3 + 1).alias("tier_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("amount"), status.alias("payment_status"))
    return _typed(df, "invoice")


def _persona(t: Tables) -> DataFrame:
    n = _raw(t, "nation")
    df = n.select(
        F.col("n_nationkey").alias("persona_id"), F.col("n_regionkey").alias("owner_user_id"),
        F.col("n_name").alias("name"), F.concat(F.lit("you are "), F.lower("n_name")).alias("instructions"),
        minutes_after(epoch(), F.col("n_nationkey")).alias("created_at"))
    return _typed(df, "persona")


def _conversation(t: Tables) -> DataFrame:
    ids = _raw(t, "conversations").select("conv_id").distinct()
    cid = F.col("conv_id")
    talkers, regions, nations = talkers_span(t), regions_span(t), nations_span(t)
    day = F.floor((cid % talkers) / 10) + F.floor(F.floor(cid / talkers) / 2)
    base = ids.select(
        cid.alias("conversation_id"), (cid % talkers).alias("user_id"),
        F.when(cid % (regions + 1) != regions, cid % (regions + 1)).alias("workspace_id"),
        # squares: some personas have many conversations, some none
        F.when(cid % 4 != 3, (cid % nations) * (cid % nations) % nations).alias("persona_id"),
        F.concat(F.lit("conversation "), cid.cast("string")).alias("title"),
        minutes_after(epoch(), day * 1440 + cid % 600).alias("start_time"),
        F.when(cid % 3 == 0, "ARCHIVED").otherwise("ACTIVE").alias("status"))
    p = t.persona.select("persona_id", F.col("name").alias("p_name"), F.col("instructions").alias("p_instr"))
    # persona is a dimension of bounded size (one row per nation here); the planner broadcasts it by its stats
    df = base.join(p, "persona_id", "left").select(
        "conversation_id", "user_id", "workspace_id", "persona_id", "title", "start_time", "status",
        F.when(F.col("p_name").isNull(), F.lit(None))
         .when(F.col("conversation_id") % 7 == 0, F.concat(F.col("p_name"), F.lit(" v0")))
         .otherwise(F.col("p_name")).alias("persona_name_snapshot"),
        F.col("p_instr").alias("persona_instr_snapshot"))
    return _typed(df, "conversation")


def _message_raw(t: Tables) -> DataFrame:
    m = _raw(t, "conversations")
    c = t.conversation.select(F.col("conversation_id").alias("conv_id"), "start_time")
    role = (F.when(F.col("role") == "user", "USER").when(F.col("role") == "assistant", "AI")
            .otherwise(F.upper("role")))
    return m.join(c, "conv_id").select(
        (F.col("conv_id") * turns_span(t) + F.col("turn")).alias("message_id"), F.col("conv_id").alias("conversation_id"),
        role.alias("sender_role"), minutes_after(F.col("start_time"), F.col("turn")).alias("time_sent"),
        F.col("text").alias("content"))


def _message(t: Tables) -> DataFrame:
    return _typed(t.message_raw.where(F.col("sender_role").isin("USER", "AI")), "message")


def _message_feedback(t: Tables) -> DataFrame:
    lab = _raw(t, "labels")
    m = t.message.where(F.col("sender_role") == "AI").select("message_id", "time_sent")
    df = lab.join(m, lab.doc_id == m.message_id).select(
        F.col("doc_id").alias("feedback_id"), "message_id",
        F.when(F.col("quality") == 1, "Thumbs Up").otherwise("Thumbs Down").alias("rating"),
        F.when(F.col("toxic") == 1, "flagged").alias("comment_text"),
        minutes_after(F.col("time_sent"), F.lit(5)).alias("submitted_at"))
    return _typed(df, "message_feedback")


def _message_bookmark(t: Tables) -> DataFrame:
    e = _raw(t, "events").where(F.col("event_type") == "click")
    df = (e.groupBy("user_id", (F.col("event_id") % messages_span(t)).alias("message_id"))
          .agg(F.min(F.col("ts").cast("timestamp_ntz")).alias("bookmarked_time")))
    return _typed(df, "message_bookmark")


def _workspace(t: Tables) -> DataFrame:
    r = _raw(t, "region")
    df = r.select(
        F.col("r_regionkey").alias("workspace_id"), F.col("r_regionkey").alias("owner_id"), F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") % 2 == 0, "SHARED").otherwise("PRIVATE").alias("visibility"),
        epoch().alias("created_at"))
    return _typed(df, "workspace")


def _workspace_member(t: Tables) -> DataFrame:
    members = _customer_nation(t).select(
        F.col("n_regionkey").cast("long").alias("workspace_id"), F.col("c_custkey").alias("user_id"),
        F.lit("MEMBER").alias("role"))
    owners = t.workspace.select("workspace_id", F.col("owner_id").alias("user_id"), F.lit("OWNER").alias("role"))
    df = (members.unionByName(owners).groupBy("workspace_id", "user_id").agg(F.max("role").alias("role"))
          .withColumn("joined_at", minutes_after(epoch(), F.col("user_id") % 1000)))
    return _typed(df, "workspace_member")


def _prompt_template(t: Tables) -> DataFrame:
    p = _raw(t, "part")
    df = p.select(
        F.col("p_partkey").alias("template_id"), (F.col("p_partkey") % users_span(t)).alias("owner_user_id"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("text"), F.col("p_type").alias("category"),
        F.when(F.col("p_size") % 2 == 0, "SHARED").otherwise("PRIVATE").alias("visibility"),
        minutes_after(epoch(), F.col("p_partkey") % 40000).alias("created_at"))
    return _typed(df, "prompt_template")


def _workspace_prompt_template(t: Tables) -> DataFrame:
    p = _raw(t, "part").where(F.col("p_partkey") % 3 == 0)
    df = p.select(
        (F.col("p_partkey") % regions_span(t)).alias("workspace_id"), F.col("p_partkey").alias("template_id"),
        minutes_after(epoch(), F.col("p_partkey") % 40000).alias("shared_at"))
    return _typed(df, "workspace_prompt_template")


def _support_agent(t: Tables) -> DataFrame:
    s = _raw(t, "supplier")
    k = F.col("s_suppkey") % 5
    specialty = (F.when(k == 0, "Billing").when(k == 1, "Model Error").when(k == 2, "Account")
                 .when(k == 3, "Feature Request").otherwise("Other"))
    df = s.select(
        F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("agent"), F.col("s_suppkey").cast("string"), F.lit("@support.example")).alias("email"),
        specialty.alias("specialty"), minutes_after(epoch(), F.col("s_suppkey")).alias("hired_date"))
    return _typed(df, "support_agent")


def _support_ticket(t: Tables) -> DataFrame:
    e = _raw(t, "events").where(F.col("event_type") == "error")
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp_ntz")
    topic = (F.when(eid % 5 == 0, "Billing").when(eid % 5 == 1, "Model Error").when(eid % 5 == 2, "Account")
             .when(eid % 5 == 3, "Feature Request").otherwise("Other"))
    status = (F.when(eid % 4 == 0, "Open").when(eid % 4 == 1, "In Progress").when(eid % 4 == 2, "Resolved")
              .otherwise("Escalated"))
    df = e.select(
        eid.alias("ticket_id"), (F.col("user_id") * 10 + eid % 10).alias("user_id"),
        F.when(eid % 4 != 0, eid % agents_span(t)).alias("agent_id"), topic.alias("topic_name"),
        ts.alias("opened_time"),
        F.when(eid % 4 >= 2, minutes_after(ts, F.floor(F.col("value") * 10))).alias("closed_time"),
        status.alias("status"))
    return _typed(df, "support_ticket")


_BINDERS: dict[str, Callable[[Tables], DataFrame]] = {
    "tier": _tier, "support_agent": _support_agent, "llm_user": _llm_user, "billing_record": _billing_record,
    "invoice": _invoice, "workspace": _workspace, "workspace_member": _workspace_member, "persona": _persona,
    "conversation": _conversation, "message_raw": _message_raw, "message": _message,
    "message_feedback": _message_feedback, "message_bookmark": _message_bookmark,
    "prompt_template": _prompt_template, "workspace_prompt_template": _workspace_prompt_template,
    "support_ticket": _support_ticket,
}


# sf_dir -> folder holding a stored copy of the platform tables (see ``store.materialize``)
_MATERIALIZED: dict[str, str] = {}


def register_materialized(sf_dir: str, platform_dir: str) -> None:
    """From now on ``bind(spark, sf_dir)`` reads the stored copy in ``platform_dir`` instead of re-deriving."""
    _MATERIALIZED[os.path.normpath(sf_dir)] = platform_dir


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """Platform tables derived from the driver's raw tables under ``sf_dir`` (or their stored copy, if one was
    registered with ``register_materialized``)."""
    stored = _MATERIALIZED.get(os.path.normpath(sf_dir))
    if stored:
        return load(spark, stored, raw_dir=sf_dir)
    t = Tables(spark, _BINDERS)
    t._sf_dir = sf_dir  # type: ignore[attr-defined]
    # raw tables are also reachable for request derivation
    for name in RAW_TABLES:
        t._builders[f"raw_{name}"] = (lambda n: (lambda tt: _raw(tt, n)))(name)
    return t


RAW_TABLES = ("customer", "nation", "region", "supplier", "part", "orders", "events", "labels", "conversations")


def load(spark: SparkSession, platform_dir: str, raw_dir: str | None = None) -> Tables:
    """Platform tables materialised as parquet under ``platform_dir/<table>`` (explicit schemas, checked against the
    files when a table is first used). ``raw_dir``
    additionally exposes the raw tables (``raw_<name>``) from which request tables are derived."""
    builders = {name: (lambda n: (lambda tt: read_table(spark, os.path.join(platform_dir, n), n)))(name)
                for name in TABLES}
    builders["message_raw"] = lambda tt: spark.read.parquet(os.path.join(platform_dir, "message_raw"))
    t = Tables(spark, builders)
    if raw_dir:
        t._sf_dir = raw_dir  # type: ignore[attr-defined]
        for name in RAW_TABLES:
            t._builders[f"raw_{name}"] = (lambda n: (lambda tt: _raw(tt, n)))(name)
    return t
