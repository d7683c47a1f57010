"""Every registered key: the Spark callable (spark, sf_dir) -> DataFrame and, where SQL can express it, the DuckDB
oracle text. ``__spark_entry__`` re-exports these."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.plans import audits as A
from convops.plans import reports as R
from convops.plans import requests as Q
from convops.plans import rules as J
from convops.plans.oracle_rules import rules_sql
from convops.plans.oracle_versions import VERSION_KEYS
from convops.plans.oracle_audits import DAMAGED_AUDITS, audits_sql
from convops.plans.oracle_reports import reports_sql
from convops.sources.binding import bind

Query = Callable[[SparkSession, str], DataFrame]


def _on_bound(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(bind(spark, sf_dir), **kw)
    run.__name__ = fn.__name__
    return run


def report_queries() -> dict[str, Query]:
    return {
        "bookmarks": _on_bound(R.bookmarks),
        "unpaid_invoices": _on_bound(R.unpaid_invoices),
        "unpaid_invoices_as_written": _on_bound(R.unpaid_invoices_as_written),
        "best_persona": _on_bound(R.best_persona),
        "persona_helpfulness": _on_bound(R.persona_helpfulness),
        "persona_conversations": _on_bound(R.persona_conversations),
        "nonpersona_conversations": _on_bound(R.nonpersona_conversations),
        "top_personas_by_tier": _on_bound(R.top_personas_by_tier),
        "list_users": _on_bound(R.list_users),
        "user_invoices": _on_bound(R.user_invoices),
        "conversation_messages": _on_bound(R.conversation_messages),
        "user_personas": _on_bound(R.user_personas),
        "user_templates": _on_bound(R.user_templates),
        "workspace_members": _on_bound(R.workspace_members),
        "open_tickets": _on_bound(R.open_tickets),
        "list_tiers": _on_bound(R.list_tiers),
        "list_agents": _on_bound(R.list_agents),
        "ticket_resolution": _on_bound(R.ticket_resolution),
        "id_exists": _on_bound(R.missing_bookmarked_messages),
    }


def audit_queries() -> dict[str, Query]:
    out = {name: _on_bound(fn) for name, fn in A.AUDITS.items()}
    out["audit_all"] = _on_bound(A.audit_all)
    out |= {f"{name}__damaged": _on_damaged(A.AUDITS[name]) for name in DAMAGED_AUDITS}
    return out


def damaged(t):
    """The bound tables with rows added that break rules which the bound tables keep."""
    def more(table: str, where: str, /, **changes) -> DataFrame:
        rows = t[table].where(where)
        return rows.withColumns({c: e.cast(rows.schema[c].dataType) for c, e in changes.items()})
    c = F.col
    spoken = t.message.where("sender_role = 'USER' AND message_id % 3 = 1").select(
        (-c("message_id") - 1).alias("feedback_id"), "message_id", F.lit("Thumbs Up").alias("rating"),
        F.lit(None).cast("string").alias("comment_text"), c("time_sent").alias("submitted_at"))
    return t.replace(
        llm_user=t.llm_user.unionByName(more("llm_user", "user_id % 50 = 7", name=F.concat(c("name"), F.lit(" II"))))
        .unionByName(more("llm_user", "user_id % 60 = 9", user_id=-c("user_id") - 1, name=F.repeat(F.lit("n"), 101),
                          language=F.lit(" "))),
        workspace=t.workspace.unionByName(more("workspace", "true", workspace_id=-c("workspace_id") - 1,
                                               name=F.repeat(F.lit("w"), 151))),
        persona=t.persona.unionByName(more("persona", "persona_id % 6 = 1", persona_id=c("persona_id") + 1000)),
        support_ticket=t.support_ticket.unionByName(more(
            "support_ticket", "ticket_id % 9 = 4", ticket_id=-c("ticket_id") - 1,
            closed_time=F.when(c("closed_time").isNull(), c("opened_time")))),
        message_feedback=t.message_feedback.unionByName(spoken),
        invoice=t.invoice.unionByName(more("invoice", "invoice_id % 500 = 3", amount=F.lit(None))))


def _on_damaged(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(damaged(bind(spark, sf_dir)))
    run.__name__ = fn.__name__
    return run


RULE_JOBS = ["generate_invoices", "mark_paid", "start_conversations", "upsert_feedback", "archive_conversations",
             "move_conversations", "add_users", "update_users", "delete_users", "create_workspaces",
             "modify_workspaces", "add_members", "create_personas", "update_personas", "delete_personas",
             "add_templates", "update_templates", "share_templates", "create_tickets", "assign_tickets",
             "resolve_tickets"]


def run_job(t, name: str):
    """Run rule job ``name`` on its request table derived from the bound test tables."""
    req = getattr(Q, name)(t)
    if name == "admit_messages":
        # replay of most of the message log: the prior table holds the messages that are not replayed
        prior = t.message.join(req.select(F.col("req_id").alias("message_id")), "message_id", "left_anti")
        return J.admit_messages(t, req, prior)
    if name == "add_bookmarks":
        return J.add_bookmarks(t, req)
    return getattr(J, name)(t, req)


def _decisions(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_job(bind(spark, sf_dir), name).decisions
    run.__name__ = name
    return run


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind(spark, sf_dir)
    return J.cascade_summary(t, run_job(t, "delete_users").tables)


def _admit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming limiter over the replayed message log: requests are written once as files (the stream
    source), processed with an availableNow trigger into a parquet sink, and the sink is read back."""
    from convops.sources.store import new_version_dir
    from convops.streaming.admit_stream import admit_stream, complete_decisions, read_requests, run_to_completion
    t = bind(spark, sf_dir)
    req = Q.admit_messages(t)
    root = new_version_dir(spark, label="admit-stream")
    req.write.mode("errorifexists").parquet(f"{root}/source")
    prior = t.message.join(req.select(F.col("req_id").alias("message_id")), "message_id", "left_anti")
    decisions = admit_stream(t, read_requests(spark, f"{root}/source"), prior)
    run_to_completion(decisions, f"{root}/sink", f"{root}/_checkpoint")
    return complete_decisions(spark, f"{root}/source", f"{root}/sink")


def _admit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter over stored counts, batch by batch, on the same replayed log."""
    from convops.sources.store import new_version_dir
    from convops.streaming.admit_batches import admit_in_batches
    from convops.streaming.admit_stream import read_requests
    t = bind(spark, sf_dir)
    req = Q.admit_messages(t)
    root = new_version_dir(spark, label="admit-batches")
    req.write.mode("errorifexists").parquet(f"{root}/source")
    prior = t.message.join(req.select(F.col("req_id").alias("message_id")), "message_id", "left_anti")
    return admit_in_batches(read_requests(spark, f"{root}/source"), root, lambda s: bind(s, sf_dir), prior)


def _admit_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter as a stateful processor with initial counts, on the same replayed log."""
    from convops.sources.store import new_version_dir
    from convops.streaming.admit_processor import admit_processor
    from convops.streaming.admit_stream import read_requests, run_to_completion
    t = bind(spark, sf_dir)
    req = Q.admit_messages(t)
    root = new_version_dir(spark, label="admit-processor")
    req.write.mode("errorifexists").parquet(f"{root}/source")
    prior = t.message.join(req.select(F.col("req_id").alias("message_id")), "message_id", "left_anti")
    run_to_completion(admit_processor(t, read_requests(spark, f"{root}/source"), prior), f"{root}/sink", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/sink")


def _facts(df: DataFrame, name: str) -> DataFrame:
    """One row per column: rows, rows with a value, least and greatest value as text (one aggregate pass, every
    column read)."""
    def text(c, kind: str):
        if kind.startswith("decimal") or kind == "double":
            return F.format_string("%.2f", c.cast("double"))
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c.cast("string")
    columns = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("row_count"), F.count(c).alias("filled"),
                        text(F.min(c), kind).alias("low"), text(F.max(c), kind).alias("high")) for c, kind in df.dtypes]
    return (df.agg(F.array(*columns).alias("all")).select(F.explode("all").alias("one"))
            .select(F.lit(name).alias("table"), "one.*"))


def _scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed scan of all fifteen platform tables, every column."""
    from convops.sources.schemas import TABLES
    t = bind(spark, sf_dir)
    return reduce(DataFrame.unionByName, [_facts(t[name], name) for name in TABLES])


def _write_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a rule job, persist its outputs as a new version folder (errorifexists) and read the completed version."""
    from convops.sources.store import new_version_dir, read_version, write_version
    t = bind(spark, sf_dir)
    folder = new_version_dir(spark, label="generate_invoices")
    write_version(run_job(t, "generate_invoices"), folder)
    return reduce(DataFrame.unionByName, [_facts(df, name) for name, df in sorted(read_version(spark, folder).items())])


def _version(job: str, table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_job(bind(spark, sf_dir), job).tables[table]
    run.__name__ = f"{job}__{table}"
    return run


def rule_queries() -> dict[str, Query]:
    out = {name: _decisions(name) for name in RULE_JOBS + ["admit_messages", "add_bookmarks"]}
    out["cascade_delete"] = _cascade
    out["admit_messages_stream"] = _admit_stream
    out["admit_messages_batches"] = _admit_batches
    out["admit_messages_processor"] = _admit_processor
    out["scan_tables"] = _scan_tables
    out["write_version"] = _write_version
    out |= {f"{job}__{table}": _version(job, table) for job, table in VERSION_KEYS}
    return out


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(report_queries())
    out.update(audit_queries())
    out.update(rule_queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(reports_sql())
    out.update(audits_sql())
    out.update(rules_sql())
    return out
