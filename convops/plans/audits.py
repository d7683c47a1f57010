"""Integrity audits: the DDL constraints and documented invariants, checked set-at-a-time over whole tables.

Every audit returns rows shaped ``(rule, table, key, detail)`` — one row per violation; an empty frame means the
rule holds. Key-uniqueness and FD checks are aggregates (map-side partial counts, so a hot key collapses before the
shuffle); foreign keys are one aggregate over the ids of all tables; value checks are plain filters fused into the scan
stage. The metadata (keys, enums, lengths, foreign keys) comes from ``sources.schemas`` so adding a table extends every
audit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convops.session import kept
from convops.sources.binding import Tables
from convops.sources.schemas import (CLOSED_TICKET_STATUSES, ENUMS, FOREIGN_KEYS, LENGTHS, PRIMARY_KEYS, TABLES,
                                     UNIQUE_KEYS, not_null_columns, text_columns)

# --- fixed values: declared functional dependencies (left side -> right side) ------------------------------------
FDS: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("tier", ("tier_id",), ("tier_name", "cost", "message_limit", "pro_access")),
    ("tier", ("tier_name",), ("tier_id", "cost", "message_limit", "pro_access")),
    ("llm_user", ("user_id",), ("tier_id", "name", "email", "creation_date", "language")),
    ("llm_user", ("email",), ("user_id", "tier_id", "name", "creation_date", "language")),
    ("billing_record", ("user_id",), ("payment_method", "billing_address")),
    ("invoice", ("invoice_id",), ("user_id", "tier_id", "invoice_date", "amount", "payment_status")),
    ("workspace", ("workspace_id",), ("owner_id", "name", "visibility", "created_at")),
    ("workspace_member", ("workspace_id", "user_id"), ("role", "joined_at")),
    ("persona", ("persona_id",), ("owner_user_id", "name", "instructions", "created_at")),
    ("persona", ("owner_user_id", "name"), ("persona_id", "instructions", "created_at")),
    ("conversation", ("conversation_id",), ("user_id", "workspace_id", "persona_id", "title", "start_time", "status",
                                            "persona_name_snapshot", "persona_instr_snapshot")),
    ("message", ("message_id",), ("conversation_id", "sender_role", "time_sent", "content")),
    ("message_feedback", ("feedback_id",), ("message_id", "rating", "comment_text", "submitted_at")),
    ("message_feedback", ("message_id",), ("feedback_id", "rating", "comment_text", "submitted_at")),
    ("message_bookmark", ("user_id", "message_id"), ("bookmarked_time",)),
    ("prompt_template", ("template_id",), ("owner_user_id", "name", "text", "category", "visibility", "created_at")),
    ("workspace_prompt_template", ("workspace_id", "template_id"), ("shared_at",)),
    ("support_agent", ("agent_id",), ("name", "email", "specialty", "hired_date")),
    ("support_agent", ("email",), ("agent_id", "name", "specialty", "hired_date")),
    ("support_ticket", ("ticket_id",), ("user_id", "agent_id", "topic_name", "opened_time", "closed_time", "status")),
]



def _key(cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _shape(df: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.alias("key"),
                     detail.cast("string").alias("detail"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- row-level rules: one pass per table ---------------------------------------------------------------------
# Per-table checks are written as Spark SQL expression text: one parsed projection per table instead of hundreds
# of Column objects built over the Python-JVM bridge (the same plan, a fraction of the driver-side build time).

def _q(c: str) -> str:
    return f"`{c}`"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _key_sql(cols) -> str:
    return "concat_ws('|', " + ", ".join(f"cast({_q(c)} as string)" for c in cols) + ")"


def _row_violations(table: str, rules: set[str]) -> list[tuple[str, str]]:
    """(rule, detail SQL) pairs for ``table``; the detail is NULL when the row passes that check."""
    out: list[tuple[str, str]] = []
    if "not_null" in rules:
        texts = text_columns(table)
        for c in not_null_columns(table):
            missing = f"{_q(c)} IS NULL" + (f" OR trim({_q(c)}) = ''" if c in texts else "")
            out.append(("not_null", f"CASE WHEN {missing} THEN {_lit(c)} END"))
    if "enum" in rules:
        for tb, c, allowed in ENUMS:
            if tb == table:
                vals = ", ".join(_lit(v) for v in allowed)
                out.append(("enum", f"CASE WHEN {_q(c)} IS NOT NULL AND {_q(c)} NOT IN ({vals}) "
                                    f"THEN concat({_lit(c + '=')}, {_q(c)}) END"))
    if "length" in rules:
        for tb, c, n in LENGTHS:
            if tb == table:
                out.append(("length", f"CASE WHEN length({_q(c)}) > {n} THEN concat({_lit(c + ' length ')}, "
                                      f"cast(length({_q(c)}) as string), {_lit(f' > {n}')}) END"))
    if "ticket_closed" in rules and table == "support_ticket":
        closed = "status IN (" + ", ".join(_lit(v) for v in CLOSED_TICKET_STATUSES) + ")"
        out.append(("ticket_closed", f"CASE WHEN ({closed}) <> (closed_time IS NOT NULL) THEN concat(status, "
                                     "CASE WHEN closed_time IS NULL THEN ' without closed_time' "
                                     "ELSE ' with closed_time' END) END"))
    return out


def _explode_failures(df: DataFrame, key_sql: str, table: str, checks: list[tuple[str, str]]) -> DataFrame:
    """One output row per (input row, failed check). Rows are first filtered by a plain OR of the failure
    conditions (code-generated, evaluated once per row); only failing rows build the array of findings."""
    any_fail = " OR ".join(f"({d}) IS NOT NULL" for _, d in checks)
    arr = "array(" + ", ".join(f"named_struct('rule', {_lit(r)}, 'detail', cast(({d}) as string))"
                               for r, d in checks) + ")"
    return (df.where(F.expr(any_fail))
              .selectExpr(f"{key_sql} AS key", f"explode(filter({arr}, x -> x.detail IS NOT NULL)) AS __x")
              .selectExpr("__x.rule AS rule", f"{_lit(table)} AS `table`", "key", "__x.detail AS detail"))


def _row_pass(df: DataFrame, table: str, checks: list[tuple[str, str]]) -> DataFrame:
    """Evaluate all checks in one scan; emit one row per (row, failed check)."""
    return _explode_failures(df, _key_sql(PRIMARY_KEYS[table]), table, checks)


def _row_audit(t: Tables, rules: set[str]) -> DataFrame:
    frames = []
    raw_messages = "message_raw" in t.names()  # hand-made tables may have no feed; stored and bound ones always do
    for table in TABLES:
        own = rules - {"enum"} if (table == "message" and raw_messages) else rules
        checks = _row_violations(table, own)
        if checks:
            frames.append(_row_pass(t[table], table, checks))
        if table == "message" and raw_messages and "enum" in rules:
            # roles outside the enum only exist in the raw feed, before the platform table's role filter
            frames.append(_row_pass(t.message_raw, table, _row_violations(table, {"enum"})))
    return _union(frames)


# --- key rules: one aggregation per (table, key set) ---------------------------------------------------------
def _key_audit(t: Tables, rules: set[str]) -> DataFrame:
    """Primary keys, unique keys and functional dependencies, one hash aggregate per (table, key set).

    The dependent columns of an FD enter as one 64-bit hash, of which the least and the greatest per key are kept:
    texts never reach a shuffle, aggregates are fixed-width and partial (map-side), so a hot key collapses first.
    Each column is wrapped before hashing, so a NULL and a neighbour's value can't change places unnoticed."""
    frames = []
    for table in TABLES:
        key_sets: list[tuple[str, ...]] = []
        if "primary_key" in rules:
            key_sets.append(PRIMARY_KEYS[table])
        if "unique_key" in rules:
            key_sets += [cols for tb, cols in UNIQUE_KEYS if tb == table]
        fds = [(lhs, rhs) for tb, lhs, rhs in FDS if tb == table] if "fd" in rules else []
        key_sets += [lhs for lhs, _ in fds]
        for ks in dict.fromkeys(key_sets):
            my_fds = [rhs for lhs, rhs in fds if lhs == ks]
            # one fixed-width hash per right side: X -> Y fails iff a group holds two different Y, so two hashes
            hashed = [F.xxhash64(*(F.struct(F.col(c)) for c in rhs)).alias(f"__y{i}") for i, rhs in enumerate(my_fds)]
            counts = t[table].select(*ks, *hashed).groupBy(*ks).agg(
                F.count(F.lit(1)).alias("__n"), *(f(f"__y{i}").alias(f"__{n}{i}") for i in range(len(my_fds))
                                                  for n, f in (("lo", F.min), ("hi", F.max))))
            any_null = " OR ".join(f"{_q(c)} IS NULL" for c in ks)
            checks: list[tuple[str, str]] = []
            if "primary_key" in rules and ks == PRIMARY_KEYS[table]:
                checks.append(("primary_key", f"CASE WHEN {any_null} THEN 'null key' "
                                              "WHEN __n > 1 THEN concat('duplicate x', cast(__n as string)) END"))
            if "unique_key" in rules and (table, ks) in UNIQUE_KEYS:
                checks.append(("unique_key", f"CASE WHEN NOT ({any_null}) AND __n > 1 THEN "
                                             f"concat({_lit(','.join(ks) + ' duplicate x')}, cast(__n as string)) END"))
            checks += [("fd", f"CASE WHEN __lo{i} <> __hi{i} THEN {_lit(','.join(ks) + ' -> ' + ','.join(rhs))} END")
                       for i, rhs in enumerate(my_fds)]
            if checks:
                frames.append(_explode_failures(counts, _key_sql(ks), table, checks))
    return _union(frames)


def audit_primary_keys(t: Tables) -> DataFrame:
    return _key_audit(t, {"primary_key"})


def audit_unique_keys(t: Tables) -> DataFrame:
    return _key_audit(t, {"unique_key"})


def audit_not_null(t: Tables) -> DataFrame:
    """NOT NULL columns holding NULL — or blank text, which the reference's database stores as NULL."""
    return _row_audit(t, {"not_null"})


def audit_enums(t: Tables) -> DataFrame:
    return _row_audit(t, {"enum"})


def audit_ticket_closed(t: Tables) -> DataFrame:
    return _row_audit(t, {"ticket_closed"})


def orphan_keys(t: Tables) -> DataFrame:
    """(parent, key, fks): keys that rows refer to and their parent table doesn't hold; bit i of ``fks`` is set when
    FOREIGN_KEYS[i] is broken there.

    Every table is scanned once and gives, for each row, its own key as a parent and the keys it refers to; one
    aggregate over (parent, key) decides all foreign keys. Its partial step collapses a hot key before the shuffle, and
    nothing but ids is shuffled.
    """
    parents = {p: i for i, p in enumerate(dict.fromkeys((fk.parent, fk.parent_columns) for fk in FOREIGN_KEYS))}
    entries: dict[str, list[str]] = {}

    def add(table: str, parent: int, columns: tuple[str, ...], fks: int) -> None:
        (column,) = columns  # all keys referred to have one column
        entries.setdefault(table, []).append(
            f"named_struct('parent', {parent}, 'key', cast({_q(column)} AS bigint), 'own', {str(not fks).lower()}, "
            f"'fks', {fks}L)")
    for (table, columns), i in parents.items():
        add(table, i, columns, 0)
    for n, fk in enumerate(FOREIGN_KEYS):
        add(fk.child, parents[fk.parent, fk.parent_columns], fk.columns, 1 << n)
    keys = _union([t[table].selectExpr(f"inline(array({', '.join(made)}))") for table, made in entries.items()])
    return (keys.where("key IS NOT NULL").groupBy("parent", "key")
            .agg(F.max("own").alias("own"), F.bit_or("fks").alias("fks"))
            .where("NOT own").select("parent", "key", "fks"))


def audit_foreign_keys(t: Tables) -> DataFrame:
    """References to rows that aren't there. ``orphan_keys`` is computed and stored first; only tables of a foreign key
    that fails are read again for the rows to report."""
    orphans = kept(orphan_keys(t), "orphan-keys")
    broken = orphans.agg(F.bit_or("fks").alias("fks")).first()["fks"] or 0  # one row
    out = [t.spark.createDataFrame([], "rule string, table string, key string, detail string")]
    for n, fk in enumerate(FOREIGN_KEYS):
        if broken >> n & 1:
            (column,) = fk.columns
            keys = orphans.where(F.col("fks").bitwiseAND(F.lit(1 << n)) != 0).select(F.col("key").alias("__key"))
            rows = t[fk.child].join(keys, F.col(column) == F.col("__key"), "left_semi")
            out.append(_shape(rows, "foreign_key", fk.child, _key(PRIMARY_KEYS[fk.child]),
                              F.lit(f"{column} -> {fk.parent}")))
    return _union(out)


def audit_lengths(t: Tables) -> DataFrame:
    return _row_audit(t, {"length"})


def audit_feedback_role(t: Tables) -> DataFrame:
    f = t.message_feedback.select("feedback_id", "message_id")
    m = t.message.where(F.col("sender_role") != "AI").select("message_id", "sender_role")
    return _shape(f.join(m, "message_id"), "feedback_role", "message_feedback", _key(["feedback_id"]),
                  F.concat(F.lit("feedback on "), F.col("sender_role"), F.lit(" message")))


def audit_private_shared(t: Tables) -> DataFrame:
    w = t.workspace_prompt_template.select("workspace_id", "template_id")
    p = t.prompt_template.where(F.col("visibility") == "PRIVATE").select("template_id")
    return _shape(w.join(p, "template_id"), "private_shared", "workspace_prompt_template",
                  _key(["workspace_id", "template_id"]), F.lit("PRIVATE template shared"))


def audit_billing_total(t: Tables) -> DataFrame:
    b = t.billing_record.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    u = t.llm_user.select("user_id").join(b, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _shape(u.where(F.col("n") != 1), "billing_total", "llm_user", _key(["user_id"]),
                  F.concat(F.lit("billing records: "), F.col("n").cast("string")))


def audit_workspace_owner(t: Tables) -> DataFrame:
    owners = (t.workspace_member.where(F.col("role") == "OWNER")
              .select(F.col("workspace_id").alias("__w"), F.col("user_id").alias("__u")))
    w = t.workspace.select("workspace_id", "owner_id")
    bad = w.join(owners, (F.col("workspace_id") == F.col("__w")) & (F.col("owner_id") == F.col("__u")), "left_anti")
    return _shape(bad, "workspace_owner", "workspace", _key(["workspace_id"]), F.lit("owner has no OWNER membership"))


def audit_workspace_access(t: Tables) -> DataFrame:
    c = t.conversation.where(F.col("workspace_id").isNotNull()).select("conversation_id", "workspace_id", "user_id")
    wm = t.workspace_member.select("workspace_id", "user_id")
    bad = c.join(wm, ["workspace_id", "user_id"], "left_anti")
    return _shape(bad, "workspace_access", "conversation", _key(["conversation_id"]),
                  F.concat(F.lit("owner not member of workspace "), F.col("workspace_id").cast("string")))


def audit_rate_limit(t: Tables) -> DataFrame:
    """User-days whose USER messages exceed the tier's daily limit (counted across all the user's conversations)."""
    m = (t.message.where(F.col("sender_role") == "USER")
         .groupBy("conversation_id", F.to_date("time_sent").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    c = t.conversation.select("conversation_id", "user_id")
    per_day = m.join(c, "conversation_id").groupBy("user_id", "day").agg(F.sum("n").alias("n"))
    lim = t.llm_user.select("user_id", "tier_id").join(t.tier.select("tier_id", "message_limit"), "tier_id")
    bad = per_day.join(lim, "user_id").where(F.col("n") > F.col("message_limit"))
    return _shape(bad, "rate_limit", "message", _key(["user_id", "day"]),
                  F.concat(F.col("n").cast("string"), F.lit(" > "), F.col("message_limit").cast("string")))


def audit_fds(t: Tables) -> DataFrame:
    """X -> Y holds iff no X group has two different Y (checked as min(Y) != max(Y): no distinct aggregation)."""
    return _key_audit(t, {"fd"})


def persona_snapshot_drift(t: Tables) -> DataFrame:
    """The documented non-FD persona_id -> persona_name_snapshot: personas whose conversations carry >1 snapshot."""
    g = (t.conversation.where(F.col("persona_id").isNotNull() & F.col("persona_name_snapshot").isNotNull())
         .groupBy("persona_id").agg(F.countDistinct("persona_name_snapshot").alias("n"))
         .where(F.col("n") > 1))
    return _shape(g, "snapshot_drift", "conversation", _key(["persona_id"]),
                  F.concat(F.lit("snapshots: "), F.col("n").cast("string")))


AUDITS = {
    "audit_primary_keys": audit_primary_keys,
    "audit_unique_keys": audit_unique_keys,
    "audit_not_null": audit_not_null,
    "audit_enums": audit_enums,
    "audit_ticket_closed": audit_ticket_closed,
    "audit_foreign_keys": audit_foreign_keys,
    "audit_lengths": audit_lengths,
    "audit_feedback_role": audit_feedback_role,
    "audit_private_shared": audit_private_shared,
    "audit_billing_total": audit_billing_total,
    "audit_workspace_owner": audit_workspace_owner,
    "audit_workspace_access": audit_workspace_access,
    "audit_rate_limit": audit_rate_limit,
    "audit_fds": audit_fds,
    "persona_snapshot_drift": persona_snapshot_drift,
}


def audit_all(t: Tables) -> DataFrame:
    """Every audit in one frame. Row-level rules share one scan per table, key rules one aggregate per
    (table, key set); the reference and cross-table rules are joins."""
    rest = [fn(t) for name, fn in AUDITS.items()
            if name not in ("audit_primary_keys", "audit_unique_keys", "audit_fds", "audit_not_null", "audit_enums",
                            "audit_ticket_closed", "audit_lengths")]
    return _union([_row_audit(t, {"not_null", "enum", "length", "ticket_closed"}),
                   _key_audit(t, {"primary_key", "unique_key", "fd"})] + rest)
