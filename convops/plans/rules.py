"""Business rules as set-at-a-time jobs.

Contract (all jobs): ``job(t, requests) -> JobResult`` where ``requests`` carries ``req_id``, ``req_ts`` and the
job's fields; ``JobResult.decisions`` has one row per request (``status`` accepted/rejected, ``reason`` = first
failing check in the reference's order) and ``JobResult.tables`` holds the new versions of the changed tables. The
request's ``req_ts`` is its "now" (never ``current_timestamp()``), and requests apply in (req_ts, req_id) order.

Row-at-a-time effects inside a batch are reproduced exactly with set operations:
* "already exists" checks also see earlier accepted requests of the same batch (``mark_first`` — an aggregate, so
  a hot key is collapsed map-side);
* field updates keep the last accepted request per (row, field) (``last_per_key``), then one left join per table;
* rate limiting ranks a user's USER messages of a day (``running_rank`` — hot user-days split by range partitioning);
* new ids follow the sequence order (``assign_ids`` — per-partition offsets, no single-task window).
Existence probes are joins against key sets. Text fields are trimmed as typed (blank = NULL); a value longer than its
column is refused as the insert would be.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convops import functions as cf
from convops.operators.claims import resolve_claims
from convops.operators.decide import ACCEPTED, REJECTED, JobResult, with_reason
from convops.operators.dedup import last_per_key, mark_first
from convops.operators.ids import assign_ids, max_id
from convops.operators.lookups import flag_exists
from convops.operators.ranking import running_rank
from convops.session import checkpoint_dir
from convops.sources.binding import Tables
from convops.sources.schemas import FOREIGN_KEYS, LENGTHS, OPEN_TICKET_STATUSES, PRIMARY_KEYS, SCHEMAS, TABLES

ORDER = ["req_ts", "req_id"]


def _acc() -> Column:
    return F.col("status") == ACCEPTED


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def _when_acc(c: Column) -> Column:
    return F.when(_acc(), c)


def _with_new_ids(decided: DataFrame, base: Column, id_col: str, eligible: Column | None = None) -> DataFrame:
    """Accepted rows (or ``eligible`` rows) get base+1, base+2, ... in request order; the others get NULL.

    Ids are assigned on a narrow projection (req_id, req_ts) and joined back on the unique req_id, so the
    checkpoint inside ``assign_ids`` never carries the request payload (titles, instructions, message text).
    """
    cond = _acc() if eligible is None else eligible
    ids = assign_ids(decided.where(cond).select(*ORDER), ORDER, base, id_col).select("req_id", id_col)
    return decided.join(ids, "req_id", "left")


def _trimmed(df: DataFrame, *cols: str) -> DataFrame:
    """Text fields as the prompt stores them: trimmed, blank = NULL."""
    return df.withColumns({c: cf.blank_to_null(F.col(c)) for c in cols})


def _fits(table: str, *cols: str) -> Column:
    limits = {c: n for tb, c, n in LENGTHS if tb == table}
    return reduce(lambda a, b: a & b, [cf.no_longer_than(F.col(c), limits[c]) for c in cols])


def _filled(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _value_fits(table: str, fields: dict[int, str]) -> Column:
    """Does ``value`` fit the column that ``field`` names? (columns without a declared length always do)"""
    limits = {c: n for tb, c, n in LENGTHS if tb == table}
    out = F.lit(True)
    for code, c in fields.items():
        if c in limits:
            out = F.when(F.col("field") == code, cf.no_longer_than(F.col("value"), limits[c])).otherwise(out)
    return out


def _apply_updates(base: DataFrame, key: str, updates: DataFrame, fields: dict[int, tuple[str, Column]]) -> DataFrame:
    """Apply the last accepted update per (key, field): ``fields`` maps field code -> (column, new value expr).

    One row per (key, field) survives ``last_per_key``; a groupBy(key) folds them into one row per key with a
    column per field, and a single left join applies them to the table.
    """
    last = last_per_key(updates, [key, "field"], ORDER)
    folded = last.groupBy(key).agg(*[F.max(F.when(F.col("field") == code, F.struct(expr.alias("v")))).alias(f"__f{code}")
                                     for code, (_, expr) in fields.items()])
    out = base.join(folded, key, "left")
    for code, (col, _) in fields.items():
        out = out.withColumn(col, F.when(F.col(f"__f{code}").isNotNull(), F.col(f"__f{code}.v")).otherwise(F.col(col)))
    return out.drop(*[f"__f{code}" for code in fields])


# --- billing ----------------------------------------------------------------------------------------------------
def generate_invoices(t: Tables, req: DataFrame) -> JobResult:
    """User must exist; snapshot the user's current tier and its cost; 'Paid' when the cost is 0, else 'Unpaid'."""
    u = t.llm_user.select("user_id", F.col("tier_id").alias("cur_tier"))
    tier = t.tier.select(F.col("tier_id").alias("cur_tier"), "cost")
    d = req.join(u, "user_id", "left").join(tier, "cur_tier", "left")
    d = with_reason(d, [("no_user", F.col("cur_tier").isNotNull()), ("no_tier", F.col("cost").isNotNull())])
    d = _with_new_ids(d, max_id(t.invoice, "invoice_id"), "invoice_id")
    d = d.select("req_id", "req_ts", "user_id", "status", "reason", "invoice_id",
                 _when_acc(F.col("cur_tier")).alias("tier_id"), _when_acc(F.col("cost")).alias("amount"),
                 _when_acc(F.when(F.col("cost") == 0, "Paid").otherwise("Unpaid")).alias("payment_status"))
    new_rows = d.where(_acc()).select("invoice_id", "user_id", "tier_id", F.col("req_ts").alias("invoice_date"),
                                   "amount", "payment_status")
    decisions = d.withColumn("amount", F.col("amount").cast("double")).drop("req_ts")
    return JobResult(decisions, {"invoice": t.invoice.unionByName(_typed(new_rows, "invoice"))})


def mark_paid(t: Tables, req: DataFrame) -> JobResult:
    """Invoice must exist; its status becomes 'Paid' whatever it was."""
    d = flag_exists(req, t.invoice, "invoice_id", "found", unique=True)
    d = with_reason(d, [("no_invoice", F.col("found"))]).select("req_id", "invoice_id", "status", "reason")
    paid = flag_exists(t.invoice, d.where(_acc()), "invoice_id", "__paid")
    inv = paid.withColumn("payment_status", F.when(F.col("__paid"), F.lit("Paid")).otherwise(F.col("payment_status")))
    return JobResult(d, {"invoice": inv.drop("__paid")})


# --- conversations --------------------------------------------------------------------------------------------
def start_conversations(t: Tables, req: DataFrame) -> JobResult:
    """User must exist; an unknown persona means no persona; an unknown workspace rejects; an optional id that is not
    a number means none; snapshots are copied."""
    d = _trimmed(req, "title").withColumns({c: cf.opt_long(F.col(c)) for c in ("persona_id", "workspace_id")})
    d = flag_exists(d, t.llm_user, "user_id", "user_ok", unique=True)
    p = t.persona.select(F.col("persona_id").alias("__pid"), F.col("name").alias("persona_name_snapshot"),
                         F.col("instructions").alias("persona_instr_snapshot"))
    d = d.join(p, F.col("persona_id") == F.col("__pid"), "left").withColumn("persona_id", F.col("__pid")).drop("__pid")
    d = flag_exists(d, t.workspace, "workspace_id", "ws_ok", unique=True)
    d = with_reason(d, [("no_user", F.col("user_ok")),
                        ("no_workspace", F.col("workspace_id").isNull() | F.col("ws_ok")),
                        ("null", F.col("title").isNotNull()), ("too_long", _fits("conversation", "title"))])
    d = _with_new_ids(d, max_id(t.conversation, "conversation_id"), "conversation_id")
    new_rows = d.where(_acc()).select("conversation_id", "user_id", "workspace_id", "persona_id", "title",
                                   F.col("req_ts").alias("start_time"), F.lit("ACTIVE").alias("status"),
                                   "persona_name_snapshot", "persona_instr_snapshot")
    decisions = d.select("req_id", "user_id", "status", "reason", "conversation_id",
                         _when_acc(F.col("persona_id")).alias("persona_id"),
                         _when_acc(F.col("workspace_id")).alias("workspace_id"),
                         _when_acc(F.col("persona_name_snapshot")).alias("persona_name_snapshot"))
    return JobResult(decisions, {"conversation": t.conversation.unionByName(_typed(new_rows, "conversation"))})


def owner_days(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """owner_id, day, n: USER messages, counted per conversation and day before they meet the conversation."""
    per_conversation = (messages.where(F.col("sender_role") == "USER")
                        .groupBy("conversation_id", F.to_date("time_sent").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    return (per_conversation.join(conversations, "conversation_id")
            .groupBy("owner_id", "day").agg(F.sum("n").alias("n")))


def admit_messages(t: Tables, req: DataFrame, prior: DataFrame | None = None) -> JobResult:
    """Conversation must exist; code 1 = USER, else AI. A USER message is rejected once the conversation owner's
    USER messages of that calendar day — across all conversations, prior ones included — reached the tier limit.
    AI messages are never limited; an owner without a tier has no limit.

    accepted <=> prior_count(owner, day) + rank within the batch(owner, day) <= limit (rejected ones never count).
    A message without text is refused after the limit was tested and uses up none of it.
    """
    prior = t.message if prior is None else prior
    conv = t.conversation.select("conversation_id", F.col("user_id").alias("owner_id"))
    lim = (t.llm_user.select(F.col("user_id").alias("owner_id"), "tier_id")
           .join(t.tier.select("tier_id", "message_limit"), "tier_id").drop("tier_id"))
    d = (_trimmed(req, "content").withColumn("sender_role", cf.role_from_code(F.col("role_code")))
            .join(conv, "conversation_id", "left"))
    prior_counts = owner_days(prior, conv).withColumnRenamed("n", "prior_n")
    # limits are looked at on a narrow projection (no message text), then attached by the unique req_id
    counted = (d.where(F.col("owner_id").isNotNull() & (F.col("sender_role") == "USER"))
               .select("req_id", "req_ts", "owner_id", F.to_date("req_ts").alias("day"),
                       F.col("content").isNotNull().alias("written")))
    ranks = running_rank(counted, ["owner_id", "day"], "req_ts", ["req_id"], "day_rank", counts_if="written")
    over = (ranks.join(prior_counts, ["owner_id", "day"], "left").join(lim, "owner_id")
            .where(F.coalesce(F.col("prior_n"), F.lit(0)) + F.col("day_rank") > F.col("message_limit"))
            .select("req_id", F.lit(True).alias("over")))
    d = d.join(over, "req_id", "left")
    d = with_reason(d, [("no_conversation", F.col("owner_id").isNotNull()), ("rate_limit", F.col("over").isNull()),
                        ("null", F.col("content").isNotNull())])
    d = _with_new_ids(d, max_id(prior, "message_id"), "message_id")
    new_rows = d.where(_acc()).select("message_id", "conversation_id", "sender_role", F.col("req_ts").alias("time_sent"),
                                   "content")
    decisions = d.select("req_id", "conversation_id", "sender_role", "status", "reason", "message_id")
    return JobResult(decisions, {"message": _typed(prior, "message").unionByName(_typed(new_rows, "message"))})


def upsert_feedback(t: Tables, req: DataFrame) -> JobResult:
    """Message must exist and be AI. Code 1 = Thumbs Up, else Thumbs Down; blank comment = NULL. Existing feedback
    is overwritten (rating, comment, time; id kept), otherwise inserted; later requests on a message win."""
    checkpoint_dir(t.spark)
    d = req.join(t.message.select("message_id", "sender_role"), "message_id", "left")
    d = with_reason(d, [("no_message", F.col("sender_role").isNotNull()), ("not_ai", F.col("sender_role") == "AI")])
    d = (d.withColumn("rating", cf.rating_from_code(F.col("rating_code")))
          .withColumn("comment_text", cf.blank_to_null(F.col("comment"))))
    # one row per message: its first accepted request (which inserts), its last one (whose values stay)
    per = (d.where(_acc()).groupBy("message_id")
           .agg(F.min(F.struct("req_ts", "req_id")).alias("first"),
                F.max(F.struct("req_ts", "req_id", "rating", "comment_text")).alias("last")))
    per = per.join(t.message_feedback.select("message_id", F.col("feedback_id").alias("existing_id")), "message_id", "left")
    fresh = per.where(F.col("existing_id").isNull()).select("message_id", "first.req_ts", "first.req_id")
    new_ids = assign_ids(fresh, ORDER, max_id(t.message_feedback, "feedback_id"), "new_id").select("message_id", "new_id")
    per = per.join(new_ids, "message_id", "left").withColumn("feedback_id", F.coalesce("existing_id", "new_id")).checkpoint()
    ids = per.select("message_id", "feedback_id", F.when(F.col("existing_id").isNull(), F.col("first.req_id")).alias("inserts"))
    d = d.join(ids, "message_id", "left")
    decisions = d.select("req_id", "message_id", "status", "reason",
                         _when_acc(F.when(F.col("inserts") == F.col("req_id"), "insert").otherwise("update")).alias("action"),
                         _when_acc(F.col("feedback_id")).alias("feedback_id"), _when_acc(F.col("rating")).alias("rating"),
                         _when_acc(F.col("comment_text")).alias("comment_text"))
    final = per.select("feedback_id", "message_id", "last.rating", "last.comment_text", F.col("last.req_ts").alias("submitted_at"))
    kept = t.message_feedback.join(per.select("message_id"), "message_id", "left_anti")
    return JobResult(decisions, {"message_feedback": _typed(kept, "message_feedback")
                                 .unionByName(_typed(final, "message_feedback"))})


def add_bookmarks(t: Tables, req: DataFrame, prior: DataFrame | None = None) -> JobResult:
    """User and message must exist; a pair already bookmarked (before, or earlier in the batch) is rejected.
    Bookmarking someone else's message is allowed."""
    prior = t.message_bookmark if prior is None else prior
    d = flag_exists(req, t.llm_user, "user_id", "user_ok", unique=True)
    d = flag_exists(d, t.message, "message_id", "msg_ok", unique=True)
    d = flag_exists(d, prior, ["user_id", "message_id"], "had", unique=True)
    d = mark_first(d, ["user_id", "message_id"], ORDER, "is_first")
    d = with_reason(d, [("no_user", F.col("user_ok")), ("no_message", F.col("msg_ok")),
                        ("duplicate", ~F.col("had") & F.col("is_first"))])
    decisions = d.select("req_id", "user_id", "message_id", "status", "reason")
    new_rows = d.where(_acc()).select("user_id", "message_id", F.col("req_ts").alias("bookmarked_time"))
    return JobResult(decisions, {"message_bookmark": _typed(prior, "message_bookmark")
                                 .unionByName(_typed(new_rows, "message_bookmark"))})


def archive_conversations(t: Tables, req: DataFrame) -> JobResult:
    """Conversation must exist; status becomes ARCHIVED (idempotent)."""
    d = flag_exists(req, t.conversation, "conversation_id", "found", unique=True)
    d = with_reason(d, [("no_conversation", F.col("found"))]).select("req_id", "conversation_id", "status", "reason")
    hit = flag_exists(t.conversation, d.where(_acc()), "conversation_id", "__hit")
    conv = hit.withColumn("status", F.when(F.col("__hit"), F.lit("ARCHIVED")).otherwise(F.col("status")))
    return JobResult(d, {"conversation": conv.drop("__hit")})


def move_conversations(t: Tables, req: DataFrame) -> JobResult:
    """Conversation and workspace must exist, and the conversation's owner must be a member of the target."""
    conv = t.conversation.select("conversation_id", F.col("user_id").alias("owner_id"))
    d = req.join(conv, "conversation_id", "left")
    d = flag_exists(d, t.workspace, "workspace_id", "ws_ok", unique=True)
    d = flag_exists(d, t.workspace_member, {"workspace_id": "workspace_id", "owner_id": "user_id"}, "member",
                    unique=True)
    d = with_reason(d, [("no_conversation", F.col("owner_id").isNotNull()), ("no_workspace", F.col("ws_ok")),
                        ("not_member", F.col("member"))])
    decisions = d.select("req_id", "conversation_id", "workspace_id", "status", "reason")
    last = last_per_key(d.where(_acc()).select("conversation_id", "workspace_id", "req_ts", "req_id"),
                        ["conversation_id"], ORDER)
    moved = (t.conversation.join(last.select("conversation_id", F.col("workspace_id").alias("__to")),
                                 "conversation_id", "left")
             .withColumn("workspace_id", F.coalesce(F.col("__to"), F.col("workspace_id"))).drop("__to"))
    return JobResult(decisions, {"conversation": _typed(moved, "conversation")})


# --- users ----------------------------------------------------------------------------------------------------
def add_users(t: Tables, req: DataFrame) -> JobResult:
    """Mandatory fields not blank; tier must exist; email unique (against the table and earlier requests).
    Inserts the user and, as a second write, the billing record (skipped when its fields are blank or too long)."""
    d = _trimmed(req, "name", "email", "language", "payment_method", "billing_address")
    d = flag_exists(d, t.tier, "tier_id", "tier_ok", unique=True)
    d = flag_exists(d, t.llm_user, "email", "email_taken")
    filled, fits = _filled("name", "email", "language"), _fits("llm_user", "name", "email", "language")
    d = mark_first(d.withColumn("__pre", filled & fits & F.col("tier_ok")), ["__pre", "email"], ORDER, "is_first")
    d = with_reason(d, [("null", filled), ("too_long", fits), ("no_tier", F.col("tier_ok")),
                        ("duplicate_email", ~F.col("email_taken") & F.col("is_first"))])
    d = _with_new_ids(d, max_id(t.llm_user, "user_id"), "user_id")
    acc = d.where(_acc())
    users = acc.select("user_id", "tier_id", "name", "email", F.col("req_ts").alias("creation_date"), "language")
    billing = (acc.where(_filled("payment_method", "billing_address")
                         & _fits("billing_record", "payment_method", "billing_address"))
               .select("user_id", "payment_method", "billing_address"))
    decisions = d.select("req_id", "status", "reason", "user_id", "email", _when_acc(F.col("tier_id")).alias("tier_id"))
    return JobResult(decisions, {"llm_user": t.llm_user.unionByName(_typed(users, "llm_user")),
                                 "billing_record": t.billing_record.unionByName(_typed(billing, "billing_record"))})


def _with_grants(d: DataFrame, asks: Column, owner: str, value: Column, holders: DataFrame) -> DataFrame:
    """Column ``granted``: the outcome of the requests that ask for a unique value; true for the others, which are
    passed by."""
    asked = d.withColumn("__asks", F.coalesce(asks, F.lit(False)))
    claims = asked.where("__asks")
    grants = resolve_claims(claims.select("req_id", "req_ts", F.col(owner).alias("owner"), value.alias("value")), holders)
    return (asked.where(~F.col("__asks")).withColumn("granted", F.lit(True))
            .unionByName(claims.join(grants, "req_id"))).drop("__asks")


USER_FIELDS = {1: "tier_id", 2: "name", 3: "email", 4: "language"}


def update_users(t: Tables, req: DataFrame) -> JobResult:
    """User must exist; field 1 tier (must exist), 2 name, 3 email (unique), 4 language; other codes change
    nothing (rejected as invalid_field). Blank values are NULL and rejected.

    An email is refused when another user holds it at that moment: changes earlier in the batch count, both the
    emails they took and those they freed (``resolve_claims``; only email requests go through it)."""
    u = t.llm_user.select("user_id", F.col("email").alias("cur_email"))
    d = _trimmed(req, "value").join(u, "user_id", "left")
    d = d.withColumn("tier_val", F.when(F.col("field") == 1, F.col("value").try_cast("long")))
    d = flag_exists(d, t.tier, {"tier_val": "tier_id"}, "tier_ok", unique=True)
    fits = _value_fits("llm_user", USER_FIELDS)
    asks = (F.col("field") == 3) & F.col("cur_email").isNotNull() & F.col("value").isNotNull() & fits
    d = _with_grants(d, asks, "user_id", F.col("value"), t.llm_user.select(F.col("user_id").alias("owner"),
                                                                           F.col("email").alias("value")))
    d = with_reason(d, [("no_user", F.col("cur_email").isNotNull()),
                        ("invalid_field", F.col("field").between(1, 4)),
                        ("null", F.col("value").isNotNull()), ("too_long", fits),
                        ("no_tier", (F.col("field") != 1) | F.col("tier_ok")),
                        ("duplicate_email", F.col("granted"))])
    decisions = d.select("req_id", "user_id", "field", "status", "reason")
    updates = d.where(_acc()).select("user_id", "field", "value", "req_ts", "req_id")
    new_users = _apply_updates(t.llm_user, "user_id", updates, {
        1: ("tier_id", F.col("value").try_cast("long")), 2: ("name", F.col("value")),
        3: ("email", F.col("value")), 4: ("language", F.col("value"))})
    return JobResult(decisions, {"llm_user": _typed(new_users, "llm_user")})


def delete_users(t: Tables, req: DataFrame) -> JobResult:
    """Rejected when the user has an Unpaid invoice, then an Open / In Progress ticket, then without 'YES', then when
    any ticket remains (the ticket FK restricts deletion). Accepted users are removed with the delete cascade."""
    d = flag_exists(req, t.llm_user, "user_id", "user_ok", unique=True)
    d = flag_exists(d, t.invoice, "user_id", "unpaid", where=F.col("payment_status") == "Unpaid")
    d = flag_exists(d, t.support_ticket, "user_id", "open_ticket", where=F.col("status").isin(*OPEN_TICKET_STATUSES))
    d = flag_exists(d, t.support_ticket, "user_id", "any_ticket")
    checks = [("no_user", F.col("user_ok")), ("unpaid_invoice", ~F.col("unpaid")), ("open_ticket", ~F.col("open_ticket")),
              ("not_confirmed", F.col("confirm") == "YES"), ("has_ticket", ~F.col("any_ticket"))]
    d = with_reason(d, checks)
    # a second accepted request for the same user finds it gone
    d = mark_first(d.withColumn("__ok", _acc()), ["__ok", "user_id"], ORDER, "is_first")
    d = (d.withColumn("reason", F.when(_acc() & ~F.col("is_first"), F.lit("no_user")).otherwise(F.col("reason")))
          .withColumn("status", F.when(F.col("reason").isNull(), F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))))
    decisions = d.select("req_id", "user_id", "status", "reason")
    deleted = decisions.where(_acc()).select("user_id")
    return JobResult(decisions, build=lambda: cascade_delete(t, {"llm_user": deleted}))


def _topological_tables() -> list[str]:
    done: list[str] = []
    pending = list(TABLES)
    while pending:
        for name in pending:
            parents = {fk.parent for fk in FOREIGN_KEYS if fk.child == name and fk.parent != name}
            if parents <= set(done):
                done.append(name)
                pending.remove(name)
                break
    return done


def _fk_depths() -> dict[str, int]:
    """Depth of every table in the FK graph (0 = no parent): tables of equal depth never reference each other."""
    depth: dict[str, int] = {}
    for table in _topological_tables():
        parents = {fk.parent for fk in FOREIGN_KEYS if fk.child == table and fk.parent != table}
        depth[table] = 1 + max((depth[p] for p in parents), default=-1)
    return depth


def cascade_delete(t: Tables, deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Apply the delete actions of every foreign key, from the deleted rows outwards (parents before children).

    ``deleted`` maps a table to the primary keys of its deleted rows. Children of deleted rows are removed
    (cascade) or get NULL in the referencing column (set null); restrict keys are left to the callers' guards.
    The deleted-key set of each table is checkpointed to the shared checkpoint folder: it is read by several child
    tables, and cutting the lineage keeps every level's plan small. Tables of the same FK depth are independent,
    so their checkpoints run as concurrent jobs, level by level. Returns new versions of all changed tables.
    """
    checkpoint_dir(t.spark)
    gone = {name: df.checkpoint(eager=True) for name, df in deleted.items()}
    out: dict[str, DataFrame] = {}
    for name in deleted:
        pk = list(PRIMARY_KEYS[name])
        out[name] = t[name].join(gone[name].select(*pk), pk, "left_anti")
    depth = _fk_depths()
    for level in sorted(set(depth.values())):
        pending: dict[str, DataFrame] = {}
        for table in [tb for tb in _topological_tables() if depth[tb] == level and tb not in deleted]:
            rows = t[table]
            cascade = [fk for fk in FOREIGN_KEYS if fk.child == table and fk.parent in gone and fk.on_delete == "cascade"]
            set_null = [fk for fk in FOREIGN_KEYS
                        if fk.child == table and fk.parent in gone and fk.on_delete == "set null"]
            if not cascade and not set_null:
                continue
            flags = []
            for i, fk in enumerate(cascade + set_null):
                name = f"__hit{i}"
                rows = flag_exists(rows, gone[fk.parent], dict(zip(fk.columns, fk.parent_columns)), name, unique=True)
                flags.append((fk, name))
            hit_any = reduce(lambda a, b: a | b, [F.col(n) for fk, n in flags if fk.on_delete == "cascade"],
                             F.lit(False))
            if cascade:
                pending[table] = rows.where(hit_any).select(*PRIMARY_KEYS[table])
            kept = rows.where(~hit_any)
            for fk, n in flags:
                if fk.on_delete == "set null":
                    for c in fk.columns:
                        kept = kept.withColumn(c, F.when(F.col(n), F.lit(None)).otherwise(F.col(c)))
            out[table] = _typed(kept.drop(*[n for _, n in flags]), table)
        if pending:
            with ThreadPoolExecutor(max_workers=len(pending)) as pool:
                futures = {name: pool.submit(df.checkpoint, True) for name, df in pending.items()}
                gone.update({name: f.result() for name, f in futures.items()})
    return out


def cascade_summary(t: Tables, new_tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts per changed table before and after a job: one tagged scan of each version, summed per table
    (partial aggregation, so only a few rows per task reach the shuffle)."""
    tagged = []
    for table, new in sorted(new_tables.items()):
        tagged.append(t[table].select(F.lit(table).alias("table"), F.lit(1).alias("b"), F.lit(0).alias("a")))
        tagged.append(new.select(F.lit(table).alias("table"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    rows = reduce(lambda x, y: x.unionByName(y), tagged)
    return rows.groupBy("table").agg(F.sum("b").cast("long").alias("rows_before"),
                                     F.sum("a").cast("long").alias("rows_after"))


# --- workspaces -----------------------------------------------------------------------------------------------
def create_workspaces(t: Tables, req: DataFrame) -> JobResult:
    """Owner must exist; code 2 = SHARED else PRIVATE; the owner also gets an OWNER membership."""
    d = flag_exists(_trimmed(req, "name"), t.llm_user, {"owner_id": "user_id"}, "owner_ok", unique=True)
    d = d.withColumn("visibility", cf.visibility_from_code(F.col("visibility_code")))
    d = with_reason(d, [("no_user", F.col("owner_ok")), ("null", F.col("name").isNotNull()),
                        ("too_long", _fits("workspace", "name"))])
    d = _with_new_ids(d, max_id(t.workspace, "workspace_id"), "workspace_id")
    acc = d.where(_acc())
    ws = acc.select("workspace_id", "owner_id", "name", "visibility", F.col("req_ts").alias("created_at"))
    own = acc.select("workspace_id", F.col("owner_id").alias("user_id"), F.lit("OWNER").alias("role"),
                     F.col("req_ts").alias("joined_at"))
    decisions = d.select("req_id", "owner_id", "status", "reason", "workspace_id",
                         _when_acc(F.col("visibility")).alias("visibility"))
    return JobResult(decisions, {"workspace": t.workspace.unionByName(_typed(ws, "workspace")),
                                 "workspace_member": t.workspace_member.unionByName(_typed(own, "workspace_member"))})


def modify_workspaces(t: Tables, req: DataFrame) -> JobResult:
    """Workspace must exist; field 1 renames, any other code sets the visibility (code 2 = SHARED)."""
    d = flag_exists(req, t.workspace, "workspace_id", "ws_ok", unique=True)
    d = d.withColumn("field", F.when(F.col("field") == 1, 1).otherwise(2))
    d = d.withColumn("value", F.when(F.col("field") == 1, cf.blank_to_null(F.col("name")))
                     .otherwise(cf.visibility_from_code(F.col("visibility_code"))))
    d = with_reason(d, [("no_workspace", F.col("ws_ok")), ("null", F.col("value").isNotNull()),
                        ("too_long", _value_fits("workspace", {1: "name", 2: "visibility"}))])
    decisions = d.select("req_id", "workspace_id", "field", "status", "reason")
    updates = d.where(_acc()).select("workspace_id", "field", "value", "req_ts", "req_id")
    ws = _apply_updates(t.workspace, "workspace_id", updates,
                        {1: ("name", F.col("value")), 2: ("visibility", F.col("value"))})
    return JobResult(decisions, {"workspace": _typed(ws, "workspace")})


def add_members(t: Tables, req: DataFrame) -> JobResult:
    """Workspace and user must exist; an existing (or earlier in the batch) membership is rejected; role MEMBER."""
    d = flag_exists(req, t.workspace, "workspace_id", "ws_ok", unique=True)
    d = flag_exists(d, t.llm_user, "user_id", "user_ok", unique=True)
    d = flag_exists(d, t.workspace_member, ["workspace_id", "user_id"], "member", unique=True)
    d = mark_first(d, ["workspace_id", "user_id"], ORDER, "is_first")
    d = with_reason(d, [("no_workspace", F.col("ws_ok")), ("no_user", F.col("user_ok")),
                        ("already_member", ~F.col("member") & F.col("is_first"))])
    decisions = d.select("req_id", "workspace_id", "user_id", "status", "reason")
    rows = d.where(_acc()).select("workspace_id", "user_id", F.lit("MEMBER").alias("role"), F.col("req_ts").alias("joined_at"))
    return JobResult(decisions, {"workspace_member": t.workspace_member.unionByName(_typed(rows, "workspace_member"))})


# --- personas -------------------------------------------------------------------------------------------------
def create_personas(t: Tables, req: DataFrame) -> JobResult:
    """Owner must exist; name and instructions not blank; (owner, name) unique, earlier requests included."""
    d = _trimmed(req, "name", "instructions")
    d = flag_exists(d, t.llm_user, {"owner_user_id": "user_id"}, "owner_ok", unique=True)
    d = flag_exists(d, t.persona, ["owner_user_id", "name"], "taken")
    filled, fits = _filled("name", "instructions"), _fits("persona", "name")
    d = mark_first(d.withColumn("__pre", F.col("owner_ok") & filled & fits), ["__pre", "owner_user_id", "name"], ORDER,
                   "is_first")
    d = with_reason(d, [("no_user", F.col("owner_ok")), ("null", filled), ("too_long", fits),
                        ("duplicate_name", ~F.col("taken") & F.col("is_first"))])
    d = _with_new_ids(d, max_id(t.persona, "persona_id"), "persona_id")
    rows = d.where(_acc()).select("persona_id", "owner_user_id", "name", "instructions", F.col("req_ts").alias("created_at"))
    decisions = d.select("req_id", "owner_user_id", "name", "status", "reason", "persona_id")
    return JobResult(decisions, {"persona": t.persona.unionByName(_typed(rows, "persona"))})


def update_personas(t: Tables, req: DataFrame) -> JobResult:
    """Persona must exist; field 1 renames (the owner's names stay unique), any other code replaces the
    instructions. Conversation snapshots are not touched."""
    p = t.persona.select("persona_id", "owner_user_id")
    d = req.withColumn("field", F.when(F.col("field") == 1, 1).otherwise(2)) \
           .withColumn("value", cf.blank_to_null(F.col("value"))).join(p, "persona_id", "left")
    fits = _value_fits("persona", {1: "name"})
    asks = (F.col("field") == 1) & F.col("owner_user_id").isNotNull() & F.col("value").isNotNull() & fits

    def named(name: str) -> Column:
        return F.concat(F.col("owner_user_id").cast("string"), F.lit(":"), F.col(name))
    d = _with_grants(d, asks, "persona_id", named("value"),
                     t.persona.select(F.col("persona_id").alias("owner"), named("name").alias("value")))
    d = with_reason(d, [("no_persona", F.col("owner_user_id").isNotNull()), ("null", F.col("value").isNotNull()),
                        ("too_long", fits), ("duplicate_name", F.col("granted"))])
    decisions = d.select("req_id", "persona_id", "field", "status", "reason")
    updates = d.where(_acc()).select("persona_id", "field", "value", "req_ts", "req_id")
    personas = _apply_updates(t.persona, "persona_id", updates,
                              {1: ("name", F.col("value")), 2: ("instructions", F.col("value"))})
    return JobResult(decisions, {"persona": _typed(personas, "persona")})


def delete_personas(t: Tables, req: DataFrame) -> JobResult:
    """Persona must exist; rejected with more than 5 ACTIVE conversations, then without 'YES'. Conversations keep
    their snapshots and lose the persona id (set null)."""
    active = (t.conversation.where((F.col("status") == "ACTIVE") & F.col("persona_id").isNotNull())
              .groupBy("persona_id").agg(F.count(F.lit(1)).alias("active_count")))
    d = flag_exists(req, t.persona, "persona_id", "found", unique=True)
    d = d.join(active, "persona_id", "left").withColumn("active_count", F.coalesce("active_count", F.lit(0)).cast("long"))
    d = with_reason(d, [("no_persona", F.col("found")), ("active_conversations", F.col("active_count") <= 5),
                        ("not_confirmed", F.col("confirm") == "YES")])
    d = mark_first(d.withColumn("__ok", _acc()), ["__ok", "persona_id"], ORDER, "is_first")
    d = (d.withColumn("reason", F.when(_acc() & ~F.col("is_first"), F.lit("no_persona")).otherwise(F.col("reason")))
          .withColumn("status", F.when(F.col("reason").isNull(), F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))))
    decisions = d.select("req_id", "persona_id", "status", "reason", "active_count")
    return JobResult(decisions, build=lambda: cascade_delete(t, {"persona": decisions.where(_acc()).select("persona_id")}))


# --- prompt templates -----------------------------------------------------------------------------------------
def add_templates(t: Tables, req: DataFrame) -> JobResult:
    """Owner must exist; name, text and category not blank; code 2 = SHARED else PRIVATE."""
    d = flag_exists(_trimmed(req, "name", "text", "category"), t.llm_user, {"owner_user_id": "user_id"}, "owner_ok",
                    unique=True)
    d = d.withColumn("visibility", cf.visibility_from_code(F.col("visibility_code")))
    d = with_reason(d, [("no_user", F.col("owner_ok")), ("null", _filled("name", "text", "category")),
                        ("too_long", _fits("prompt_template", "name", "category"))])
    d = _with_new_ids(d, max_id(t.prompt_template, "template_id"), "template_id")
    rows = d.where(_acc()).select("template_id", "owner_user_id", "name", "text", "category", "visibility",
                               F.col("req_ts").alias("created_at"))
    decisions = d.select("req_id", "owner_user_id", "status", "reason", "template_id",
                         _when_acc(F.col("visibility")).alias("visibility"))
    return JobResult(decisions, {"prompt_template": t.prompt_template.unionByName(_typed(rows, "prompt_template"))})


def update_templates(t: Tables, req: DataFrame) -> JobResult:
    """Template must exist; field 1 name, 2 text, 3 category, 4 visibility (value code 2 = SHARED); any other code
    is rejected. Turning a SHARED template PRIVATE leaves its shares in place (the audit reports them)."""
    d = flag_exists(req, t.prompt_template, "template_id", "found", unique=True)
    d = d.withColumn("value", F.when(F.col("field") == 4, cf.visibility_from_code(cf.opt_long(F.col("value"))))
                     .otherwise(cf.blank_to_null(F.col("value"))))
    d = with_reason(d, [("no_template", F.col("found")), ("invalid_field", F.col("field").between(1, 4)),
                        ("null", F.col("value").isNotNull()),
                        ("too_long", _value_fits("prompt_template", {1: "name", 3: "category"}))])
    decisions = d.select("req_id", "template_id", "field", "status", "reason")
    updates = d.where(_acc()).select("template_id", "field", "value", "req_ts", "req_id")
    tmpl = _apply_updates(t.prompt_template, "template_id", updates,
                          {1: ("name", F.col("value")), 2: ("text", F.col("value")),
                           3: ("category", F.col("value")), 4: ("visibility", F.col("value"))})
    return JobResult(decisions, {"prompt_template": _typed(tmpl, "prompt_template")})


def share_templates(t: Tables, req: DataFrame) -> JobResult:
    """Template and workspace must exist; a pair already shared is rejected, then a PRIVATE template is rejected."""
    tmpl = t.prompt_template.select("template_id", "visibility")
    d = req.join(tmpl, "template_id", "left")
    d = flag_exists(d, t.workspace, "workspace_id", "ws_ok", unique=True)
    d = flag_exists(d, t.workspace_prompt_template, ["workspace_id", "template_id"], "shared", unique=True)
    valid = F.col("visibility").isNotNull() & F.col("ws_ok") & (F.col("visibility") != "PRIVATE")
    d = mark_first(d.withColumn("__pre", valid), ["__pre", "workspace_id", "template_id"], ORDER, "is_first")
    d = with_reason(d, [("no_template", F.col("visibility").isNotNull()), ("no_workspace", F.col("ws_ok")),
                        ("already_shared", ~F.col("shared") & (~F.col("__pre") | F.col("is_first"))),
                        ("private", F.col("visibility") != "PRIVATE")])
    decisions = d.select("req_id", "template_id", "workspace_id", "status", "reason")
    rows = d.where(_acc()).select("workspace_id", "template_id", F.col("req_ts").alias("shared_at"))
    return JobResult(decisions, {"workspace_prompt_template": t.workspace_prompt_template
                                 .unionByName(_typed(rows, "workspace_prompt_template"))})


# --- support tickets ------------------------------------------------------------------------------------------
def create_tickets(t: Tables, req: DataFrame) -> JobResult:
    """User must exist; topic codes 1-5 pick a topic, anything else is Other; status Open, no agent."""
    d = flag_exists(req, t.llm_user, "user_id", "user_ok", unique=True)
    d = d.withColumn("topic_name", cf.topic_from_code(F.col("topic_code")))
    d = with_reason(d, [("no_user", F.col("user_ok"))])
    d = _with_new_ids(d, max_id(t.support_ticket, "ticket_id"), "ticket_id")
    rows = d.where(_acc()).select("ticket_id", "user_id", F.lit(None).cast("long").alias("agent_id"), "topic_name",
                               F.col("req_ts").alias("opened_time"), F.lit(None).cast("timestamp_ntz").alias("closed_time"),
                               F.lit("Open").alias("status"))
    decisions = d.select("req_id", "user_id", "status", "reason", "ticket_id", _when_acc(F.col("topic_name")).alias("topic_name"))
    return JobResult(decisions, {"support_ticket": t.support_ticket.unionByName(_typed(rows, "support_ticket"))})


def assign_tickets(t: Tables, req: DataFrame) -> JobResult:
    """Ticket and agent must exist; a closed ticket is rejected (reopening would break the closed-ticket rule);
    the agent is set and the status becomes In Progress; the last assignment wins."""
    st = t.support_ticket.select("ticket_id", "closed_time", F.lit(True).alias("found"))
    d = req.join(st, "ticket_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    d = flag_exists(d, t.support_agent, "agent_id", "agent_ok", unique=True)
    d = with_reason(d, [("no_ticket", F.col("found")), ("no_agent", F.col("agent_ok")),
                        ("closed", F.col("closed_time").isNull())])
    decisions = d.select("req_id", "ticket_id", "agent_id", "status", "reason")
    last = last_per_key(d.where(_acc()).select("ticket_id", "agent_id", "req_ts", "req_id"), ["ticket_id"], ORDER)
    out = (t.support_ticket.join(last.select("ticket_id", F.col("agent_id").alias("__a")), "ticket_id", "left")
           .withColumn("agent_id", F.coalesce("__a", "agent_id"))
           .withColumn("status", F.when(F.col("__a").isNotNull(), F.lit("In Progress")).otherwise(F.col("status")))
           .drop("__a"))
    return JobResult(decisions, {"support_ticket": _typed(out, "support_ticket")})


def resolve_tickets(t: Tables, req: DataFrame) -> JobResult:
    """Ticket must exist; code 1 = Resolved else Escalated; closed_time := request time, also when already closed."""
    d = flag_exists(req, t.support_ticket, "ticket_id", "found", unique=True)
    d = d.withColumn("final_status", cf.final_ticket_status(F.col("status_code")))
    d = with_reason(d, [("no_ticket", F.col("found"))])
    decisions = d.select("req_id", "ticket_id", "status", "reason", _when_acc(F.col("final_status")).alias("final_status"))
    last = last_per_key(d.where(_acc()).select("ticket_id", "final_status", "req_ts", "req_id"), ["ticket_id"], ORDER)
    out = (t.support_ticket.join(last.select("ticket_id", F.col("final_status").alias("__s"), F.col("req_ts").alias("__t")),
                                 "ticket_id", "left")
           .withColumn("status", F.coalesce("__s", "status"))
           .withColumn("closed_time", F.coalesce("__t", "closed_time"))
           .drop("__s", "__t"))
    return JobResult(decisions, {"support_ticket": _typed(out, "support_ticket")})
