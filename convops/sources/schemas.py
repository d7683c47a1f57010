"""The fifteen platform tables: explicit Spark types plus key, enum, length and foreign-key metadata.

One source of truth: typed scans, the integrity audits and the delete cascade are all driven from here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

L = T.LongType()
S = T.StringType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)


def _struct(*cols):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


# --- fixed values: column layout, nullability and types of the platform tables ---------------------------------
SCHEMAS: dict[str, T.StructType] = {
    "tier": _struct(("tier_id", L, False), ("tier_name", S, False), ("cost", MONEY, False),
                    ("message_limit", L, False), ("pro_access", S, False)),
    "support_agent": _struct(("agent_id", L, False), ("name", S, False), ("email", S, False),
                             ("specialty", S, False), ("hired_date", TS, False)),
    "llm_user": _struct(("user_id", L, False), ("tier_id", L, False), ("name", S, False), ("email", S, False),
                        ("creation_date", TS, False), ("language", S, False)),
    "billing_record": _struct(("user_id", L, False), ("payment_method", S, False), ("billing_address", S, False)),
    "invoice": _struct(("invoice_id", L, False), ("user_id", L, False), ("tier_id", L, False),
                       ("invoice_date", TS, False), ("amount", MONEY, False), ("payment_status", S, False)),
    "workspace": _struct(("workspace_id", L, False), ("owner_id", L, False), ("name", S, False),
                         ("visibility", S, False), ("created_at", TS, False)),
    "workspace_member": _struct(("workspace_id", L, False), ("user_id", L, False), ("role", S, False),
                                ("joined_at", TS, False)),
    "persona": _struct(("persona_id", L, False), ("owner_user_id", L, False), ("name", S, False),
                       ("instructions", S, False), ("created_at", TS, False)),
    "conversation": _struct(("conversation_id", L, False), ("user_id", L, False), ("workspace_id", L, True),
                            ("persona_id", L, True), ("title", S, False), ("start_time", TS, False),
                            ("status", S, False), ("persona_name_snapshot", S, True),
                            ("persona_instr_snapshot", S, True)),
    "message": _struct(("message_id", L, False), ("conversation_id", L, False), ("sender_role", S, False),
                       ("time_sent", TS, False), ("content", S, False)),
    "message_feedback": _struct(("feedback_id", L, False), ("message_id", L, False), ("rating", S, False),
                                ("comment_text", S, True), ("submitted_at", TS, False)),
    "message_bookmark": _struct(("user_id", L, False), ("message_id", L, False), ("bookmarked_time", TS, False)),
    "prompt_template": _struct(("template_id", L, False), ("owner_user_id", L, False), ("name", S, False),
                               ("text", S, False), ("category", S, False), ("visibility", S, False),
                               ("created_at", TS, False)),
    "workspace_prompt_template": _struct(("workspace_id", L, False), ("template_id", L, False),
                                         ("shared_at", TS, False)),
    "support_ticket": _struct(("ticket_id", L, False), ("user_id", L, False), ("agent_id", L, True),
                              ("topic_name", S, False), ("opened_time", TS, False), ("closed_time", TS, True),
                              ("status", S, False)),
}

TABLES = tuple(SCHEMAS)

# --- fixed values: primary and unique keys -------------------------------------------------------------------
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "tier": ("tier_id",),
    "support_agent": ("agent_id",),
    "llm_user": ("user_id",),
    "billing_record": ("user_id",),
    "invoice": ("invoice_id",),
    "workspace": ("workspace_id",),
    "workspace_member": ("workspace_id", "user_id"),
    "persona": ("persona_id",),
    "conversation": ("conversation_id",),
    "message": ("message_id",),
    "message_feedback": ("feedback_id",),
    "message_bookmark": ("user_id", "message_id"),
    "prompt_template": ("template_id",),
    "workspace_prompt_template": ("workspace_id", "template_id"),
    "support_ticket": ("ticket_id",),
}

UNIQUE_KEYS: list[tuple[str, tuple[str, ...]]] = [
    ("tier", ("tier_name",)),
    ("support_agent", ("email",)),
    ("llm_user", ("email",)),
    ("persona", ("owner_user_id", "name")),
    ("message_feedback", ("message_id",)),
]

# --- fixed values: allowed values of the CHECK-constrained columns ------------------------------------------
ENUMS: list[tuple[str, str, tuple[str, ...]]] = [
    ("tier", "pro_access", ("Y", "N")),
    ("invoice", "payment_status", ("Paid", "Unpaid", "Overdue")),
    ("workspace", "visibility", ("PRIVATE", "SHARED")),
    ("workspace_member", "role", ("OWNER", "MEMBER")),
    ("conversation", "status", ("ACTIVE", "ARCHIVED")),
    ("message", "sender_role", ("USER", "AI")),
    ("message_feedback", "rating", ("Thumbs Up", "Thumbs Down")),
    ("prompt_template", "visibility", ("PRIVATE", "SHARED")),
    ("support_ticket", "topic_name", ("Billing", "Model Error", "Account", "Feature Request", "Other")),
    ("support_ticket", "status", ("Open", "In Progress", "Resolved", "Escalated")),
]

CLOSED_TICKET_STATUSES = ("Resolved", "Escalated")
OPEN_TICKET_STATUSES = ("Open", "In Progress")

# --- fixed values: declared VARCHAR2 lengths (CHAR(1) for pro_access) -----------------------------------------
LENGTHS: list[tuple[str, str, int]] = [
    ("tier", "tier_name", 50), ("tier", "pro_access", 1),
    ("support_agent", "name", 100), ("support_agent", "email", 150), ("support_agent", "specialty", 100),
    ("llm_user", "name", 100), ("llm_user", "email", 150), ("llm_user", "language", 50),
    ("billing_record", "payment_method", 50), ("billing_record", "billing_address", 300),
    ("invoice", "payment_status", 20),
    ("workspace", "name", 150), ("workspace", "visibility", 20),
    ("workspace_member", "role", 20),
    ("persona", "name", 150),
    ("conversation", "title", 300), ("conversation", "status", 20), ("conversation", "persona_name_snapshot", 150),
    ("message", "sender_role", 10),
    ("message_feedback", "rating", 20),
    ("prompt_template", "name", 150), ("prompt_template", "category", 100), ("prompt_template", "visibility", 20),
    ("support_ticket", "topic_name", 50), ("support_ticket", "status", 20),
]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str  # 'cascade' | 'set null' | 'restrict'


# --- fixed values: foreign keys and their delete actions -----------------------------------------------------
FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("llm_user", ("tier_id",), "tier", ("tier_id",), "restrict"),
    ForeignKey("billing_record", ("user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("invoice", ("user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("invoice", ("tier_id",), "tier", ("tier_id",), "restrict"),
    ForeignKey("workspace", ("owner_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("workspace_member", ("workspace_id",), "workspace", ("workspace_id",), "cascade"),
    ForeignKey("workspace_member", ("user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("persona", ("owner_user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("conversation", ("user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("conversation", ("workspace_id",), "workspace", ("workspace_id",), "set null"),
    ForeignKey("conversation", ("persona_id",), "persona", ("persona_id",), "set null"),
    ForeignKey("message", ("conversation_id",), "conversation", ("conversation_id",), "cascade"),
    ForeignKey("message_feedback", ("message_id",), "message", ("message_id",), "cascade"),
    ForeignKey("message_bookmark", ("user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("message_bookmark", ("message_id",), "message", ("message_id",), "cascade"),
    ForeignKey("prompt_template", ("owner_user_id",), "llm_user", ("user_id",), "cascade"),
    ForeignKey("workspace_prompt_template", ("workspace_id",), "workspace", ("workspace_id",), "cascade"),
    ForeignKey("workspace_prompt_template", ("template_id",), "prompt_template", ("template_id",), "cascade"),
    ForeignKey("support_ticket", ("user_id",), "llm_user", ("user_id",), "restrict"),
    ForeignKey("support_ticket", ("agent_id",), "support_agent", ("agent_id",), "set null"),
]


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]


def text_columns(table: str) -> set[str]:
    return {f.name for f in SCHEMAS[table].fields if isinstance(f.dataType, T.StringType)}
