"""DuckDB SQL for the table versions that the rule jobs write: the whole new table, every column."""

from __future__ import annotations

from convops.oracle import with_binding
from convops.plans.oracle_rules import BODY, EXTRA, REQ

_OK = "d.status = 'accepted'"
#: For the updates: the last accepted request per key and field wins.
_LAST = "qualify row_number() over (partition by {0} order by r.req_ts desc, r.req_id desc) = 1"


def _inserted(table: str, columns: str, base: str | None = None) -> str:
    """All rows of the table (``base``) and one per accepted request; ``d`` is its decision, ``r`` the request."""
    return f"select * from {base or table} union all by name select {columns} from decided d join req r using (req_id) where {_OK}"


def _edited(table: str, key: str, fields: dict[int, tuple[str, str]], value: str = "trim(r.value)",
            field: str = "r.field") -> str:
    last = (f"select r.{key} k, {field} f, {value} v from decided d join req r using (req_id) where {_OK} "
            + _LAST.format(f"r.{key}, {field}"))
    new = ", ".join(f"coalesce((select {expr} from last l where l.k = t.{key} and l.f = {code}), t.{col}) as {col}"
                    for code, (col, expr) in fields.items())
    return f"with last as ({last}) select t.* replace ({new}) from {table} t"


_VERSIONS: dict[tuple[str, str], str] = {
    ("generate_invoices", "invoice"): _inserted(
        "invoice", "d.invoice_id, d.user_id, d.tier_id, r.req_ts as invoice_date, cast(d.amount as decimal(10,2)) as amount, d.payment_status"),
    ("mark_paid", "invoice"): f"""select i.* replace (if(exists (select 1 from decided d where d.invoice_id = i.invoice_id
        and {_OK}), 'Paid', payment_status) as payment_status) from invoice i""",
    ("start_conversations", "conversation"): _inserted(
        "conversation", "d.conversation_id, d.user_id, d.workspace_id, d.persona_id, trim(r.title) as title, r.req_ts as start_time, "
        "'ACTIVE' as status, d.persona_name_snapshot, (select instructions from persona p where p.persona_id = d.persona_id)"
        " as persona_instr_snapshot"),
    ("admit_messages", "message"): _inserted(
        "message", "d.message_id, d.conversation_id, d.sender_role, r.req_ts as time_sent, trim(r.content) as content", "prior"),
    ("add_bookmarks", "message_bookmark"): _inserted(
        "message_bookmark", "d.user_id, d.message_id, r.req_ts as bookmarked_time"),
    ("upsert_feedback", "message_feedback"): f"""
        with last as (select d.feedback_id, d.message_id, d.rating, d.comment_text, r.req_ts as submitted_at
                      from decided d join req r using (req_id) where {_OK} {_LAST.format("d.message_id")})
        select * from message_feedback f where f.message_id not in (select message_id from last)
        union all by name select * from last""",
    ("archive_conversations", "conversation"): f"""select c.* replace (if(c.conversation_id in (select d.conversation_id
        from decided d where {_OK}), 'ARCHIVED', status) as status) from conversation c""",
    ("move_conversations", "conversation"): f"""
        with last as (select d.conversation_id, d.workspace_id from decided d join req r using (req_id)
                      where {_OK} {_LAST.format("d.conversation_id")})
        select c.* replace (coalesce(l.workspace_id, c.workspace_id) as workspace_id)
        from conversation c left join last l on l.conversation_id = c.conversation_id""",
    ("add_users", "llm_user"): _inserted(
        "llm_user", "d.user_id, d.tier_id, trim(r.name) as name, d.email, r.req_ts as creation_date, trim(r.language) as language"),
    ("add_users", "billing_record"): _inserted(
        "billing_record", "d.user_id, trim(r.payment_method) as payment_method, trim(r.billing_address) as billing_address")
    + " and trim(r.payment_method) <> '' and trim(r.billing_address) <> '' and length(trim(r.payment_method)) <= 50"
      " and length(trim(r.billing_address)) <= 300",
    ("update_users", "llm_user"): _edited("llm_user", "user_id", {
        1: ("tier_id", "cast(v as bigint)"), 2: ("name", "v"), 3: ("email", "v"), 4: ("language", "v")}),
    ("create_workspaces", "workspace"): _inserted(
        "workspace", "d.workspace_id, d.owner_id, trim(r.name) as name, d.visibility, r.req_ts as created_at"),
    ("create_workspaces", "workspace_member"): _inserted(
        "workspace_member", "d.workspace_id, d.owner_id as user_id, 'OWNER' as role, r.req_ts as joined_at"),
    ("modify_workspaces", "workspace"): _edited(
        "workspace", "workspace_id", {1: ("name", "v"), 2: ("visibility", "v")},
        "if(r.field = 1, trim(r.name), if(r.visibility_code = 2, 'SHARED', 'PRIVATE'))", "if(r.field = 1, 1, 2)"),
    ("add_members", "workspace_member"): _inserted(
        "workspace_member", "d.workspace_id, d.user_id, 'MEMBER' as role, r.req_ts as joined_at"),
    ("create_personas", "persona"): _inserted(
        "persona", "d.persona_id, d.owner_user_id, d.name, trim(r.instructions) as instructions, r.req_ts as created_at"),
    ("update_personas", "persona"): _edited(
        "persona", "persona_id", {1: ("name", "v"), 2: ("instructions", "v")}, field="if(r.field = 1, 1, 2)"),
    ("delete_personas", "persona"): f"""select * from persona p
        where not exists (select 1 from decided d where d.persona_id = p.persona_id and {_OK})""",
    ("delete_personas", "conversation"): f"""select c.* replace (if(c.persona_id in (select d.persona_id from decided d where {_OK}),
        null, c.persona_id) as persona_id) from conversation c""",
    ("add_templates", "prompt_template"): _inserted(
        "prompt_template", "d.template_id, d.owner_user_id, trim(r.name) as name, trim(r.text) as text, "
        "trim(r.category) as category, d.visibility, r.req_ts as created_at"),
    ("update_templates", "prompt_template"): _edited(
        "prompt_template", "template_id", {1: ("name", "v"), 2: ("text", "v"), 3: ("category", "v"),
                                           4: ("visibility", "if(v = '2', 'SHARED', 'PRIVATE')")}),
    ("share_templates", "workspace_prompt_template"): _inserted(
        "workspace_prompt_template", "d.workspace_id, d.template_id, r.req_ts as shared_at"),
    ("create_tickets", "support_ticket"): _inserted(
        "support_ticket", "d.ticket_id, d.user_id, cast(null as bigint) as agent_id, d.topic_name, r.req_ts as opened_time, "
        "cast(null as timestamp) as closed_time, 'Open' as status"),
    ("assign_tickets", "support_ticket"): f"""
        with last as (select d.ticket_id, d.agent_id from decided d join req r using (req_id)
                      where {_OK} {_LAST.format("d.ticket_id")})
        select s.* replace (coalesce(l.agent_id, s.agent_id) as agent_id,
                            if(l.ticket_id is null, s.status, 'In Progress') as status)
        from support_ticket s left join last l on l.ticket_id = s.ticket_id""",
    ("resolve_tickets", "support_ticket"): f"""
        with last as (select d.ticket_id, d.final_status, r.req_ts from decided d join req r using (req_id)
                      where {_OK} {_LAST.format("d.ticket_id")})
        select s.* replace (coalesce(l.req_ts, s.closed_time) as closed_time, coalesce(l.final_status, s.status) as status)
        from support_ticket s left join last l on l.ticket_id = s.ticket_id""",
}

# What is left when the accepted users are gone: du users, dw workspaces, dc conversations, dm messages, dt templates.
_LEFT: dict[str, str] = {
    "llm_user": "select * from llm_user where user_id not in (from du)",
    "billing_record": "select * from billing_record where user_id not in (from du)",
    "invoice": "select * from invoice where user_id not in (from du)",
    "workspace": "select * from workspace where workspace_id not in (from dw)",
    "workspace_member": "select * from workspace_member where user_id not in (from du) and workspace_id not in (from dw)",
    "persona": "select * from persona where owner_user_id not in (from du)",
    "conversation": """select c.* replace (if(workspace_id in (from dw), null, workspace_id) as workspace_id,
        if(persona_id in (select persona_id from persona where owner_user_id in (from du)), null, persona_id) as persona_id)
        from conversation c where conversation_id not in (from dc)""",
    "message": "select * from message where message_id not in (from dm)",
    "message_feedback": "select * from message_feedback where message_id not in (from dm)",
    "message_bookmark": "select * from message_bookmark where user_id not in (from du) and message_id not in (from dm)",
    "prompt_template": "select * from prompt_template where template_id not in (from dt)",
    "workspace_prompt_template": """select * from workspace_prompt_template
        where workspace_id not in (from dw) and template_id not in (from dt)""",
}

VERSION_KEYS = [*_VERSIONS, *(("delete_users", table) for table in _LEFT)]


def versions_sql(deleted: list[tuple[str, str]]) -> dict[str, str]:
    out = {f"{job}__{table}": with_binding(f"select * from ({sql}) version", [("req", REQ[job])] + EXTRA.get(job, [])
                                           + [("decided", BODY[job])])
           for (job, table), sql in _VERSIONS.items()}
    out |= {f"delete_users__{table}": with_binding(sql, deleted) for table, sql in _LEFT.items()}
    return out
