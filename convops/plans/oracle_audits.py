"""DuckDB SQL for the audits. The rules are stated here again, as text of their own, and checked by other
formulations than on the Spark side (NOT EXISTS instead of anti joins, COUNT(DISTINCT) for FDs, one branch per
column)."""

from __future__ import annotations

import re

from convops.oracle import with_binding
from convops.plans.oracle_rules import COLUMNS

# --- fixed values: keys, NOT NULL columns, value sets, lengths, references and dependencies of the platform tables
KEYS = {"tier": "tier_id", "support_agent": "agent_id", "llm_user": "user_id", "billing_record": "user_id",
        "invoice": "invoice_id", "workspace": "workspace_id", "workspace_member": "workspace_id user_id",
        "persona": "persona_id", "conversation": "conversation_id", "message": "message_id",
        "message_feedback": "feedback_id", "message_bookmark": "user_id message_id", "prompt_template": "template_id",
        "workspace_prompt_template": "workspace_id template_id", "support_ticket": "ticket_id"}
UNIQUE = [("tier", "tier_name"), ("support_agent", "email"), ("llm_user", "email"), ("persona", "owner_user_id name"),
          ("message_feedback", "message_id")]
NULLABLE = {"conversation": "workspace_id persona_id persona_name_snapshot persona_instr_snapshot",
            "message_feedback": "comment_text", "support_ticket": "agent_id closed_time"}
TEXTS = {"tier": "tier_name pro_access", "support_agent": "name email specialty", "llm_user": "name email language",
         "billing_record": "payment_method billing_address", "invoice": "payment_status", "workspace": "name visibility",
         "workspace_member": "role", "persona": "name instructions", "conversation": "title status",
         "message": "sender_role content", "message_feedback": "rating", "prompt_template": "name text category visibility",
         "support_ticket": "topic_name status"}
VALUES = [("tier", "pro_access", "Y|N"), ("invoice", "payment_status", "Paid|Unpaid|Overdue"),
          ("workspace", "visibility", "PRIVATE|SHARED"), ("workspace_member", "role", "OWNER|MEMBER"),
          ("conversation", "status", "ACTIVE|ARCHIVED"), ("message", "sender_role", "USER|AI"),
          ("message_feedback", "rating", "Thumbs Up|Thumbs Down"), ("prompt_template", "visibility", "PRIVATE|SHARED"),
          ("support_ticket", "topic_name", "Billing|Model Error|Account|Feature Request|Other"),
          ("support_ticket", "status", "Open|In Progress|Resolved|Escalated")]
LIMITS = [("tier", "tier_name 50 pro_access 1"), ("support_agent", "name 100 email 150 specialty 100"),
          ("llm_user", "name 100 email 150 language 50"), ("billing_record", "payment_method 50 billing_address 300"),
          ("invoice", "payment_status 20"), ("workspace", "name 150 visibility 20"), ("workspace_member", "role 20"),
          ("persona", "name 150"), ("conversation", "title 300 status 20 persona_name_snapshot 150"),
          ("message", "sender_role 10"), ("message_feedback", "rating 20"),
          ("prompt_template", "name 150 category 100 visibility 20"), ("support_ticket", "topic_name 50 status 20")]
REFERENCES = [("llm_user", "tier_id", "tier", "tier_id"), ("billing_record", "user_id", "llm_user", "user_id"),
              ("invoice", "user_id", "llm_user", "user_id"), ("invoice", "tier_id", "tier", "tier_id"),
              ("workspace", "owner_id", "llm_user", "user_id"),
              ("workspace_member", "workspace_id", "workspace", "workspace_id"),
              ("workspace_member", "user_id", "llm_user", "user_id"), ("persona", "owner_user_id", "llm_user", "user_id"),
              ("conversation", "user_id", "llm_user", "user_id"), ("conversation", "workspace_id", "workspace", "workspace_id"),
              ("conversation", "persona_id", "persona", "persona_id"),
              ("message", "conversation_id", "conversation", "conversation_id"),
              ("message_feedback", "message_id", "message", "message_id"),
              ("message_bookmark", "user_id", "llm_user", "user_id"), ("message_bookmark", "message_id", "message", "message_id"),
              ("prompt_template", "owner_user_id", "llm_user", "user_id"),
              ("workspace_prompt_template", "workspace_id", "workspace", "workspace_id"),
              ("workspace_prompt_template", "template_id", "prompt_template", "template_id"),
              ("support_ticket", "user_id", "llm_user", "user_id"), ("support_ticket", "agent_id", "support_agent", "agent_id")]


def _key(cols, alias=None) -> str:
    pre = f"{alias}." if alias else ""
    return "concat_ws('|', " + ", ".join(f"cast({pre}{c} as varchar)" for c in cols) + ")"


def _sel(rule, table, key, detail) -> str:
    return f"select '{rule}' as rule, '{table}' as \"table\", {key} as key, {detail} as detail"


def _pk() -> str:
    parts = []
    for t, key in KEYS.items():
        pk = key.split()
        nulls = " or ".join(f"{c} is null" for c in pk)
        parts.append(_sel("primary_key", t, _key(pk),
                          f"case when {nulls} then 'null key' else 'duplicate x' || cast(count(*) as varchar) end")
                     + f" from {t} group by {', '.join(pk)} having count(*) > 1 or {nulls}")
    return "\nunion all\n".join(parts)


def _uk() -> str:
    parts = []
    for t, key in UNIQUE:
        cols = key.split()
        where = " and ".join(f"{c} is not null" for c in cols)
        parts.append(_sel("unique_key", t, _key(cols), f"'{','.join(cols)} duplicate x' || cast(count(*) as varchar)")
                     + f" from {t} where {where} group by {', '.join(cols)} having count(*) > 1")
    return "\nunion all\n".join(parts)


def _nn() -> str:
    parts = []
    for t, cols in COLUMNS.items():
        for c in cols:
            if c not in NULLABLE.get(t, "").split():
                cond = f"{c} is null" + (f" or trim({c}) = ''" if c in TEXTS.get(t, "").split() else "")
                parts.append(_sel("not_null", t, _key(KEYS[t].split()), f"'{c}'") + f" from {t} where {cond}")
    return "\nunion all\n".join(parts)


def _enum() -> str:
    parts = []
    for t, c, allowed in VALUES:
        parts.append(_sel("enum", t, _key(KEYS[t].split()), f"'{c}=' || {c}")
                     + f" from {'message_raw' if t == 'message' else t} where {c} not in (select unnest(string_split('{allowed}', '|')))")
    return "\nunion all\n".join(parts)


def _fk() -> str:
    return "\nunion all\n".join(
        _sel("foreign_key", t, _key(KEYS[t].split(), "c"), f"'{c} -> {parent}'")
        + f" from {t} c where c.{c} is not null and not exists (select 1 from {parent} p where p.{key} = c.{c})"
        for t, c, parent, key in REFERENCES)


def _len() -> str:
    parts = []
    for t, limits in LIMITS:
        words = limits.split()
        for c, n in zip(words[::2], words[1::2]):
            parts.append(_sel("length", t, _key(KEYS[t].split()), f"'{c} length ' || cast(length({c}) as varchar) || ' > {n}'")
                         + f" from {t} where length({c}) > {n}")
    return "\nunion all\n".join(parts)


def _fd() -> str:
    """A primary or unique key determines all other columns of its table."""
    parts = []
    for t, key in [*((t, k) for t, k in KEYS.items()), *UNIQUE]:
        lhs = key.split()
        rhs = [c for c in COLUMNS[t] if c not in lhs]
        parts.append(_sel("fd", t, _key(lhs), f"'{','.join(lhs)} -> {','.join(rhs)}'")
                     + f" from {t} group by {', '.join(lhs)} having count(distinct row({', '.join(rhs)})) > 1")
    return "\nunion all\n".join(parts)


AUDITS_SQL: dict[str, str] = {
    "audit_primary_keys": _pk(),
    "audit_unique_keys": _uk(),
    "audit_not_null": _nn(),
    "audit_enums": _enum(),
    "audit_ticket_closed": _sel("ticket_closed", "support_ticket", "cast(ticket_id as varchar)",
                                "status || case when closed_time is null then ' without closed_time' "
                                "else ' with closed_time' end")
    + " from support_ticket where (status in ('Resolved','Escalated') and closed_time is null)"
      " or (status not in ('Resolved','Escalated') and closed_time is not null)",
    "audit_foreign_keys": _fk(),
    "audit_lengths": _len(),
    "audit_feedback_role": _sel("feedback_role", "message_feedback", "cast(f.feedback_id as varchar)",
                                "'feedback on ' || m.sender_role || ' message'")
    + " from message_feedback f join message m on m.message_id = f.message_id where m.sender_role <> 'AI'",
    "audit_private_shared": _sel("private_shared", "workspace_prompt_template", _key(["workspace_id", "template_id"], "w"),
                                 "'PRIVATE template shared'")
    + " from workspace_prompt_template w join prompt_template p on p.template_id = w.template_id"
      " where p.visibility = 'PRIVATE'",
    "audit_billing_total": _sel("billing_total", "llm_user", "cast(u.user_id as varchar)",
                                "'billing records: ' || cast(count(b.user_id) as varchar)")
    + " from llm_user u left join billing_record b on b.user_id = u.user_id group by u.user_id"
      " having count(b.user_id) <> 1",
    "audit_workspace_owner": _sel("workspace_owner", "workspace", "cast(w.workspace_id as varchar)",
                                  "'owner has no OWNER membership'")
    + " from workspace w where not exists (select 1 from workspace_member m where m.workspace_id = w.workspace_id"
      " and m.user_id = w.owner_id and m.role = 'OWNER')",
    "audit_workspace_access": _sel("workspace_access", "conversation", "cast(c.conversation_id as varchar)",
                                   "'owner not member of workspace ' || cast(c.workspace_id as varchar)")
    + " from conversation c where c.workspace_id is not null and not exists (select 1 from workspace_member m"
      " where m.workspace_id = c.workspace_id and m.user_id = c.user_id)",
    "audit_rate_limit": _sel("rate_limit", "message", "concat_ws('|', cast(d.user_id as varchar), cast(d.day as varchar))",
                             "cast(d.n as varchar) || ' > ' || cast(t.message_limit as varchar)")
    + " from (select c.user_id, cast(m.time_sent as date) as day, count(*) as n from message m"
      " join conversation c on c.conversation_id = m.conversation_id where m.sender_role = 'USER'"
      " group by c.user_id, cast(m.time_sent as date)) d"
      " join llm_user u on u.user_id = d.user_id join tier t on t.tier_id = u.tier_id where d.n > t.message_limit",
    "audit_fds": _fd(),
    "persona_snapshot_drift": _sel("snapshot_drift", "conversation", "cast(persona_id as varchar)",
                                   "'snapshots: ' || cast(count(distinct persona_name_snapshot) as varchar)")
    + " from conversation where persona_id is not null and persona_name_snapshot is not null"
      " group by persona_id having count(distinct persona_name_snapshot) > 1",
}


# The audited tables with some rows damaged, or added, in every way that the bound tables never are.
DAMAGED: dict[str, str] = {
    "llm_user": """select * from {0} union all by name select * replace (name || ' II' as name) from {0} where user_id % 50 = 7
        union all by name select * replace (-1 - user_id as user_id, repeat('n', 101) as name, ' ' as language)
        from {0} where user_id % 60 = 9""",
    "workspace": """select * from {0} union all by name
        select * replace (-1 - workspace_id as workspace_id, repeat('w', 151) as name) from {0}""",
    "persona": "select * from {0} union all by name select * replace (persona_id + 1000 as persona_id) from {0} where persona_id % 6 = 1",
    "support_ticket": """select * from {0} union all by name
        select * replace (-1 - ticket_id as ticket_id, if(closed_time is null, opened_time, null) as closed_time)
        from {0} where ticket_id % 9 = 4""",
    "message_feedback": """select * from {0} union all by name
        select -1 - message_id as feedback_id, message_id, 'Thumbs Up' as rating, null as comment_text, time_sent as submitted_at
        from message where sender_role = 'USER' and message_id % 3 = 1""",
    "invoice": "select * from {0} union all by name select * replace (null as amount) from {0} where invoice_id % 500 = 3",
}


def _damaged(body: str) -> str:
    """``body`` over the damaged tables, which carry names of their own."""
    ctes = [(f"whole_{t}", f"select * from {t}") for t in DAMAGED]
    ctes += [(f"bad_{t}", sql.format(f"whole_{t}")) for t, sql in DAMAGED.items()]
    for t in DAMAGED:
        body = re.sub(rf"(from|join) {t}\b", rf"\1 bad_{t}", body)
    return with_binding(body, ctes)


def audits_sql() -> dict[str, str]:
    out = {k: with_binding(v) for k, v in AUDITS_SQL.items()}
    out["audit_all"] = with_binding("\nunion all\n".join(f"select * from ({v})" for v in AUDITS_SQL.values()))
    out |= {f"{k}__damaged": _damaged(AUDITS_SQL[k]) for k in DAMAGED_AUDITS}
    return out


DAMAGED_AUDITS = ["audit_primary_keys", "audit_unique_keys", "audit_not_null", "audit_ticket_closed", "audit_lengths",
                  "audit_feedback_role", "audit_workspace_owner", "audit_fds", "audit_foreign_keys"]
