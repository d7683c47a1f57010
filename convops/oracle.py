"""Independent DuckDB SQL for every registered key (the correctness oracle).

The platform tables are defined here a second time, in DuckDB SQL over the raw views the driver registers, and each
oracle query is hand-written SQL — not generated from the Spark code — so the two sides are independent texts.
``with_binding(sql)`` prepends only the platform-table CTEs the query (transitively) references.
"""

from __future__ import annotations

import re

# Platform tables in DuckDB SQL (same binding as convops.sources.binding; FIXTURES.md §3).
BINDING: dict[str, str] = {
    "spans": """select (select max(c_custkey) + 1 from customer) users, (select max(r_regionkey) + 1 from region) regions,
        (select max(n_nationkey) + 1 from nation) nations, (select max(s_suppkey) + 1 from supplier) agents,
        (select max(turn) + 1 from conversations) turns,
        (select (max(conv_id) + 1) * (max(turn) + 1) from conversations) messages,
        (select greatest(1, (max(conv_id) + 1) // 4) from conversations) talkers""",
    "tier": """select cast(r_regionkey + 1 as bigint) tier_id,
        case r_regionkey when 0 then 'Free' when 1 then 'Plus' when 2 then 'Enterprise' else 'Regional ' || r_name end tier_name,
        cast(case r_regionkey when 0 then 0 when 1 then 20 when 2 then 100 else r_regionkey * 50 end as decimal(10,2)) cost,
        cast(case r_regionkey when 0 then 3 when 1 then 6 when 2 then 99999 else r_regionkey * 10 end as bigint) message_limit,
        if(r_regionkey = 0, 'N', 'Y') pro_access from region""",
    "llm_user": """select c_custkey user_id,
        cast(case when c_mktsegment in ('MACHINERY','HOUSEHOLD') then 1 when c_mktsegment='AUTOMOBILE' then 3 else 2 end as bigint) tier_id,
        c_name name, concat('user', cast(c_custkey as varchar), '@example.com') email,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(c_custkey % 40000 as bigint)) creation_date, n_name language
        from customer join nation on c_nationkey = n_nationkey""",
    "billing_record": """select c_custkey user_id,
        case c_custkey % 3 when 0 then 'Credit Card' when 1 then 'PayPal' else 'Invoice' end payment_method,
        concat('Address ', cast(c_custkey as varchar)) billing_address
        from customer where c_custkey % 50 <> 49""",
    "invoice": """select o_orderkey invoice_id, o_custkey user_id, cast(o_orderkey % 3 + 1 as bigint) tier_id,
        o_orderdate invoice_date, cast(o_totalprice as decimal(10,2)) amount,
        case o_orderstatus when 'F' then 'Paid' when 'O' then 'Unpaid' else 'Overdue' end payment_status
        from orders""",
    "persona": """select cast(n_nationkey as bigint) persona_id, cast(n_regionkey as bigint) owner_user_id, n_name name,
        concat('you are ', lower(n_name)) instructions,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(n_nationkey as bigint)) created_at from nation""",
    "conversation": """select c.conv_id conversation_id, c.user_id, c.workspace_id, c.persona_id, c.title, c.start_time, c.status,
        case when p.persona_id is null then null when c.conv_id % 7 = 0 then concat(p.name, ' v0') else p.name end persona_name_snapshot,
        p.instructions persona_instr_snapshot
        from (select conv_id, conv_id % talkers user_id,
                nullif(conv_id % (regions + 1), regions) workspace_id,
                case when conv_id % 4 <> 3 then (conv_id % nations) * (conv_id % nations) % nations end persona_id,
                concat('conversation ', cast(conv_id as varchar)) title,
                timestamp '2024-01-01 00:00:00' + to_minutes(cast(((conv_id % talkers) // 10 + (conv_id // talkers) // 2) * 1440 + conv_id % 600 as bigint)) start_time,
                case when conv_id % 3 = 0 then 'ARCHIVED' else 'ACTIVE' end status
              from (select distinct conv_id from conversations) d, spans) c
        left join persona p on c.persona_id = p.persona_id""",
    "message_raw": """select m.conv_id * s.turns + m.turn message_id, m.conv_id conversation_id,
        case m.role when 'user' then 'USER' when 'assistant' then 'AI' else upper(m.role) end sender_role,
        c.start_time + to_minutes(cast(m.turn as bigint)) time_sent, m.text content
        from spans s, conversations m join conversation c on m.conv_id = c.conversation_id""",
    "message": """select * from message_raw where sender_role in ('USER','AI')""",
    "message_feedback": """select doc_id feedback_id, m.message_id,
        case when quality = 1 then 'Thumbs Up' else 'Thumbs Down' end rating,
        case when toxic = 1 then 'flagged' end comment_text, m.time_sent + to_minutes(5) submitted_at
        from labels join message m on m.message_id = doc_id where m.sender_role = 'AI'""",
    "message_bookmark": """select user_id, event_id % messages message_id, min(ts) bookmarked_time
        from events, spans where event_type = 'click' group by all""",
    "workspace": """select cast(r_regionkey as bigint) workspace_id, cast(r_regionkey as bigint) owner_id, r_name name,
        case when r_regionkey % 2 = 0 then 'SHARED' else 'PRIVATE' end visibility,
        timestamp '2024-01-01 00:00:00' created_at from region""",
    "workspace_member": """select workspace_id, user_id, max(role) role,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(user_id % 1000 as bigint)) joined_at
        from (select cast(n_regionkey as bigint) workspace_id, c_custkey user_id, 'MEMBER' role
              from customer join nation on c_nationkey = n_nationkey
              union all select workspace_id, owner_id, 'OWNER' from workspace) x
        group by workspace_id, user_id""",
    "prompt_template": """select p_partkey template_id, p_partkey % users owner_user_id, p_name name, p_brand text, p_type category,
        case when p_size % 2 = 0 then 'SHARED' else 'PRIVATE' end visibility,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(p_partkey % 40000 as bigint)) created_at from part, spans""",
    "workspace_prompt_template": """select p_partkey % regions workspace_id, p_partkey template_id,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(p_partkey % 40000 as bigint)) shared_at
        from part, spans where p_partkey % 3 = 0""",
    "support_agent": """select s_suppkey agent_id, s_name name, concat('agent', cast(s_suppkey as varchar), '@support.example') email,
        case s_suppkey % 5 when 0 then 'Billing' when 1 then 'Model Error' when 2 then 'Account'
             when 3 then 'Feature Request' else 'Other' end specialty,
        timestamp '2024-01-01 00:00:00' + to_minutes(cast(s_suppkey as bigint)) hired_date from supplier""",
    "support_ticket": """select event_id ticket_id, user_id * 10 + event_id % 10 user_id,
        case when event_id % 4 <> 0 then event_id % agents end agent_id,
        case event_id % 5 when 0 then 'Billing' when 1 then 'Model Error' when 2 then 'Account'
             when 3 then 'Feature Request' else 'Other' end topic_name,
        ts opened_time,
        case when event_id % 4 >= 2 then ts + to_minutes(cast(floor(value * 10) as bigint)) end closed_time,
        case event_id % 4 when 0 then 'Open' when 1 then 'In Progress' when 2 then 'Resolved' else 'Escalated' end status
        from events, spans where event_type = 'error'""",
}

_ORDER = ["spans", "tier", "workspace", "persona", "llm_user", "billing_record", "invoice", "conversation", "message_raw",
          "message", "message_feedback", "message_bookmark", "workspace_member", "prompt_template",
          "workspace_prompt_template", "support_agent", "support_ticket"]


def _refs(sql: str) -> set[str]:
    return {name for name in BINDING if re.search(rf"\b{name}\b", sql)}


def with_binding(body: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the platform-table CTEs it needs (plus optional extra named CTEs, in order)."""
    extra_ctes = extra_ctes or []
    text = body + " ".join(sql for _, sql in extra_ctes)
    needed = _refs(text)
    while True:
        grown = needed | {r for n in needed for r in _refs(BINDING[n])}
        if grown == needed:
            break
        needed = grown
    ctes = [(n, BINDING[n]) for n in _ORDER if n in needed] + extra_ctes
    if not ctes:
        return body
    return "with " + ",\n".join(f"{n} as ({sql})" for n, sql in ctes) + "\n" + body
