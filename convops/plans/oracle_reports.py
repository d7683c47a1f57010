"""DuckDB SQL for the reports, written from what each report means: facts are counted per conversation or user first,
then put next to the entities they belong to."""

from __future__ import annotations

from convops.oracle import with_binding

# Ratings of AI messages, per conversation.
_RATED = """(
        select conversation_id, count(*) as votes, count(*) filter (rating = 'Thumbs Up') as ups
        from message_feedback semi join (select message_id from message where sender_role = 'AI') ai using (message_id)
             join message using (message_id)
        group by conversation_id)"""

_SHARE = "round(ups * 100.0 / votes, 2)"

_HELPFUL = f"""
    select persona_id, persona.name as persona, {_SHARE} as thumbs_up_pct, votes as total_ratings
    from (select persona_id, cast(sum(votes) as bigint) as votes, cast(sum(ups) as bigint) as ups
          from {_RATED} rated join conversation using (conversation_id) group by persona_id) scored
    join persona using (persona_id)"""

# AI messages per conversation, and the conversations that have any.
_TALKS = """
    select user_id, conversation_id, title, start_time, {extra}spoken.n as ai_message_count
    from conversation join (select conversation_id, count(*) as n from message where sender_role = 'AI'
                            group by conversation_id) spoken using (conversation_id)
    where persona_id is {null}"""

_LAST_TALK = "(select user_id, max(start_time) as last_conversation, count(*) as talks from conversation group by user_id)"
_OPEN_SUM = "(select user_id, sum(amount) as owed from invoice where payment_status = 'Unpaid' group by user_id)"

REPORTS_SQL: dict[str, str] = {
    "bookmarks": """
        with texts as (select message_id, left(content, 60) as message_preview,
                              (select title from conversation c where c.conversation_id = m.conversation_id) as conversation
                       from message m)
        select b.user_id, b.message_id, texts.conversation, texts.message_preview,
               strftime(b.bookmarked_time, '%Y-%m-%d %H:%M') as bookmarked
        from message_bookmark b, texts where texts.message_id = b.message_id""",
    "unpaid_invoices": f"""
        select user_id, email, cast(owed as double) as total_owed, last_conversation
        from {_OPEN_SUM} due join llm_user using (user_id) left join {_LAST_TALK} talk using (user_id)""",
    # as written, every invoice is added once per conversation of its user (once without any)
    "unpaid_invoices_as_written": f"""
        select user_id, email, cast(owed * coalesce(talks, 1) as double) as total_owed, last_conversation
        from {_OPEN_SUM} due join llm_user using (user_id) left join {_LAST_TALK} talk using (user_id)""",
    "persona_helpfulness": _HELPFUL,
    "best_persona": f"""
        select * exclude (place) from (
            select h.*, row_number() over (order by thumbs_up_pct desc, total_ratings desc, persona_id) as place
            from ({_HELPFUL}) h) where place = 1""",
    "persona_conversations": _TALKS.format(extra="persona_name_snapshot, ", null="not null"),
    "nonpersona_conversations": _TALKS.format(extra="", null="null"),
    "top_personas_by_tier": f"""
        with heard as (
            select tier_id, persona_id, count(distinct user_id) as tier_user_count, cast(sum(votes) as bigint) as votes,
                   cast(sum(ups) as bigint) as ups
            from {_RATED} rated join conversation using (conversation_id) join (select user_id, tier_id from llm_user) u
                 using (user_id)
            where persona_id is not null group by tier_id, persona_id),
        shown as (select tier_name, persona_id, persona.name as persona_name, tier_user_count, {_SHARE} as thumbs_up_pct,
                         (select email from llm_user o where o.user_id = persona.owner_user_id) as owner_email
                  from heard join tier using (tier_id) join persona using (persona_id))
        select *, row_number() over best as rank from shown where owner_email is not null
        window best as (partition by tier_name order by thumbs_up_pct desc, tier_user_count desc, persona_id)
        qualify rank <= 3""",
    "list_users": """
        select user_id, name, email, (select tier_name from tier t where t.tier_id = u.tier_id) as tier_name, language
        from llm_user u where tier_id in (select tier_id from tier)""",
    "user_invoices": """
        select user_id, invoice_id, tier_name, strftime(invoice_date, '%Y-%m-%d') as invoice_day,
               cast(amount as double) as amount, payment_status
        from tier, invoice where invoice.tier_id = tier.tier_id""",
    "conversation_messages": """
        select conversation_id, message_id, sender_role, strftime(time_sent, '%Y-%m-%d %H:%M:%S') as sent,
               left(content, 80) as content_preview from message""",
    "user_personas": """
        select owner_user_id, persona_id, name, strftime(created_at, '%Y-%m-%d') as created,
               left(instructions, 60) as instructions_preview from persona""",
    "user_templates": """
        select owner_user_id, template_id, name, category, visibility, strftime(created_at, '%Y-%m-%d') as created
        from prompt_template""",
    "workspace_members": """
        select workspace_id, user_id, name, email, role, strftime(joined_at, '%Y-%m-%d') as joined
        from llm_user join workspace_member using (user_id)""",
    "open_tickets": """
        select ticket_id, email as user_email,
               (select name from support_agent a where a.agent_id = s.agent_id) as agent, topic_name,
               strftime(opened_time, '%Y-%m-%d %H:%M') as opened, status
        from support_ticket s join llm_user using (user_id) where status = 'Open' or status = 'In Progress'""",
    "list_tiers": "select tier_id, tier_name, cast(cost as double) as cost from tier",
    "list_agents": "select agent_id, name, specialty from support_agent",
    "ticket_resolution": """
        select ticket_id, status, (epoch_us(date_trunc('second', closed_time - opened_time + timestamp '2000-01-01'))
                                   - epoch_us(timestamp '2000-01-01')) / 3.6e9 as resolution_hours from support_ticket""",
    "id_exists": """
        select distinct message_id as id, message_id in (select message_id from message) as "exists" from message_bookmark""",
}


def reports_sql() -> dict[str, str]:
    return {k: with_binding(f"select * from ({v}) report") for k, v in REPORTS_SQL.items()}
