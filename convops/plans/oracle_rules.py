"""DuckDB oracle SQL for the rule jobs' decision frames (hand-written; window functions where the Spark side uses
aggregates and bucketed ranks, so the two formulations are independent)."""

from __future__ import annotations

from convops.oracle import with_binding

B = "timestamp '2024-06-01 00:00:00'"


def _st(reason: str = "reason") -> str:
    return f"case when {reason} is null then 'accepted' else 'rejected' end"


def _new_id(base_sql: str) -> str:
    """base + rank among accepted rows in request order (NULL for rejected rows)."""
    return (f"case when reason is null then ({base_sql}) + row_number() over "
            f"(partition by reason is null order by req_ts, req_id) end")


REQ: dict[str, str] = {
    "generate_invoices": f"""select c_custkey req_id, {B} req_ts, if(c_custkey % 41 = 0, -c_custkey - 1, c_custkey) user_id
        from customer""",
    "mark_paid": """select o_orderkey req_id, o_orderdate req_ts,
        case when o_orderpriority = '2-HIGH' then -o_orderkey else o_orderkey end invoice_id from orders""",
    "start_conversations": """select event_id req_id, ts req_ts, if(event_id % 11 = 0, -user_id - 1, user_id) user_id,
        case when event_id % 13 = 0 then '  ' when event_id % 17 = 0 then repeat('long ', 61)
             else concat('  chat ', event_id, ' ') end title,
        if(event_id % 19 = 0, 'none', cast(event_id % (nations + 5) as varchar)) persona_id,
        if(event_id % (regions + 2) <= regions, concat('  ', event_id % (regions + 2), ' '), '-') workspace_id
        from events, spans where event_type = 'signup'""",
    "admit_messages": """select message_id req_id, time_sent req_ts,
        if(message_id % 29 = 0, -conversation_id - 1, conversation_id) conversation_id,
        case when sender_role = 'USER' then 1 else 2 end role_code,
        case when message_id % 23 = 0 then '   ' when message_id % 31 <> 0 then '  ' || content || ' ' end content
        from message where message_id % 5 <> 0""",
    "upsert_feedback": """select event_id req_id, ts req_ts, event_id % messages message_id,
        case when value > 20 then 1 else 2 end rating_code,
        if(event_id % 3 = 0, '  ', concat('  note ', event_id, ' ')) comment
        from events, spans where event_type = 'purchase'""",
    "add_bookmarks": """select event_id req_id, ts req_ts, if(event_id % 11 = 0, -user_id - 1, user_id) user_id,
        (event_id + event_id % 3) % messages message_id from events, spans where event_type = 'click'""",
    "archive_conversations": f"""select conv_id * turns + turn req_id, {B} + to_minutes(cast(turn as bigint)) req_ts,
        case when turn = 0 then conv_id else -(conv_id * turns + turn) - 1 end conversation_id
        from conversations, spans where turn = 0 or conv_id % 9 = 0""",
    "move_conversations": f"""select conv_id req_id, {B} req_ts, if(conv_id % 17 = 0, -conv_id - 1, conv_id) conversation_id,
        conv_id % (regions + 1) workspace_id from conversations, spans where turn = 0""",
    "add_users": f"""select s_suppkey req_id, {B} + to_minutes(cast(s_suppkey % 1000 as bigint)) req_ts,
        s_suppkey % 7 + 1 tier_id, '  ' || s_name || ' ' as name,
        '  ' || case when s_suppkey % 10 = 0 then concat('user', s_suppkey, '@example.com') when s_suppkey % 11 = 0 then ' '
             when s_suppkey % 13 = 0 then repeat('x', 150) || '@example.com'
             else concat('new', s_suppkey // 2, '@example.com') end || ' ' as email,
        'English ' as language, case s_suppkey % 3 when 0 then ' Credit Card' when 1 then 'PayPal ' else ' ' end payment_method,
        concat('  Supplier street ', s_suppkey, ' ') billing_address from supplier""",
    "update_users": """select event_id req_id, ts req_ts, if(event_id % 43 = 0, -user_id - 1, user_id) user_id,
        event_id % 5 + 1 field, '  ' || case when event_id % 37 = 0 then ' ' when event_id % 41 = 0 then repeat('y', 151)
             else case event_id % 5 + 1 when 1 then cast(event_id % 7 + 1 as varchar) when 2 then concat('name ', event_id)
             when 3 then if(event_id % 3 = 0, concat('moved', event_id % greatest(1, users // 2), '@example.com'),
                                              concat('user', event_id % users, '@example.com'))
             when 4 then concat('lang ', event_id % 7) else 'x' end end || ' ' as value
        from events, spans where event_type = 'view'""",
    "delete_users": f"""select c_custkey req_id, {B} req_ts, if(c_custkey % 53 = 0, -c_custkey - 1, c_custkey) user_id,
        case when c_custkey % 7 = 0 then 'NO' else 'YES' end confirm from customer""",
    "create_workspaces": f"""select c_custkey req_id, {B} + to_minutes(cast(c_custkey % 1000 as bigint)) req_ts,
        if(c_custkey % 43 = 0, -c_custkey - 1, c_custkey) owner_id,
        case when c_custkey % 47 = 0 then ' ' when c_custkey % 59 = 0 then repeat('w', 151)
             else '  ' || c_name || ' space ' end as name,
        case when c_acctbal > 0 then 2 else 1 end visibility_code from customer""",
    "modify_workspaces": """select event_id req_id, ts req_ts, event_id % (regions + 2) workspace_id,
        case when value > 25 then 1 else 2 end field, case when event_id % 13 = 0 then '' when event_id % 17 = 0
        then repeat('w', 151) else concat('  ws ', event_id, ' ') end as name,
        case when event_id % 2 = 0 then 2 else 1 end visibility_code from events, spans where event_type = 'signup'""",
    "add_members": """select event_id req_id, ts req_ts, event_id % (regions + 1) workspace_id,
        if(event_id % 19 = 0, -user_id - 1, user_id) user_id from events, spans where event_type = 'view'""",
    "create_personas": f"""select p_partkey req_id, {B} + to_minutes(cast(p_partkey % 1000 as bigint)) req_ts,
        if(p_partkey % 29 = 0, -p_partkey - 1, p_partkey % greatest(1, users // 20)) owner_user_id,
        case when p_partkey % 23 = 0 then ' ' when p_partkey % 31 = 0 then repeat('p', 151) else '  ' || p_name || ' ' end as name,
        concat('you are ', lower(p_type)) instructions from part, spans""",
    "update_personas": f"""select p_partkey req_id, {B} + to_minutes(cast(p_partkey % 1000 as bigint)) req_ts,
        p_partkey % (nations + 5) persona_id, case when p_size % 2 = 0 then 1 else 2 end field,
        case when p_partkey % 23 = 0 then ' ' when p_partkey % 31 = 0 then repeat('p', 151)
             when p_size % 2 = 0 then '  ' || if(p_partkey % 3 = 0, p_name, concat('role ', p_partkey % 4)) || ' '
             else concat('you are ', p_brand) end as value from part, spans""",
    "delete_personas": f"""select cast(n_nationkey as bigint) req_id, {B} req_ts,
        cast(if(n_nationkey % 11 = 5, -n_nationkey, n_nationkey) as bigint) persona_id,
        case when n_nationkey % 7 = 0 then 'NO' else 'YES' end confirm from nation""",
    "add_templates": f"""select p_partkey req_id, {B} + to_minutes(cast(p_partkey % 1000 as bigint)) req_ts,
        if(p_partkey % 29 = 0, -p_partkey - 1, p_partkey % users) owner_user_id,
        case when p_partkey % 23 = 0 then ' ' when p_partkey % 31 = 0 then repeat('n', 151) else '  ' || p_name || ' ' end as name,
        '  ' || p_brand || ' ' as text, '  ' || p_type || ' ' as category, p_size % 3 visibility_code from part, spans""",
    "update_templates": f"""select p_partkey req_id, {B} + to_minutes(cast(p_partkey % 1000 as bigint)) req_ts,
        if(p_partkey % 37 = 0, -p_partkey - 1, p_partkey) template_id, p_partkey % 5 field,
        '  ' || case when p_partkey % 23 = 0 then ' ' when p_partkey % 31 = 0 then repeat('n', 151)
             else case p_partkey % 5 when 1 then concat(p_name, ' v2') when 2 then concat('text of ', p_brand)
             when 3 then upper(p_type) when 4 then (case when p_size % 2 = 0 then '1' else '2' end) else 'x' end end
             || ' ' as value from part""",
    "share_templates": f"""select p_partkey req_id, {B} + to_minutes(cast(p_partkey % 1000 as bigint)) req_ts,
        if(p_partkey % 37 = 0, -p_partkey - 1, p_partkey) template_id, p_partkey % (regions + 1) workspace_id from part, spans""",
    "create_tickets": """select event_id req_id, ts req_ts, if(event_id % 11 = 0, -user_id - 1, user_id) user_id,
        event_id % 7 topic_code from events where event_type = 'signup'""",
    "assign_tickets": """select event_id req_id, ts + to_minutes(60) req_ts,
        if(event_id % 13 = 0, -event_id - 1, event_id) ticket_id, event_id % (agents + 2) agent_id
        from events, spans where event_type = 'error'""",
    "resolve_tickets": """select event_id req_id, ts + to_minutes(1440) req_ts,
        if(event_id % 13 = 0, -event_id - 1, event_id) ticket_id,
        case when value > 25 then 1 else 2 end status_code from events where event_type = 'error'""",
}

BODY: dict[str, str] = {
    "generate_invoices": f"""
        select req_id, user_id, {_st()} status, reason,
               {_new_id("select coalesce(max(invoice_id), 0) from invoice")} invoice_id,
               case when reason is null then cur_tier end tier_id,
               case when reason is null then cast(cost as double) end amount,
               case when reason is null then (case when cost = 0 then 'Paid' else 'Unpaid' end) end payment_status
        from (select r.*, u.tier_id cur_tier, t.cost,
                     case when u.user_id is null then 'no_user' when t.tier_id is null then 'no_tier' end reason
              from req r left join llm_user u on u.user_id = r.user_id left join tier t on t.tier_id = u.tier_id) d""",
    "mark_paid": f"""
        select r.req_id, r.invoice_id, {_st("x.reason")} status, x.reason
        from req r, lateral (select case when not exists (select 1 from invoice i where i.invoice_id = r.invoice_id)
                                     then 'no_invoice' end reason) x""",
    "start_conversations": f"""
        select req_id, user_id, {_st()} status, reason,
               {_new_id("select coalesce(max(conversation_id), 0) from conversation")} conversation_id,
               case when reason is null then persona_id end persona_id,
               case when reason is null then workspace_id end workspace_id,
               case when reason is null then snap end persona_name_snapshot
        from (select r.req_id, r.req_ts, r.user_id, p.persona_id, r.workspace_id, p.name snap,
                     case when u.user_id is null then 'no_user'
                          when r.workspace_id is not null and w.workspace_id is null then 'no_workspace'
                          when nullif(trim(r.title), '') is null then 'null'
                          when length(trim(r.title)) > 300 then 'too_long' end reason
              from (select * replace (try_cast(trim(persona_id) as bigint) as persona_id,
                                      try_cast(trim(workspace_id) as bigint) as workspace_id) from req) r left join llm_user u on u.user_id = r.user_id
              left join persona p on p.persona_id = r.persona_id
              left join workspace w on w.workspace_id = r.workspace_id) d""",
    "admit_messages": f"""
        select req_id, conversation_id, sender_role, {_st()} status, reason,
               {_new_id("select coalesce(max(message_id), 0) from prior")} message_id
        from (
          select x.*, case when owner_id is null then 'no_conversation'
                           when sender_role = 'USER' and message_limit is not null
                                and coalesce(prior_n, 0) + written_before + 1 > message_limit then 'rate_limit'
                           when nullif(trim(content), '') is null then 'null' end reason
          from (
            select d.*, pc.prior_n,
                   coalesce(sum(case when d.sender_role = 'USER' and nullif(trim(d.content), '') is not null then 1 end) over (
                        partition by d.owner_id, d.msg_day order by d.req_ts, d.req_id
                        rows between unbounded preceding and 1 preceding), 0) written_before
            from (select r.*, case when r.role_code = 1 then 'USER' else 'AI' end sender_role,
                         cast(r.req_ts as date) msg_day, c.user_id owner_id, t.message_limit
                  from req r left join conversation c on c.conversation_id = r.conversation_id
                  left join llm_user u on u.user_id = c.user_id left join tier t on t.tier_id = u.tier_id) d
            left join (select c.user_id owner_id, cast(m.time_sent as date) msg_day, count(*) prior_n
                       from prior m join conversation c on c.conversation_id = m.conversation_id
                       where m.sender_role = 'USER' group by 1, 2) pc
              on pc.owner_id = d.owner_id and pc.msg_day = d.msg_day and d.sender_role = 'USER') x) y""",
    "upsert_feedback": f"""
        select a.req_id, a.message_id, 'accepted' status, cast(null as varchar) reason,
               case when a.is_first and a.existing_id is null then 'insert' else 'update' end action,
               coalesce(a.existing_id, ins.new_id) feedback_id, a.rating, a.comment_text
        from acc a left join (
            select message_id, (select coalesce(max(feedback_id), 0) from message_feedback)
                               + row_number() over (order by req_ts, req_id) new_id
            from acc where is_first and existing_id is null) ins on ins.message_id = a.message_id
        union all
        select req_id, message_id, 'rejected', reason, null, null, null, null from d where reason is not null""",
    "add_bookmarks": f"""
        select req_id, user_id, message_id, {_st()} status, reason
        from (select r.*, case when u.user_id is null then 'no_user' when m.message_id is null then 'no_message'
                               when p.user_id is not null or row_number() over (partition by r.user_id, r.message_id
                                    order by r.req_ts, r.req_id) > 1 then 'duplicate' end reason
              from req r left join llm_user u on u.user_id = r.user_id
              left join message m on m.message_id = r.message_id
              left join prior p on p.user_id = r.user_id and p.message_id = r.message_id) d""",
    "archive_conversations": f"""
        select r.req_id, r.conversation_id, {_st("x.reason")} status, x.reason
        from req r, lateral (select case when not exists (select 1 from conversation c
                                     where c.conversation_id = r.conversation_id) then 'no_conversation' end reason) x""",
    "move_conversations": f"""
        select req_id, conversation_id, workspace_id, {_st()} status, reason
        from (select r.*, case when c.conversation_id is null then 'no_conversation'
                               when w.workspace_id is null then 'no_workspace'
                               when wm.user_id is null then 'not_member' end reason
              from req r left join conversation c on c.conversation_id = r.conversation_id
              left join workspace w on w.workspace_id = r.workspace_id
              left join workspace_member wm on wm.workspace_id = r.workspace_id and wm.user_id = c.user_id) d""",
    "add_users": f"""
        select req_id, {_st()} status, reason, {_new_id("select coalesce(max(user_id), 0) from llm_user")} user_id,
               email, case when reason is null then tier_id end tier_id
        from (select *, case when not filled then 'null' when too_long then 'too_long' when not tier_ok then 'no_tier'
                             when email_taken or not is_first then 'duplicate_email' end reason
              from (select *, row_number() over (partition by filled and tier_ok and not too_long, email
                                                 order by req_ts, req_id) = 1 is_first
                    from (select r.req_id, r.req_ts, r.tier_id, nullif(trim(r.email), '') email,
                                 nullif(trim(r.name), '') is not null and nullif(trim(r.email), '') is not null
                                   and nullif(trim(r.language), '') is not null filled,
                                 coalesce(length(trim(r.name)) > 100 or length(trim(r.email)) > 150
                                          or length(trim(r.language)) > 50, false) too_long,
                                 exists (select 1 from tier t where t.tier_id = r.tier_id) tier_ok,
                                 exists (select 1 from llm_user u where u.email = nullif(trim(r.email), '')) email_taken
                          from req r) a) b) c""",
    "update_users": f"""
        select req_id, user_id, field, {_st()} status, reason
        from (select c.*, case when cur_email is null then 'no_user' when field not between 1 and 4 then 'invalid_field'
                               when value is null then 'null' when too_long then 'too_long'
                               when field = 1 and not tier_ok then 'no_tier'
                               when field = 3 and not g.granted then 'duplicate_email' end reason
              from asked c left join grants g using (req_id)) e""",
    "delete_users": f"""
        select req_id, user_id, {_st("reason2")} status, reason2 reason
        from (select *, case when reason is null and row_number() over (partition by reason is null, user_id
                                                                        order by req_ts, req_id) > 1
                             then 'no_user' else reason end reason2
              from (select r.*, case
                      when not exists (select 1 from llm_user u where u.user_id = r.user_id) then 'no_user'
                      when exists (select 1 from invoice i where i.user_id = r.user_id and i.payment_status = 'Unpaid')
                        then 'unpaid_invoice'
                      when exists (select 1 from support_ticket s where s.user_id = r.user_id
                                   and s.status in ('Open', 'In Progress')) then 'open_ticket'
                      when r.confirm <> 'YES' then 'not_confirmed'
                      when exists (select 1 from support_ticket s where s.user_id = r.user_id) then 'has_ticket'
                    end reason from req r) a) b""",
    "create_workspaces": f"""
        select req_id, owner_id, {_st()} status, reason,
               {_new_id("select coalesce(max(workspace_id), 0) from workspace")} workspace_id,
               case when reason is null then (case when visibility_code = 2 then 'SHARED' else 'PRIVATE' end) end visibility
        from (select r.*, case when not exists (select 1 from llm_user u where u.user_id = r.owner_id) then 'no_user'
                               when nullif(trim(r.name), '') is null then 'null'
                               when length(trim(r.name)) > 150 then 'too_long' end reason from req r) d""",
    "modify_workspaces": f"""
        select req_id, workspace_id, field, {_st()} status, reason
        from (select req_id, workspace_id, f field,
                     case when not exists (select 1 from workspace w where w.workspace_id = x.workspace_id) then 'no_workspace'
                          when (case when f = 1 then nullif(trim(name), '') else 'v' end) is null then 'null'
                          when f = 1 and length(trim(name)) > 150 then 'too_long' end reason
              from (select r.*, case when r.field = 1 then 1 else 2 end f from req r) x) d""",
    "add_members": f"""
        select req_id, workspace_id, user_id, {_st()} status, reason
        from (select r.*, case when w.workspace_id is null then 'no_workspace' when u.user_id is null then 'no_user'
                               when m.user_id is not null or row_number() over (partition by r.workspace_id, r.user_id
                                    order by r.req_ts, r.req_id) > 1 then 'already_member' end reason
              from req r left join workspace w on w.workspace_id = r.workspace_id
              left join llm_user u on u.user_id = r.user_id
              left join workspace_member m on m.workspace_id = r.workspace_id and m.user_id = r.user_id) d""",
    "create_personas": f"""
        select req_id, owner_user_id, name, {_st()} status, reason,
               {_new_id("select coalesce(max(persona_id), 0) from persona")} persona_id
        from (select *, case when not owner_ok then 'no_user' when not filled then 'null' when too_long then 'too_long'
                             when taken or not is_first then 'duplicate_name' end reason
              from (select *, row_number() over (partition by owner_ok and filled and not too_long, owner_user_id, name
                                                 order by req_ts, req_id) = 1 is_first
                    from (select r.req_id, r.req_ts, r.owner_user_id, nullif(trim(r.name), '') name,
                                 exists (select 1 from llm_user u where u.user_id = r.owner_user_id) owner_ok,
                                 nullif(trim(r.name), '') is not null and nullif(trim(r.instructions), '') is not null filled,
                                 coalesce(length(trim(r.name)) > 150, false) too_long,
                                 exists (select 1 from persona p where p.owner_user_id = r.owner_user_id
                                         and p.name = nullif(trim(r.name), '')) taken
                          from req r) a) b) c""",
    "update_personas": f"""
        select req_id, persona_id, field, {_st()} status, reason
        from (select c.*, case when owner_user_id is null then 'no_persona' when value is null then 'null'
                               when too_long then 'too_long' when field = 1 and not g.granted then 'duplicate_name' end reason
              from asked c left join grants g using (req_id)) e""",
    "delete_personas": f"""
        select req_id, persona_id, {_st("reason2")} status, reason2 reason, active_count
        from (select *, case when reason is null and row_number() over (partition by reason is null, persona_id
                                                                        order by req_ts, req_id) > 1
                             then 'no_persona' else reason end reason2
              from (select r.*, coalesce(a.n, 0) active_count,
                           case when p.persona_id is null then 'no_persona' when coalesce(a.n, 0) > 5 then 'active_conversations'
                                when r.confirm <> 'YES' then 'not_confirmed' end reason
                    from req r left join persona p on p.persona_id = r.persona_id
                    left join (select persona_id, count(*) n from conversation where status = 'ACTIVE'
                               and persona_id is not null group by persona_id) a on a.persona_id = r.persona_id) x) y""",
    "add_templates": f"""
        select req_id, owner_user_id, {_st()} status, reason,
               {_new_id("select coalesce(max(template_id), 0) from prompt_template")} template_id,
               case when reason is null then (case when visibility_code = 2 then 'SHARED' else 'PRIVATE' end) end visibility
        from (select r.*, case when not exists (select 1 from llm_user u where u.user_id = r.owner_user_id) then 'no_user'
                               when nullif(trim(r.name), '') is null or nullif(trim(r.text), '') is null
                                    or nullif(trim(r.category), '') is null then 'null'
                               when length(trim(r.name)) > 150 or length(trim(r.category)) > 100 then 'too_long' end reason
              from req r) d""",
    "update_templates": f"""
        select req_id, template_id, field, {_st()} status, reason
        from (select r.*, case when not exists (select 1 from prompt_template p where p.template_id = r.template_id)
                                    then 'no_template'
                               when r.field not between 1 and 4 then 'invalid_field'
                               when r.field <> 4 and nullif(trim(r.value), '') is null then 'null'
                               when r.field = 1 and length(trim(r.value)) > 150 or r.field = 3 and length(trim(r.value)) > 100
                                    then 'too_long' end reason
              from req r) d""",
    "share_templates": f"""
        select req_id, template_id, workspace_id, {_st()} status, reason
        from (select *, case when visibility is null then 'no_template' when not ws_ok then 'no_workspace'
                             when shared or (valid and not is_first) then 'already_shared'
                             when visibility = 'PRIVATE' then 'private' end reason
              from (select *, row_number() over (partition by valid, workspace_id, template_id
                                                 order by req_ts, req_id) = 1 is_first
                    from (select r.*, p.visibility, w.workspace_id is not null ws_ok,
                                 s.template_id is not null shared,
                                 coalesce(p.visibility is not null and w.workspace_id is not null
                                          and p.visibility <> 'PRIVATE', false) valid
                          from req r left join prompt_template p on p.template_id = r.template_id
                          left join workspace w on w.workspace_id = r.workspace_id
                          left join workspace_prompt_template s on s.workspace_id = r.workspace_id
                               and s.template_id = r.template_id) a) b) c""",
    "create_tickets": f"""
        select req_id, user_id, {_st()} status, reason,
               {_new_id("select coalesce(max(ticket_id), 0) from support_ticket")} ticket_id,
               case when reason is null then (case topic_code when 1 then 'Billing' when 2 then 'Model Error'
                    when 3 then 'Account' when 4 then 'Feature Request' else 'Other' end) end topic_name
        from (select r.*, case when not exists (select 1 from llm_user u where u.user_id = r.user_id) then 'no_user' end reason
              from req r) d""",
    "assign_tickets": f"""
        select req_id, ticket_id, agent_id, {_st()} status, reason
        from (select r.*, case when s.ticket_id is null then 'no_ticket' when a.agent_id is null then 'no_agent'
                               when s.closed_time is not null then 'closed' end reason
              from req r left join support_ticket s on s.ticket_id = r.ticket_id
              left join support_agent a on a.agent_id = r.agent_id) d""",
    "resolve_tickets": f"""
        select req_id, ticket_id, {_st()} status, reason,
               case when reason is null then (case when status_code = 1 then 'Resolved' else 'Escalated' end) end final_status
        from (select r.*, case when s.ticket_id is null then 'no_ticket' end reason
              from req r left join support_ticket s on s.ticket_id = r.ticket_id) d""",
}

# extra CTEs some bodies need, after ``req``
EXTRA: dict[str, list[tuple[str, str]]] = {
    "admit_messages": [("prior", "select * from message m where not exists (select 1 from req r where r.req_id = m.message_id)")],
    "add_bookmarks": [("prior", "select * from message_bookmark")],
    "upsert_feedback": [
        ("d", """select r.*, case when m.message_id is null then 'no_message' when m.sender_role <> 'AI' then 'not_ai' end reason,
                 case when r.rating_code = 1 then 'Thumbs Up' else 'Thumbs Down' end rating,
                 nullif(trim(r.comment), '') comment_text
                 from req r left join message m on m.message_id = r.message_id"""),
        ("acc", """select d.*, f.feedback_id existing_id,
                   row_number() over (partition by d.message_id order by d.req_ts, d.req_id) = 1 is_first
                   from d left join message_feedback f on f.message_id = d.message_id where d.reason is null""")],
    "update_users": [
        ("asked", """select r.req_id, r.req_ts, r.user_id, r.field, nullif(trim(r.value), '') value, u.email cur_email,
            coalesce(length(trim(r.value)) > case r.field when 2 then 100 when 3 then 150 when 4 then 50 end, false) too_long,
            coalesce(r.field = 1 and exists (select 1 from tier t where t.tier_id = try_cast(trim(r.value) as bigint)), false) tier_ok
            from req r left join llm_user u on u.user_id = r.user_id"""),
        ("wants", """select row_number() over (order by req_ts, req_id) n, req_id, user_id who, value what,
            (select min(o.user_id) from llm_user o where o.email = value) had, cur_email own
            from asked where field = 3 and cur_email is not null and value is not null and not too_long""")],
    "update_personas": [
        ("asked", """select r.req_id, r.req_ts, r.persona_id, r.field, nullif(trim(r.value), '') value, p.owner_user_id, p.name own,
            r.field = 1 and coalesce(length(trim(r.value)) > 150, false) too_long
            from req r left join persona p on p.persona_id = r.persona_id"""),
        ("wants", """select row_number() over (order by req_ts, req_id) n, req_id, persona_id who,
            owner_user_id || ':' || value what,
            (select min(q.persona_id) from persona q where q.owner_user_id = a.owner_user_id and q.name = a.value) had,
            owner_user_id || ':' || own own
            from asked a where field = 1 and owner_user_id is not null and value is not null and not too_long""")],
}
# one request after the other: holder overrides (-1 = freed) and current values so far, in two maps
WALK = ("grants", """select req_id, granted from (
    with recursive walk(n, req_id, granted, holder, mine) as (
        select cast(0 as bigint), cast(null as bigint), false, map([cast('' as varchar)], [cast(-1 as bigint)]),
               map([cast(-1 as bigint)], [cast('' as varchar)])
        union all
        select w.n, w.req_id, ok,
               case when ok and now_own <> w.what then map_concat(holder, map([now_own, w.what], [cast(-1 as bigint), w.who]))
                    when ok then map_concat(holder, map([w.what], [w.who])) else holder end,
               case when ok then map_concat(mine, map([w.who], [w.what])) else mine end
        from (select w.*, x.holder, x.mine, coalesce(x.holder[w.what], w.had, -1) in (-1, w.who) ok,
                     coalesce(x.mine[w.who], w.own) now_own
              from walk x join wants w on w.n = x.n + 1) w)
    select * from walk where n > 0) z""")
for _job in ("update_users", "update_personas"):
    EXTRA[_job].append(WALK)

CASCADE_BODY = """
    select 'llm_user' as "table", (select count(*) from llm_user) rows_before,
           (select count(*) from llm_user where user_id not in (select user_id from du)) rows_after
    union all select 'billing_record', (select count(*) from billing_record),
           (select count(*) from billing_record where user_id not in (select user_id from du))
    union all select 'invoice', (select count(*) from invoice),
           (select count(*) from invoice where user_id not in (select user_id from du))
    union all select 'workspace', (select count(*) from workspace),
           (select count(*) from workspace where workspace_id not in (select workspace_id from dw))
    union all select 'workspace_member', (select count(*) from workspace_member),
           (select count(*) from workspace_member where user_id not in (select user_id from du)
                                                   and workspace_id not in (select workspace_id from dw))
    union all select 'persona', (select count(*) from persona),
           (select count(*) from persona where owner_user_id not in (select user_id from du))
    union all select 'conversation', (select count(*) from conversation),
           (select count(*) from conversation where conversation_id not in (select conversation_id from dc))
    union all select 'message', (select count(*) from message),
           (select count(*) from message where message_id not in (select message_id from dm))
    union all select 'message_feedback', (select count(*) from message_feedback),
           (select count(*) from message_feedback where message_id not in (select message_id from dm))
    union all select 'message_bookmark', (select count(*) from message_bookmark),
           (select count(*) from message_bookmark where user_id not in (select user_id from du)
                                                   and message_id not in (select message_id from dm))
    union all select 'prompt_template', (select count(*) from prompt_template),
           (select count(*) from prompt_template where template_id not in (select template_id from dt))
    union all select 'workspace_prompt_template', (select count(*) from workspace_prompt_template),
           (select count(*) from workspace_prompt_template where workspace_id not in (select workspace_id from dw)
                                                            and template_id not in (select template_id from dt))"""


# --- fixed values: the columns of the platform tables
COLUMNS: dict[str, list[str]] = {t: c.split() for t, c in {
    "tier": "tier_id tier_name cost message_limit pro_access",
    "support_agent": "agent_id name email specialty hired_date",
    "llm_user": "user_id tier_id name email creation_date language",
    "billing_record": "user_id payment_method billing_address",
    "invoice": "invoice_id user_id tier_id invoice_date amount payment_status",
    "workspace": "workspace_id owner_id name visibility created_at",
    "workspace_member": "workspace_id user_id role joined_at",
    "persona": "persona_id owner_user_id name instructions created_at",
    "conversation": "conversation_id user_id workspace_id persona_id title start_time status persona_name_snapshot "
                    "persona_instr_snapshot",
    "message": "message_id conversation_id sender_role time_sent content",
    "message_feedback": "feedback_id message_id rating comment_text submitted_at",
    "message_bookmark": "user_id message_id bookmarked_time",
    "prompt_template": "template_id owner_user_id name text category visibility created_at",
    "workspace_prompt_template": "workspace_id template_id shared_at",
    "support_ticket": "ticket_id user_id agent_id topic_name opened_time closed_time status"}.items()}


def _facts(name: str, source: str, columns: list[str]) -> str:
    """Per column: rows with a value, and the least and greatest as text, numbers with two decimals."""
    def text(c: str) -> str:
        return (f"case when typeof(any_value({c})) like 'DECIMAL%' or typeof(any_value({c})) = 'DOUBLE' "
                f"then printf('%.2f', try_cast({{0}}({c}) as double)) "
                f"when typeof(any_value({c})) like 'TIMESTAMP%' then strftime(try_cast({{0}}({c}) as timestamp), '%Y-%m-%d %H:%M:%S') "
                f"else cast({{0}}({c}) as varchar) end")
    return "\nunion all\n".join(
        f"select '{name}' as \"table\", '{c}' as \"column\", count(*) as row_count, count({c}) as filled, "
        f"{text(c).format('min')} as low, {text(c).format('max')} as high from {source} s" for c in columns)


def rules_sql() -> dict[str, str]:
    out = {}
    for key, body in BODY.items():
        out[key] = with_binding(body, [("req", REQ[key])] + EXTRA.get(key, []))
    deleted = [("req", REQ["delete_users"]), ("decided", BODY["delete_users"]),
               ("du", "select user_id from decided where status = 'accepted'"),
               ("dw", "select workspace_id from workspace where owner_id in (select user_id from du)"),
               ("dc", "select conversation_id from conversation where user_id in (select user_id from du)"),
               ("dm", "select message_id from message where conversation_id in (select conversation_id from dc)"),
               ("dt", "select template_id from prompt_template where owner_user_id in (select user_id from du)")]
    out["cascade_delete"] = with_binding(CASCADE_BODY, deleted)
    from convops.plans.oracle_versions import versions_sql
    out |= versions_sql(deleted)
    out["admit_messages_stream"] = with_binding(
        "select req_id, conversation_id, sender_role, status, reason from admitted",
        [("req", REQ["admit_messages"])] + EXTRA["admit_messages"] + [("admitted", BODY["admit_messages"])])
    out["admit_messages_batches"] = out["admit_messages_processor"] = out["admit_messages_stream"]
    out["scan_tables"] = with_binding("\nunion all\n".join(_facts(n, n, cols) for n, cols in COLUMNS.items()))
    out["write_version"] = with_binding(
        "\nunion all\n".join(_facts(n, f"({sql})", cols) for n, sql, cols in (
            ("decisions", "from decided", ["req_id", "user_id", "status", "reason", "invoice_id", "tier_id", "amount",
                                           "payment_status"]),
            ("invoice", "from invoice union all by name select d.invoice_id, d.user_id, d.tier_id, r.req_ts as invoice_date, "
             "cast(d.amount as decimal(10,2)) as amount, d.payment_status from decided d join req r using (req_id) "
             "where d.status = 'accepted'", COLUMNS["invoice"]))),
        [("req", REQ["generate_invoices"]), ("decided", BODY["generate_invoices"])])
    return out
