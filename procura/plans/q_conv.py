"""Prompt-key, conversation-tail and route-label queries (R-6, R-9, R-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as cv
from ..operators.runs import PRIMARY_MODEL
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .registry import query


@query("prompt_key", f"""
select conv_id, turn, tenant_id,
       sha256(concat_ws(':', tenant_id, '{PRIMARY_MODEL}',
                        trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')))) as query_hash
from prompts""", ("prompts",))
def q_prompt_key(t: Tables):
    """R-6: cache key of every user prompt."""
    p = fx.prompts(t)
    return p.select("conv_id", "turn", "tenant_id",
                    cv.prompt_key(F.col("tenant_id"), F.col("prompt")).alias("query_hash"))


@query("conversation_tail", """
select conv_id, string_agg(case role when 'user' then 'human' when 'assistant' then 'ai' else role end
                           || ': ' || text, chr(10) order by turn) as conversation
from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
where rn <= 6 group by conv_id""", ())
def q_conversation_tail(t: Tables):
    """R-9: last six messages of every conversation."""
    return cv.conversation_tail(t.conversations.select("conv_id", "turn", "role", "text"))


@query("route_label", """
, c as (select conv_id, turn, text,
               regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')),
                                             '^[-*• \\t]+', ''), '^\\s+|\\s+$', '', 'g') as cand
        from conversations where role = 'assistant')
select conv_id, turn,
       case when text is null then 'end'
            when cand in ('supplier_intel', 'anomaly', 'negotiation', 'end') then cand
            when contains(cand, 'supplier_intel') then 'supplier_intel'
            when contains(cand, 'anomaly') then 'anomaly'
            when contains(cand, 'negotiation') then 'negotiation'
            else 'end' end as route
from c""", ())
def q_route_label(t: Tables):
    """R-10: route label normalised from each assistant reply."""
    c = t.conversations.where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", cv.route_label(F.col("text")).alias("route"))
