"""Audit and approval queries (D-1 .. D-6, Q-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import reports as rp
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .q_guards import _RE2_PII
from .q_reconcile import _MATCH, results
from .registry import query

_SPLIT = r"regexp_split_to_array(regexp_replace({c}, '(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _lines(c: str) -> str:
    return f"case when {c} = '' then []::varchar[] else {_SPLIT.format(c=c)} end"


# Of two lists of lines: the heads and tails they share are left out; the rest is '-<number>:<line>' and '+<number>:<line>'.
_DIFFS = f"""
, edits as (
  select tenant_id, entity_id, {_lines('original_text')} as o, {_lines('edited_text')} as e
  from decisions where edited_text is not null and edited_text <> original_text)
, heads as (
  select *, coalesce(nullif(list_position(
              [o[i] is not distinct from e[i] for i in range(1, greatest(len(o), len(e)) + 1)], false), 0) - 1,
            least(len(o), len(e))) as h,
         coalesce(nullif(list_position(
              [o[len(o) + 1 - i] is not distinct from e[len(e) + 1 - i] for i in range(1, least(len(o), len(e)) + 1)],
              false), 0) - 1, least(len(o), len(e))) as shared_tail
  from edits)
, ends as (select *, least(shared_tail, least(len(o), len(e)) - h) as t from heads)
, diffs as (
  select tenant_id, entity_id,
         list_concat([concat('-', i, ':', o[i]) for i in range(h + 1, len(o) - t + 1)],
                     [concat('+', i, ':', e[i]) for i in range(h + 1, len(e) - t + 1)]) as diff
  from ends)
"""
_AUDIT = _DIFFS + """
, d as (select *, case action when 'approve' then 'APPROVED' when 'edit' then 'EDITED'
                              else 'REJECTED' end as act,
               timestamp '1970-01-01 00:00:00' + to_seconds(entity_id) as drafted_at
        from decisions)
, raw as (
  select tenant_id, entity_id, 'DRAFTED' as action, original_text, cast(null as varchar) as edited,
         'agent' as actor, drafted_at as created_at from d
  union all
  select tenant_id, entity_id, act, original_text,
         case when act = 'APPROVED' then null else edited_text end,
         'unknown_reviewer', drafted_at + interval 1 second from d where action is not null)
, audit as (
  select sha256(concat_ws('|', tenant_id, 'negotiation_email', entity_id, action)) as audit_id,
         tenant_id, 'negotiation_email' as entity_type, entity_id, action,
         cast(to_json({'text': original_text}) as varchar) as original_payload,
         cast(to_json({'text': coalesce(edited, original_text)}) as varchar) as edited_payload,
         coalesce(edited, original_text) <> original_text as changed,
         case when edited <> original_text then diff else []::varchar[] end as diff, actor, sha256(coalesce(edited, original_text)) as content_hash, created_at
  from raw left join diffs using (tenant_id, entity_id))
"""


def audit(t: Tables):
    return au.audit_rows(fx.decisions(t))


def _shown(df):
    """The diff as strings ``-<line number>:<line>`` and ``+<line number>:<line>``."""
    return df.withColumn("diff", F.transform("diff", lambda x: F.concat(
        x["sign"], x["line_no"].cast("string"), F.lit(":"), x["line"])))


@query("audit_rows", _AUDIT + "select * from audit", ("decisions",))
def q_audit_rows(t: Tables):
    """D-1 / D-4 / S-13: DRAFTED rows plus decision rows."""
    return _shown(audit(t))


@query("content_hash", "select doc_id, sha256(text) as content_hash from documents", ())
def q_content_hash(t: Tables):
    """D-2."""
    return t.documents.select("doc_id", au.content_hash(F.col("text")).alias("content_hash"))


@query("approval_lifecycle", _AUDIT + """
select tenant_id, entity_id, count(*) filter (where action = 'DRAFTED') as n_drafted,
       count(*) filter (where action in ('APPROVED', 'EDITED', 'REJECTED')) as n_decisions,
       max(case when action <> 'DRAFTED' then action end) as decision,
       case when count(*) filter (where action = 'DRAFTED') = 1
                 and count(*) filter (where action in ('APPROVED', 'EDITED', 'REJECTED')) = 0 then 'PENDING'
            when count(*) filter (where action = 'DRAFTED') = 1
                 and count(*) filter (where action in ('APPROVED', 'EDITED', 'REJECTED')) = 1 then 'DECIDED'
            else 'INVALID' end as state
from audit group by tenant_id, entity_id""", ("decisions",))
def q_approval_lifecycle(t: Tables):
    """D-5."""
    return au.approval_lifecycle(audit(t))


@query("audit_recent", _AUDIT + """
select * exclude (rn) from (
  select *, row_number() over (partition by tenant_id order by created_at desc, audit_id) as rn
  from audit) where rn <= 20""", ("decisions",))
def q_audit_recent(t: Tables):
    """Q-6: latest 20 audit rows per tenant."""
    return rp.top_k_per(_shown(audit(t)), ["tenant_id"], [F.col("created_at").desc(), F.col("audit_id")], 20)


@query("line_changes", f"""
, base as (select * from decisions where edited_text is not null and edited_text <> original_text)
, lines as (
  select tenant_id, entity_id, unnest(case when original_text = '' then []::varchar[]
                                           else {_SPLIT.format(c='original_text')} end) as line, 1 as o, 0 as e
  from base
  union all
  select tenant_id, entity_id, unnest(case when edited_text = '' then []::varchar[]
                                           else {_SPLIT.format(c='edited_text')} end), 0, 1 from base)
, c as (select tenant_id, entity_id, line, cast(sum(o) as bigint) as n_orig, cast(sum(e) as bigint) as n_edit
        from lines group by tenant_id, entity_id, line)
select tenant_id, entity_id, line, n_orig - least(n_orig, n_edit) as n_removed,
       n_edit - least(n_orig, n_edit) as n_added, least(n_orig, n_edit) as n_kept
from c where n_orig <> n_edit""", ("decisions",))
def q_line_changes(t: Tables):
    """D-3: net added / removed line counts of every edited draft."""
    return au.line_changes(fx.decisions(t))


@query("line_diff", _DIFFS + """
, flat as (select tenant_id, entity_id, unnest(diff) as x from diffs)
select tenant_id, entity_id, x[1] as sign, cast(regexp_extract(x, '^.([0-9]+):', 1) as int) as line_no,
       substr(x, strpos(x, ':') + 1) as line from flat""", ("decisions",))
def q_line_diff(t: Tables):
    """D-3: every removed and added line of every edited draft, with its number."""
    return au.ordered_changes(fx.decisions(t))


def _drafts_oracle() -> str:
    red = "body"
    for _kind, pat, rep in _RE2_PII:
        red = f"regexp_replace({red}, '{pat}', '{rep}', 'g')"
    note = au.APPROVAL_NOTE
    return _MATCH + f"""
, agg as (select tenant_id, supplier_id,
                 count(*) filter (where check_type = 'PRICE_VARIANCE') as n_price,
                 count(*) filter (where check_type = 'DUPLICATE_PO') as n_dup,
                 count(*) filter (where check_type = 'MISSING_CONTRACT') as n_missing,
                 cast(sum(variance_amount) as decimal(38,5)) as overcharge
          from results group by tenant_id, supplier_id)
, b as (select a.*, s.name as supplier_name,
               printf('Dear %s billing team,' || chr(10) || chr(10) || 'Our reconciliation found %d invoice lines priced above contract (summed unit-price excess %s), %d lines billed against a purchase order already invoiced, and %d lines with no active contract price. Please review these items and send corrected invoices or supporting documents.' || chr(10) || chr(10) || '{note}',
                      s.name, n_price, coalesce(cast(overcharge as varchar), '0'), n_dup, n_missing) as body
        from agg a join suppliers s on s.tenant_id = a.tenant_id and s.supplier_id = a.supplier_id)
, r as (select *, {red} as draft_text from b)
"""


@query("dispute_drafts", _drafts_oracle() + """
select tenant_id, supplier_id, supplier_name, n_price, n_dup, n_missing, draft_text,
       len(regexp_split_to_array(draft_text, '\\s+')) < 150 as under_150_words
from r""", ("invoices", "contract_items", "suppliers"))
def q_dispute_drafts(t: Tables):
    """D-6 (re-aimed): one redacted dispute draft per flagged supplier."""
    return au.dispute_drafts(results(t), fx.suppliers(t))


@query("draft_audit", _drafts_oracle() + """
select sha256(concat_ws('|', tenant_id, 'negotiation_email', supplier_id, 'DRAFTED')) as audit_id, tenant_id,
       'negotiation_email' as entity_type, supplier_id as entity_id, 'DRAFTED' as action,
       cast(to_json({'text': draft_text}) as varchar) as original_payload,
       cast(to_json({'text': draft_text}) as varchar) as edited_payload, false as changed, []::varchar[] as diff,
       'agent' as actor, sha256(draft_text) as content_hash,
       timestamp '1970-01-01 00:00:00' + to_seconds(supplier_id) as created_at
from r""", ("invoices", "contract_items", "suppliers"))
def q_draft_audit(t: Tables):
    """D-6 / S-13: the dispute drafts as DRAFTED rows of the audit log."""
    return _shown(au.audit_rows(au.draft_decisions(au.dispute_drafts(results(t), fx.suppliers(t)))))
