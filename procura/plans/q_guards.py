"""Guardrail queries (G-1, G-2, G-3, G-4, A-11, X-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as gd
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .registry import query

# Statements from the reference's screen tests, plus the cases
# its screen code implies (refused `create` substring, WITH, limits). The
# templates take the log row's id (twice), so limits and filters vary with
# the data: some limits fall under the cap, others above it.
SCREEN_STATEMENTS = [
    "SELECT * FROM suppliers; DROP TABLE suppliers;",
    "DELETE FROM invoices WHERE 1=1",
    "SELECT * FROM suppliers -- ; DROP TABLE suppliers;",
    "UPDATE suppliers SET risk_score = 0",
    "SELECT * FROM pg_catalog.pg_tables",
    "select created_at from t",
    "with x as (select 1) select * from x",
    "select name from suppliers where supplier_id = %d",
    "select name from suppliers limit %d",
    "select * from (select * from t limit %d) a LIMIT %d",
    "  select invoice_id from invoices where supplier_id = %d limit 0%d ;; ",
]


# RE2 versions of the PII patterns for the oracle. RE2 has ASCII-only \w, \d and
# \b and no look-around, so Unicode classes are spelled out and a trailing
# word boundary is emulated by consuming the next character and putting it back.
_W = r"[\pL\pN_]"
_NW = r"[^\pL\pN_]"
_RE2_PII = [
    ("EMAIL", rf"[\pL\pN_.\-]+@[\pL\pN_.\-]+\.{_W}+", "[REDACTED_EMAIL]"),
    ("PHONE_IN", rf"((?:\+91[-\s]?)?\b[6-9]\p{{Nd}}{{9}})({_NW}|$)", r"[REDACTED_PHONE_IN]\2"),
    ("CREDIT_CARD", rf"(\b(?:\p{{Nd}}[ -]?){{12,15}}\p{{Nd}})(?:[ -]([\pL_])|[ -]\b|({_NW}|$))",
     r"[REDACTED_CREDIT_CARD]\2\3"),
    ("PAN_IN", r"\b[A-Z]{5}\p{Nd}{4}[A-Z]\b", "[REDACTED_PAN_IN]"),
    ("IFSC_IN", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "[REDACTED_IFSC_IN]"),
]


def _pii_ctes(src: str, id_col: str, text_col: str) -> str:
    parts = [f", p0 as (select {id_col}, {text_col} as t0 from {src})"]
    for i, (kind, pat, rep) in enumerate(_RE2_PII, start=1):
        parts.append(
            f", p{i} as (select *, len(regexp_extract_all(t{i-1}, '{pat}')) as n_{kind.lower()}, "
            f"regexp_replace(t{i-1}, '{pat}', '{rep}', 'g') as t{i} from p{i-1})")
    return "\n".join(parts)


@query("pii_redact", _pii_ctes("contract_pages", "doc_id", "page_text") + """
select doc_id, t5 as redacted_text,
       (n_email > 0)::int + (n_phone_in > 0)::int + (n_credit_card > 0)::int
       + (n_pan_in > 0)::int + (n_ifsc_in > 0)::int as n_finding_types
from p5""", ("contract_pages",))
def q_pii_redact(t: Tables):
    """G-1: sequential PII redaction of every contract page."""
    red = gd.redact_pii(fx.contract_pages(t).select("doc_id", "page_text"), "page_text")
    return red.select("doc_id", "redacted_text", F.size("findings").alias("n_finding_types"))


@query("pii_findings", _pii_ctes("contract_pages", "doc_id", "page_text") + """
select doc_id, pii_type, cast(match_count as int) as match_count from (
  select doc_id, 'EMAIL' as pii_type, n_email as match_count from p5
  union all select doc_id, 'PHONE_IN', n_phone_in from p5
  union all select doc_id, 'CREDIT_CARD', n_credit_card from p5
  union all select doc_id, 'PAN_IN', n_pan_in from p5
  union all select doc_id, 'IFSC_IN', n_ifsc_in from p5) where match_count > 0""", ("contract_pages",))
def q_pii_findings(t: Tables):
    """A-11: match count per page and PII type."""
    return gd.pii_counts(fx.contract_pages(t).select("doc_id", "page_text"), ["doc_id"], "page_text")


def _injection_list(col: str) -> str:
    items = ", ".join(f"case when regexp_matches({col}, '{p}', 'i') then '{p}' end"
                      for p in gd.INJECTION_PATTERNS)
    return f"list_filter([{items}], lambda x: x is not null)"


@query("injection_scan", f"""
select doc_id, {_injection_list('page_text')} as matched_patterns,
       len({_injection_list('page_text')}) > 0 as is_suspicious
from contract_pages""", ("contract_pages",))
def q_injection_scan(t: Tables):
    """G-2: injection patterns found on each page."""
    return gd.scan_injection(fx.contract_pages(t).select("doc_id", "page_text"), "page_text") \
        .select("doc_id", "matched_patterns", "is_suspicious")


@query("extraction_gate", f"""
, s as (select doc_id, contract_id, tenant_id, page_number,
               {_injection_list('page_text')} as m from contract_pages)
select doc_id, contract_id, tenant_id, page_number, 'extractor:contract' as agent_name,
       case when len(m) > 0 then 'BLOCKED_INJECTION' else 'ADMITTED' end as gate_status,
       case when len(m) > 0 then 'Matched patterns: [' ||
            array_to_string(list_transform(m, lambda p: '''' || p || ''''), ', ') || ']' end as error_message
from s""", ("contract_pages",))
def q_extraction_gate(t: Tables):
    """X-5: pages blocked from extraction by the injection scan."""
    return gd.extraction_gate(fx.contract_pages(t), "page_text", "contract")


def _screen_ctes() -> str:
    cases = "\n".join(f"    when {i} then printf('{s}', item_id * 13, item_id * 50)"
                      for i, s in enumerate(SCREEN_STATEMENTS))
    forb = "\n".join(f"    when contains(lower(st), '{w}') then '{w}'" for w in gd.FORBIDDEN_SQL_WORDS)
    return f"""
, q as (select item_id as query_id, case item_id % {len(SCREEN_STATEMENTS)}
{cases} end as sql from benchmark)
, s as (select query_id, sql,
               regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'), ';+$', '') as st from q)
, r as (select *, case
{forb} end as fw,
        regexp_matches(lower(st), '\\blimit\\s+\\d+\\b') as has_limit,
        regexp_extract(lower(st), '\\blimit\\s+(\\d+)\\b', 1) as first_n from s)
, r2 as (select *, case when contains(st, ';') then '{gd.MSG_MULTI}'
             when not regexp_matches(st, '^\\s*select\\b', 'i') then '{gd.MSG_NOT_SELECT}'
             when fw is not null then 'Forbidden keyword detected: ''' || fw || '''' end as reason
         from r)
"""


def _screen_sql_oracle() -> str:
    return _screen_ctes() + f"""
select query_id, sql, reason, reason is null as allowed,
       case when reason is not null then null
            when not has_limit then st || ' LIMIT {gd.DEFAULT_LIMIT}'
            when cast(first_n as hugeint) > {gd.MAX_LIMIT}
              then regexp_replace(st, '\\blimit\\s+\\d+\\b', 'LIMIT {gd.MAX_LIMIT}', 'gi')
            else st end as safe_sql
from r2"""


@query("sql_screen", _screen_sql_oracle(), ())
def q_sql_screen(t: Tables):
    """G-3 / Q-9: screen a log of generated statements."""
    return gd.screen_sql(fx.query_log(t), "sql")


GUARDED_TENANT = 0
GUARDED_SQL = ("select supplier_id, cast(sum(total_amount) as decimal(38,5)) as spend from invoices "
               "group by supplier_id order by spend desc, supplier_id;")


@query("guarded_query", f"""
select supplier_id, cast(sum(total_amount) as decimal(38,5)) as spend from invoices where tenant_id = {GUARDED_TENANT}
group by supplier_id order by spend desc, supplier_id limit {gd.DEFAULT_LIMIT}""", ("invoices",))
def q_guarded_query(t: Tables):
    """G-4: a screened statement run over one tenant's views."""
    df, _ = gd.guarded_query(t.spark, {"invoices": fx.invoices(t)}, GUARDED_TENANT, GUARDED_SQL)
    return df


@query("sql_blocked_runs", _screen_ctes() + """
select query_id % 5 as tenant_id, query_id as run_id, 'sql_agent:blocked' as agent_name, 'ERROR' as status,
       reason || ' | generated_sql=' || sql as error_message, cast(0 as decimal(18,6)) as estimated_cost_usd
from r2 where reason is not null""", ())
def q_sql_blocked_runs(t: Tables):
    """G-4 / S-7: run-log rows of the refused statements in the query log."""
    log = fx.query_log(t).withColumn("tenant_id", F.col("query_id") % 5)
    return gd.blocked_run_rows(gd.screen_sql(log, "sql"))
