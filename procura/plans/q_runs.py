"""Run-log, cost, outcome and telemetry queries (S-7, G-5, G-6, G-7, A-1)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import runs as rn
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .registry import query

# The fixture's placeholder model names stand in for the two priced models;
# model_x has no price row.
FIXTURE_RATES = {"model_a": rn.COST_PER_1M_TOKENS[rn.PRIMARY_MODEL],
                 "model_b": rn.COST_PER_1M_TOKENS[rn.FALLBACK_MODEL]}


def _rate_cte() -> str:
    rows = ", ".join(
        f"('{m}', cast({Decimal(i) / Decimal(1_000_000)} as decimal(20,12)), "
        f"cast({Decimal(o) / Decimal(1_000_000)} as decimal(20,12)))"
        for m, (i, o) in FIXTURE_RATES.items())
    return f", rates(model, in_rate, out_rate) as (values {rows})"


_RUN_LOG = _rate_cte() + """
, run_log as (
  select a.tenant_id, a.agent_name || ':' || a.model as agent_name, a.run_id, a.input_tokens,
         a.output_tokens,
         cast(case when r.in_rate is null then 0
                   else round(coalesce(a.input_tokens, 0) * r.in_rate
                              + coalesce(a.output_tokens, 0) * r.out_rate, 6) end as decimal(18,6))
           as estimated_cost_usd,
         a.latency_ms, a.status, cast(null as varchar) as error_message, a.created_at
  from agent_runs a left join rates r on r.model = a.model)
"""


def run_log(t: Tables):
    runs = fx.agent_runs(t).withColumn("error_message", F.lit(None).cast("string"))
    return rn.run_log_rows(runs, rn.rate_table(t.spark, FIXTURE_RATES))


@query("run_log_rows", _RUN_LOG + "select * from run_log", ("agent_runs",))
def q_run_log_rows(t: Tables):
    """S-7 / G-6 / J-10: run-log rows with cost (unknown model costs 0)."""
    return run_log(t)


@query("telemetry", _RUN_LOG + """
select tenant_id, agent_name, count(*) as call_count,
       count(*) filter (where status = 'SUCCESS') as success_count,
       count(*) filter (where status like '%ERROR%' or status like '%BLOCKED%') as error_count,
       cast(round(coalesce(avg(latency_ms), 0)) as bigint) as avg_latency_ms,
       cast(round(coalesce(sum(estimated_cost_usd), 0), 6) as decimal(18,6)) as total_cost_usd
from run_log group by tenant_id, agent_name""", ("agent_runs",))
def q_telemetry(t: Tables):
    """A-1: telemetry per tenant and agent."""
    return rn.telemetry(run_log(t))


@query("run_status", """
select call_id, attempt, case when succeeded then 'SUCCESS'
            when contains(error_message, '429') then 'RATE_LIMITED' else 'ERROR' end as status
from llm_attempts""", ("llm_attempts",))
def q_run_status(t: Tables):
    """G-5: failure class of each attempt."""
    a = fx.llm_attempts(t)
    return a.select("call_id", "attempt",
                    F.when(F.col("succeeded"), "SUCCESS").otherwise(rn.failure_status()).alias("status"))


@query("call_outcome", """
select call_id, count(*) as n_attempts,
       case when min(attempt) filter (where succeeded) is null then 'FAILED'
            when min(attempt) filter (where succeeded) = 1 then 'PRIMARY' else 'FALLBACK' end as outcome,
       arg_min(model, attempt) filter (where succeeded) as model,
       arg_min(output_tokens, attempt) filter (where succeeded) as output_tokens,
       case when min(attempt) filter (where succeeded) is null then arg_max(error_message, attempt) end
         as error_message
from llm_attempts group by call_id""", ("llm_attempts",))
def q_call_outcome(t: Tables):
    """G-7: primary/fallback outcome per call."""
    return rn.call_outcome(fx.llm_attempts(t))


@query("run_list", "select tenant_id, run_id, agent_name, status, created_at from agent_runs", ("agent_runs",))
def q_run_list(t: Tables):
    """Q-7: each tenant's runs in time order."""
    return fx.agent_runs(t).select("tenant_id", "run_id", "agent_name", "status", "created_at") \
        .orderBy("tenant_id", "created_at", "run_id")
