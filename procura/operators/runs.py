"""Run log, cost, call outcome and telemetry (S-7, G-5, G-6, G-7, J-10, A-1).

The reference writes one row per model call and aggregates them later; here
a batch of attempts is a DataFrame and every derived field is a column.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# USD per 1M tokens (input, output) by model; unknown model costs 0.
PRIMARY_MODEL = "llama-3.3-70b-versatile"
FALLBACK_MODEL = "models/gemini-flash-latest"
COST_PER_1M_TOKENS = {
    PRIMARY_MODEL: (Decimal("0.59"), Decimal("0.79")),
    FALLBACK_MODEL: (Decimal("0.075"), Decimal("0.30")),
}
COST = "decimal(18,6)"


def rate_table(spark: SparkSession, rates: dict | None = None) -> DataFrame:
    """Per-token prices as a small table (one row per model; bounded by the rate card)."""
    rates = COST_PER_1M_TOKENS if rates is None else rates
    rows = [(m, Decimal(i) / Decimal(1_000_000), Decimal(o) / Decimal(1_000_000))
            for m, (i, o) in rates.items()]
    return spark.createDataFrame(rows, "model string, in_rate decimal(20,12), out_rate decimal(20,12)")


def with_cost(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """G-6 / J-10: ``estimated_cost_usd`` = tokens x per-token rates, 6 dp; unknown model 0.

    The rate card is a fixed handful of rows, so it is broadcast."""
    r = F.broadcast(rates)
    cost = F.round(F.coalesce(F.col("input_tokens"), F.lit(0)) * F.col("in_rate")
                   + F.coalesce(F.col("output_tokens"), F.lit(0)) * F.col("out_rate"), 6)
    return runs.join(r, "model", "left").withColumn(
        "estimated_cost_usd",
        F.when(F.col("in_rate").isNull(), F.lit(0).cast(COST)).otherwise(cost).cast(COST)) \
        .drop("in_rate", "out_rate")


def failure_status(error_text_col: str = "error_message"):
    """G-5: a failed call is RATE_LIMITED when its error mentions 429, else ERROR."""
    return F.when(F.col(error_text_col).contains("429"), "RATE_LIMITED").otherwise("ERROR")


def run_log_rows(attempts: DataFrame, rates: DataFrame) -> DataFrame:
    """S-7: agent_runs rows for a batch of attempts, the agent logged as ``agent:model``.

    ``attempts`` has tenant_id, run_id, agent_name, model, input_tokens,
    output_tokens, latency_ms, status, error_message, created_at."""
    return with_cost(attempts, rates).select(
        "tenant_id", F.concat_ws(":", "agent_name", "model").alias("agent_name"), "run_id",
        "input_tokens", "output_tokens", "estimated_cost_usd", "latency_ms", "status",
        "error_message", "created_at")


def telemetry(runs: DataFrame) -> DataFrame:
    """A-1: per tenant and agent: calls, successes, errors (status containing ERROR or
    BLOCKED; RATE_LIMITED is neither), rounded mean latency, total cost."""
    st = F.col("status")
    return runs.groupBy("tenant_id", "agent_name").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.count_if(st == "SUCCESS").alias("success_count"),
        F.count_if(st.contains("ERROR") | st.contains("BLOCKED")).alias("error_count"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).cast("bigint").alias("avg_latency_ms"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)), 6).cast(COST).alias("total_cost_usd"),
    ).orderBy("tenant_id", F.col("call_count").desc(), "agent_name")


def call_outcome(attempts: DataFrame) -> DataFrame:
    """G-7: per call, the first successful attempt wins (primary before fallback);
    with no success the call failed with the last attempt's error.

    ``attempts``: call_id, attempt, model, succeeded, error_message, input/output tokens."""
    ok_order = F.when(F.col("succeeded"), F.col("attempt"))
    win = F.struct("attempt", "model", "input_tokens", "output_tokens")
    g = attempts.groupBy("call_id").agg(
        F.min(ok_order).alias("won_attempt"),
        F.min_by(win, ok_order).alias("w"),
        F.max_by("error_message", "attempt").alias("last_error"),
        F.count(F.lit(1)).alias("n_attempts"))
    return g.select(
        "call_id", "n_attempts",
        F.when(F.col("won_attempt").isNull(), "FAILED")
         .when(F.col("won_attempt") == 1, "PRIMARY").otherwise("FALLBACK").alias("outcome"),
        F.when(F.col("won_attempt").isNotNull(), F.col("w.model")).alias("model"),
        F.when(F.col("won_attempt").isNotNull(), F.col("w.output_tokens")).alias("output_tokens"),
        F.when(F.col("won_attempt").isNull(), F.col("last_error")).alias("error_message"))
