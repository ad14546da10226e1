"""Incremental run-log ingestion with Structured Streaming (S-7 as a stream).

Model-call attempts land as JSON files; each micro-batch gets its cost from
the broadcast rate card (a stream-static join; the card has one row per
priced model) and is appended to the run-log table partitioned by tenant.
The query's progress lives in a checkpoint location under the shared
checkpoint folder, so a restarted or failed job resumes without duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.runs import rate_table, run_log_rows
from ..session import shared_path

ATTEMPT_SCHEMA = ("tenant_id int, run_id string, agent_name string, model string, input_tokens int, "
                  "output_tokens int, latency_ms int, status string, error_message string, created_at timestamp")


def run_log_stream(spark: SparkSession, source_dir: str, rates: dict | None = None) -> DataFrame:
    """Streaming frame of run-log rows from JSON attempt files in ``source_dir``."""
    attempts = spark.readStream.schema(ATTEMPT_SCHEMA).json(source_dir)
    return run_log_rows(attempts, rate_table(spark, rates))


def ingest_run_logs(spark: SparkSession, source_dir: str, table_path: str, name: str = "run_log",
                    rates: dict | None = None, available_now: bool = True,
                    checkpoint_location: str | None = None):
    """Append new attempt files to the run-log table; returns the started query.

    The progress checkpoint defaults to ``streams/<name>`` in the shared
    checkpoint folder (stable, so a restart resumes). ``available_now``
    processes everything present and stops (batch-style scheduling with
    streaming bookkeeping); otherwise it runs continuously."""
    checkpoint = checkpoint_location or shared_path(spark, f"streams/{name}")
    writer = run_log_stream(spark, source_dir, rates).writeStream.format("parquet") \
        .option("checkpointLocation", checkpoint).partitionBy("tenant_id").outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(table_path)
