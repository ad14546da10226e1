"""Streaming run-log ingestion: exactly-once appends across restarts."""

import json

from procura.operators.runs import PRIMARY_MODEL
from procura.streaming.run_log import ingest_run_logs


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_appends_each_file_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    out = str(tmp_path / "runs")
    row = {"tenant_id": 1, "run_id": "r1", "agent_name": "sup", "model": PRIMARY_MODEL, "input_tokens": 1000,
           "output_tokens": 2000, "latency_ms": 5, "status": "SUCCESS", "created_at": "2026-01-01T00:00:00"}
    _write(src / "a.json", [row, {**row, "run_id": "r2", "tenant_id": 2, "model": "other"}])
    ckpt = str(tmp_path / "progress")
    ingest_run_logs(spark, str(src), out, checkpoint_location=ckpt).awaitTermination()
    _write(src / "b.json", [{**row, "run_id": "r3"}])
    ingest_run_logs(spark, str(src), out, checkpoint_location=ckpt).awaitTermination()
    ingest_run_logs(spark, str(src), out, checkpoint_location=ckpt).awaitTermination()
    got = {r.run_id: (r.tenant_id, str(r.estimated_cost_usd), r.agent_name) for r in spark.read.parquet(out).collect()}
    assert got == {"r1": (1, "0.002170", f"sup:{PRIMARY_MODEL}"), "r2": (2, "0.000000", "sup:other"),
                   "r3": (1, "0.002170", f"sup:{PRIMARY_MODEL}")}
