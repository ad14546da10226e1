"""Imports every query module so the registry is complete."""

from . import q_audit, q_conv, q_evals, q_guards, q_reconcile, q_reports, q_runs, q_search, q_cache, q_replies, q_report, q_sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
