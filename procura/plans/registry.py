"""Named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from .oracles import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``.

    ``oracle`` is the DuckDB body; it is prefixed with the fixture CTEs."""
    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE_SQL[name] = with_fixtures(list(fixtures), oracle)
        return fn
    return deco
