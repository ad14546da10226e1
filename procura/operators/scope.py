"""Tenant scope (S-2): a tenant sees only its rows; no tenant means no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope(df: DataFrame, tenant_id) -> DataFrame:
    """Filter to one tenant; fail closed (zero rows) when ``tenant_id`` is None.

    The predicate is on a plain column, so it reaches the Parquet scan as a
    pushed filter, and prunes partitions when tables are stored by tenant."""
    if tenant_id is None:
        return df.where(F.lit(False))
    return df.where(F.col("tenant_id") == F.lit(tenant_id))


def scoped_views(spark, tables: dict[str, DataFrame], tenant_id, prefix: str = "") -> list[str]:
    """Register each frame, scoped to the tenant, as a temp view; returns the view names."""
    names = []
    for name, df in tables.items():
        view = f"{prefix}{name}"
        scope(df, tenant_id).createOrReplaceTempView(view)
        names.append(view)
    return names
