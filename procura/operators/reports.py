"""Report queries over reconciliation results (Q-1 .. Q-7, A-4 .. A-8, F-2, J-2, J-5).

Per-tenant top-k uses ``row_number() <= k`` over a tenant window, which
Spark plans as a WindowGroupLimit: each task keeps only its k best rows per
tenant before the shuffle, so a hot tenant never moves whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_FLAGGED_LIMIT = 10
PLACEHOLDER = "—"  # shown for NULL values in the dashboard table


def parse_limit(limit, default: int = DEFAULT_FLAGGED_LIMIT) -> int:
    """The tool takes the limit as text; anything that is not an integer means the default."""
    try:
        return int(limit)
    except (TypeError, ValueError):
        return default


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _with_supplier(results: DataFrame, suppliers: DataFrame) -> DataFrame:
    # Suppliers grow with the data: no hint, AQE broadcasts it when measured small.
    s = suppliers.select("tenant_id", "supplier_id", F.col("name").alias("supplier_name"))
    return results.join(s, ["tenant_id", "supplier_id"], "inner")


def _result_order() -> list[Column]:
    return [F.col("detected_at").desc_nulls_last(), F.col("invoice_id").asc(),
            F.col("check_type").asc(), F.col("expected_value").asc_nulls_first()]


def flagged_invoices(results: DataFrame, suppliers: DataFrame, limit="10") -> DataFrame:
    """Q-1 / Q-3: newest ``limit`` flagged result rows per tenant with supplier name.

    Result rows exist only for flagged invoices, so the status filter of the
    reference holds by construction."""
    k = parse_limit(limit)
    rows = _with_supplier(results, suppliers).select(
        "tenant_id", F.col("invoice_id").alias("invoice_number"), "invoice_id", "supplier_id",
        "supplier_name", "check_type", "expected_value", "actual_value", "severity", "detected_at")
    return top_k_per(rows, ["tenant_id"], _result_order(), max(k, 0)).drop("invoice_id")


def flagged_report(results: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Q-2 / F-7: every result row with variance; NULLs shown as a placeholder.
    :func:`in_report_order` sorts what a reader is shown; the rows themselves need no global sort."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(PLACEHOLDER))
    return _with_supplier(results, suppliers).select(
        "tenant_id", F.col("invoice_id").alias("invoice_number"), "supplier_name", "check_type",
        "expected_value", "actual_value", "variance_amount", "severity", "detected_at",
        shown("expected_value").alias("expected_shown"), shown("actual_value").alias("actual_shown"))


def in_report_order(report: DataFrame) -> DataFrame:
    """Q-2: by tenant, severity, newest first. Severity orders as text (MEDIUM, LOW, HIGH descending),
    as in the reference."""
    return report.orderBy("tenant_id", F.col("severity").desc(), F.col("detected_at").desc(), "invoice_number")


def supplier_search(suppliers: DataFrame, contracts: DataFrame, term: str) -> DataFrame:
    """Q-5 / F-2 / J-5: first supplier per tenant whose name contains ``term`` (case-insensitive;
    ``%`` and ``_`` in the term act as wildcards), with one row per contract labelled
    ``"<number> (<status>)"`` or ``none``.

    The contract list stays as rows rather than one joined string, so a
    supplier with very many contracts is never gathered into a single value."""
    hits = suppliers.where(F.col("name").ilike(f"%{term}%"))
    first = hits.groupBy("tenant_id").agg(F.min("supplier_id").alias("supplier_id"))
    profile = suppliers.join(first, ["tenant_id", "supplier_id"], "left_semi")
    c = contracts.select("tenant_id", "supplier_id", "contract_number", "status")
    return profile.join(c, ["tenant_id", "supplier_id"], "left").select(
        "tenant_id", "supplier_id", "name", "category", "risk_score",
        F.when(F.col("contract_number").isNull(), F.lit("none"))
         .otherwise(F.format_string("%s (%s)", F.col("contract_number"), F.col("status")))
         .alias("contract_label"))


def tenant_list(tenants: DataFrame) -> DataFrame:
    """Q-7: tenants by name."""
    return tenants.select("tenant_id", "name").orderBy("name", "tenant_id")


def supplier_list(suppliers: DataFrame) -> DataFrame:
    """Q-7: suppliers of each tenant by name."""
    return suppliers.select("tenant_id", "supplier_id", "name").orderBy("tenant_id", "name", "supplier_id")


def tenant_table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A-4: per-tenant row counts of several tables in one aggregation.

    The tables are tagged and unioned, then counted with one conditional
    count per table: a single partial aggregation and shuffle."""
    tagged = None
    for name, df in tables.items():
        part = df.select("tenant_id", F.lit(name).alias("_table"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("tenant_id").agg(
        *[F.count_if(F.col("_table") == name).alias(f"n_{name}") for name in tables])


def purchase_orders(invoices: DataFrame) -> DataFrame:
    """Distinct purchase orders referenced by invoices."""
    return invoices.where(F.col("po_id").isNotNull()).select("tenant_id", "po_id").distinct()


def supplier_spend(invoices: DataFrame, k: int = 5) -> DataFrame:
    """A-5: top-k suppliers per tenant by total invoiced amount."""
    spend = invoices.groupBy("tenant_id", "supplier_id").agg(
        F.sum("total_amount").cast("decimal(38,5)").alias("total_spend"))
    return top_k_per(spend, ["tenant_id"], [F.col("total_spend").desc(), F.col("supplier_id")], k)


def flagged_count(status: DataFrame) -> DataFrame:
    """A-6: LEAKAGE_DETECTED invoices per tenant."""
    return status.where(F.col("reconciliation_status") == "LEAKAGE_DETECTED") \
        .groupBy("tenant_id").agg(F.count(F.lit(1)).alias("flagged_count"))


def variance_by_severity(results: DataFrame) -> DataFrame:
    """A-7: average variance amount by tenant and severity (exact decimal sum, then divided)."""
    return results.groupBy("tenant_id", "severity").agg(
        F.round(F.try_divide(F.sum("variance_amount").cast("double"), F.count("variance_amount")), 4)
        .alias("avg_variance"),
        F.count("variance_amount").alias("n_with_variance"))


def supplier_count(suppliers: DataFrame) -> DataFrame:
    """A-8: suppliers per tenant."""
    return suppliers.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("supplier_count"))
