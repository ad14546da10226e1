"""Reconciliation rules (C-1 .. C-8): invoices against contracted prices and POs.

All tenants run in one plan; ``tenant_id`` is part of every join and
grouping key, so a natural key never matches across tenants.

Plan shape at scale:
* contract match: one equi-join on (tenant, supplier, sku). contract_items
  grows with the data, so no hint: AQE broadcasts it when measured small,
  else sort-merge with skew splitting of a hot key on the invoice side.
* duplicate PO: a grouped count (map-side partial aggregation absorbs a hot
  PO), then a semi-join of invoices to the keys with count > 1. Nothing is
  collected per PO.
* final status: invoices left-joined to the distinct flagged ids; both
  shuffles are keyed by invoice id, which is uniform.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rule (must equal the reference's behaviour).
PRICE_VARIANCE_THRESHOLD = Decimal("0.05")  # flagged when variance is strictly above
HIGH_SEVERITY_THRESHOLD = Decimal("0.15")   # HIGH when strictly above, else MEDIUM

MONEY = "decimal(18,5)"
MATCH_KEYS = ["tenant_id", "supplier_id", "item_sku"]
RESULT_COLUMNS = ["tenant_id", "invoice_id", "supplier_id", "check_type", "expected_value",
                  "actual_value", "variance_amount", "severity", "detected_at"]


def _ratio_exceeds(invoiced: Column, agreed: Column, ratio: Decimal) -> Column:
    """``(invoiced - agreed) / agreed > ratio`` evaluated without a division.

    A decimal quotient is rounded to a fixed scale, which can move a value
    sitting on the threshold; multiplying keeps it exact. Agreed = 0 means a
    variance of 0 (never flagged)."""
    r = F.lit(ratio).cast("decimal(10,4)")
    diff = invoiced - agreed
    return (F.when(agreed > 0, diff > agreed * r)
            .when(agreed < 0, diff < agreed * r)
            .otherwise(F.lit(False)))


def active_items(contract_items: DataFrame) -> DataFrame:
    """Active contract items only (filter before the outer join, as the ON clause does)."""
    return contract_items.where(F.col("is_active")) \
        .select(*MATCH_KEYS, F.col("agreed_unit_price").cast(MONEY).alias("agreed_unit_price"))


def contract_match(invoices: DataFrame, contract_items: DataFrame) -> DataFrame:
    """C-1 / J-1: each invoice with every active item of its (tenant, supplier, sku).

    Several active items fan out to several rows; NULL keys never match."""
    inv = invoices.select("tenant_id", "invoice_id", *MATCH_KEYS[1:],
                          F.col("invoice_unit_price").cast(MONEY).alias("invoice_unit_price"),
                          F.col("invoice_date"))
    return inv.join(active_items(contract_items), MATCH_KEYS, "left")


def _detected_at() -> Column:
    # Stand-in for the database default timestamp of a result row.
    return F.col("invoice_date").cast("timestamp_ntz").alias("detected_at")


def price_and_contract(invoices: DataFrame, contract_items: DataFrame,
                       threshold: Decimal = PRICE_VARIANCE_THRESHOLD,
                       high: Decimal = HIGH_SEVERITY_THRESHOLD) -> DataFrame:
    """C-2, C-3, C-4 in one pass over the match: MISSING_CONTRACT and PRICE_VARIANCE rows."""
    m = contract_match(invoices, contract_items)
    agreed, invoiced = F.col("agreed_unit_price"), F.col("invoice_unit_price")
    missing = agreed.isNull()
    over = _ratio_exceeds(invoiced, agreed, threshold)
    check = F.when(missing, "MISSING_CONTRACT").when(over, "PRICE_VARIANCE")
    return m.select(
        "tenant_id", "invoice_id", "supplier_id",
        check.alias("check_type"),
        F.when(missing, F.lit(None)).otherwise(agreed).cast(MONEY).alias("expected_value"),
        invoiced.cast(MONEY).alias("actual_value"),
        F.when(missing, F.lit(None)).otherwise(invoiced - agreed).cast(MONEY).alias("variance_amount"),
        F.when(missing, "HIGH").when(_ratio_exceeds(invoiced, agreed, high), "HIGH")
         .otherwise("MEDIUM").alias("severity"),
        _detected_at(),
    ).where(F.col("check_type").isNotNull())


def missing_contract(invoices: DataFrame, contract_items: DataFrame) -> DataFrame:
    """C-2 alone."""
    return price_and_contract(invoices, contract_items).where(F.col("check_type") == "MISSING_CONTRACT")


def price_variance(invoices: DataFrame, contract_items: DataFrame,
                   threshold: Decimal = PRICE_VARIANCE_THRESHOLD) -> DataFrame:
    """C-3 / C-4 alone."""
    return price_and_contract(invoices, contract_items, threshold) \
        .where(F.col("check_type") == "PRICE_VARIANCE")


def duplicate_po_groups(invoices: DataFrame) -> DataFrame:
    """C-5b / A-3: (tenant, po_id) keys shared by more than one invoice, with their size.

    The reference returns ``array_agg(id)`` per PO; a hot PO would put an
    unbounded list in one row, so the members stay as rows (see
    :func:`duplicate_po_members`)."""
    return invoices.where(F.col("po_id").isNotNull()) \
        .groupBy("tenant_id", "po_id").agg(F.count(F.lit(1)).alias("n_invoices")) \
        .where(F.col("n_invoices") > 1)


def duplicate_po_members(invoices: DataFrame) -> DataFrame:
    """Every invoice of a duplicated PO, one row each, with the group size."""
    groups = duplicate_po_groups(invoices)
    return invoices.select("tenant_id", "po_id", "invoice_id") \
        .join(groups, ["tenant_id", "po_id"], "inner")


def duplicate_po(invoices: DataFrame) -> DataFrame:
    """C-5: a DUPLICATE_PO HIGH row for each invoice sharing a non-null PO in its tenant."""
    keys = duplicate_po_groups(invoices).select("tenant_id", "po_id")
    null_money = F.lit(None).cast(MONEY)
    return invoices.join(keys, ["tenant_id", "po_id"], "left_semi").select(
        "tenant_id", "invoice_id", "supplier_id",
        F.lit("DUPLICATE_PO").alias("check_type"),
        null_money.alias("expected_value"), null_money.alias("actual_value"),
        null_money.alias("variance_amount"), F.lit("HIGH").alias("severity"),
        _detected_at(),
    )


def reconcile(invoices: DataFrame, contract_items: DataFrame) -> DataFrame:
    """C-7 / U-2: every result row of a full run for all tenants."""
    return price_and_contract(invoices, contract_items).select(*RESULT_COLUMNS) \
        .unionByName(duplicate_po(invoices).select(*RESULT_COLUMNS))


def flagged_ids(results: DataFrame) -> DataFrame:
    """U-1: distinct flagged (tenant, invoice) pairs over all rules."""
    return results.select("tenant_id", "invoice_id").distinct()


def invoice_status(invoices: DataFrame, results: DataFrame) -> DataFrame:
    """C-6 / S-10 / J-12: LEAKAGE_DETECTED if any rule fired, else APPROVED, for every invoice."""
    flagged = flagged_ids(results).withColumn("_flagged", F.lit(True))
    return invoices.select("tenant_id", "invoice_id", "supplier_id") \
        .join(flagged, ["tenant_id", "invoice_id"], "left") \
        .select("tenant_id", "invoice_id", "supplier_id",
                F.when(F.col("_flagged"), "LEAKAGE_DETECTED").otherwise("APPROVED")
                .alias("reconciliation_status"))


def flagged_per_tenant(status: DataFrame, tenants: DataFrame) -> DataFrame:
    """C-8 / A-2: distinct flagged invoices per tenant, zero for tenants without any.

    Counted from the per-invoice status (one row per invoice), so it is a plain
    partial aggregation rather than a distinct aggregation."""
    counts = status.groupBy("tenant_id").agg(
        F.count_if(F.col("reconciliation_status") == "LEAKAGE_DETECTED").alias("flagged_count"))
    return F.broadcast(tenants.select("tenant_id", "name")).join(counts, "tenant_id", "left") \
        .select("tenant_id", "name", F.coalesce("flagged_count", F.lit(0)).cast("bigint")
                .alias("flagged_count"))
