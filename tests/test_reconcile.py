"""Reconciliation rules on the hand-made boundary table (FIXTURES.md §4)."""

from decimal import Decimal

import pytest

from procura.operators import reconcile as rc
from procura.operators.scope import scope

INV = ("invoice_id string, tenant_id int, supplier_id bigint, po_id string, item_sku bigint, "
       "invoice_unit_price decimal(18,5), invoice_date date")
CI = "tenant_id int, supplier_id bigint, item_sku bigint, agreed_unit_price decimal(18,5), is_active boolean"


def _run(spark, invoices, items):
    inv = spark.createDataFrame(invoices, INV)
    ci = spark.createDataFrame(items, CI)
    return sorted((r.invoice_id, r.check_type, r.severity, r.expected_value)
                  for r in rc.reconcile(inv, ci).collect())


def _inv(iid, price, po=None, tenant=1, sku=1):
    return (iid, tenant, 10, po, sku, Decimal(str(price)), None)


def _item(price, active=True, tenant=1, sku=1):
    return (tenant, 10, sku, Decimal(str(price)), active)


@pytest.mark.parametrize("invoiced,expected", [
    (105, []),
    (105.01, [("PRICE_VARIANCE", "MEDIUM")]),
    (115, [("PRICE_VARIANCE", "MEDIUM")]),
    (115.01, [("PRICE_VARIANCE", "HIGH")]),
    (80, []),
])
def test_price_thresholds_are_strict(spark, invoiced, expected):
    got = _run(spark, [_inv("a", invoiced)], [_item(100)])
    assert [(c, s) for _, c, s, _ in got] == expected


def test_zero_agreed_price_never_flags(spark):
    assert _run(spark, [_inv("a", 50)], [_item(0)]) == []


def test_inactive_item_is_missing_contract(spark):
    got = _run(spark, [_inv("a", 100)], [_item(100, active=False)])
    assert got == [("a", "MISSING_CONTRACT", "HIGH", None)]


def test_fan_out_over_two_active_items(spark):
    got = _run(spark, [_inv("a", 100)], [_item(100), _item(90)])
    assert got == [("a", "PRICE_VARIANCE", "MEDIUM", Decimal("90.00000"))]
    got = _run(spark, [_inv("a", 100)], [_item(80), _item(90)])
    assert [(c, s) for _, c, s, _ in got] == [("PRICE_VARIANCE", "HIGH"), ("PRICE_VARIANCE", "MEDIUM")]


def test_flagged_count_is_distinct(spark):
    inv = spark.createDataFrame([_inv("a", 100)], INV)
    ci = spark.createDataFrame([_item(80), _item(90)], CI)
    status = rc.invoice_status(inv, rc.reconcile(inv, ci))
    tenants = spark.createDataFrame([(1, "t1"), (2, "t2")], "tenant_id int, name string")
    got = {r.tenant_id: r.flagged_count for r in rc.flagged_per_tenant(status, tenants).collect()}
    assert got == {1: 1, 2: 0}


def test_duplicate_po_rules(spark):
    invoices = [_inv("n1", 100), _inv("n2", 100),                      # NULL po twice: nothing
                _inv("x1", 100, po="P", tenant=1), _inv("x2", 100, po="P", tenant=2),  # other tenant
                _inv("d1", 120, po="Q"), _inv("d2", 100, po="Q")]
    items = [_item(100), _item(100, tenant=2)]
    got = _run(spark, invoices, items)
    assert ("d1", "DUPLICATE_PO", "HIGH", None) in got
    assert ("d2", "DUPLICATE_PO", "HIGH", None) in got
    assert ("d1", "PRICE_VARIANCE", "HIGH", Decimal("100.00000")) in got
    assert not [g for g in got if g[0] in ("n1", "n2", "x1", "x2")]


def test_tenant_scope_isolates_and_fails_closed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "tenant_id int, name string")
    assert [r.name for r in scope(df, 1).collect()] == ["a"]
    assert scope(df, None).count() == 0


def test_metrics_of_rows_labelled_once_equal_the_separate_ones(spark):
    from procura.operators import evals as ev
    labels = spark.createDataFrame(
        [(0, "a", "LEAKAGE_DETECTED", "DUPLICATE_PO"), (0, "b", "LEAKAGE_DETECTED", "PRICE_VARIANCE"),
         (1, "a", "APPROVED", None), (1, "c", "AMBIGUOUS", None), (None, "d", "LEAKAGE_DETECTED", None)],
        "tenant_id int, invoice_id string, expected_status string, expected_check_type string")
    status = spark.createDataFrame([(0, "a", "LEAKAGE_DETECTED"), (0, "b", "LEAKAGE_DETECTED"), (1, "a", "LEAKAGE_DETECTED")],
                                   "tenant_id int, invoice_id string, reconciliation_status string")
    found = spark.createDataFrame([(0, "a", "DUPLICATE_PO"), (0, "b", "DUPLICATE_PO")],
                                  "tenant_id int, invoice_id string, check_type string")
    judged = ev.labelled(labels, status)
    assert ev.confusion_counts(judged).collect() == ev.confusion(labels, status).collect() == [(2, 1, 0, 1, 1)]
    assert ev.type_accuracy(judged, found).collect() == ev.check_type_accuracy(labels, status, found).collect() == [(1, 2, 0.5)]
