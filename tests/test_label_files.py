"""The JSON readers on whole label files: nested ground truth and the golden sections."""

import json

from pyspark.sql import functions as F

from procura.sources import files as fl

KINDS = [("APPROVED", None, 24), ("LEAKAGE_DETECTED", "PRICE_VARIANCE", 8), ("LEAKAGE_DETECTED", "DUPLICATE_PO", 4),
         ("LEAKAGE_DETECTED", "MISSING_CONTRACT", 2), ("AMBIGUOUS", None, 2)]


def test_ground_truth_file(spark, tmp_path):
    tenants = []
    for t in ("t1", "t2"):
        labels = [{"invoice_number": f"{status}-{check}-{i}", "expected_status": status,
                   **({"check_type": check, "expected_agreed_price": 10.0, "expected_invoiced_price": 12.5} if check else {}),
                   **({"note": "either way"} if status == "AMBIGUOUS" else {"reason": "planted"})}
                  for status, check, n in KINDS for i in range(n)]
        tenants.append({"tenant_id": t, "tenant_name": t.upper(), "tenant_label": t, "invoices": labels})
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"tenants": tenants}, indent=1))
    gt = fl.read_ground_truth(spark, str(path))
    assert gt.count() == 80 and gt.select("tenant_id", "invoice_number").distinct().count() == 80
    by = {(r.expected_status, r.check_type): r.n for r in
          gt.groupBy("expected_status", "check_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {(status, check): 2 * n for status, check, n in KINDS}
    assert gt.where("check_type is not null and expected_invoiced_price = 12.5").count() == 28
    assert gt.where("note = 'either way' and reason is null").count() == 4


def test_golden_file(spark, tmp_path):
    golden = {
        "contracts": [{"file": f"c{i}.pdf", "expected": {"contract_number": f"CON-{i}", "items": [
            {"item_sku": f"K{i}{j}", "agreed_unit_price": 5.25} for j in range(n)]}} for i, n in enumerate((2, 1, 1))],
        "invoices": [{"file": f"i{i}.txt", "expected": {"invoice_number": f"I{i}", "quantity_billed": 3,
                                                        "invoice_unit_price": 2.5, "total_amount": 7.5}} for i in range(2)],
        "citation_questions": [{"question": f"q{i}?", "expected_contract": "CON-1", "expected_page": i} for i in range(3)]}
    path = tmp_path / "golden.json"
    path.write_text(json.dumps(golden, indent=1))
    g = fl.read_golden(spark, str(path))
    assert {k: v.count() for k, v in g.items()} == {"contracts": 3, "invoices": 2, "citation_questions": 3}
    assert g["contracts"].select(F.explode("items").alias("i")).where("i.agreed_unit_price = 5.25").count() == 4
    assert sorted((r.invoice_number, r.total_amount) for r in g["invoices"].collect()) == [("I0", 7.5), ("I1", 7.5)]
    assert sorted(r.expected_page for r in g["citation_questions"].collect()) == [0, 1, 2]
