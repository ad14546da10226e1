"""Replies, audit, runs, conversations and sources."""

import json

from pyspark.sql import functions as F

from procura.operators import audit as au
from procura.operators import replies as rp
from procura.operators import runs as rn
from procura.operators.conversation import conversation_tail, route_label
from procura.sources import files as fl
from procura.sources import sinks as sk


def _inv_json(**over):
    base = {"invoice_number": "A1", "supplier_name": "S", "item_sku": "K", "quantity_billed": 10,
            "invoice_unit_price": 450.0, "total_amount": 4500.0, "invoice_date": "2026-08-01"}
    base.update(over)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


def test_invoice_validation_rules(spark):
    cases = {
        "ok": (_inv_json(), []),
        "string_qty": (_inv_json(quantity_billed="10"), []),
        "within_1": (_inv_json(total_amount=4500.9), []),
        "bad_json": ("not json", ["invalid_json"]),
        "array": ("[1, 2]", ["invalid_json"]),
        "array_of_object": ("[" + _inv_json() + "]", ["invalid_json"]),
        "cut_short": (_inv_json()[:-1], ["invalid_json"]),
        "single_quotes": (_inv_json().replace('"', "'"), ["invalid_json"]),
        "bare_nan": (_inv_json().replace("450.0", "NaN"), ["invalid_json"]),
        "none": (None, ["invalid_json"]),
        "frac_qty": (_inv_json(quantity_billed=10.5), ["quantity_not_positive_int"]),
        "zero_price": (_inv_json(invoice_unit_price=0, total_amount=1), ["price_not_positive"]),
        "mismatch": (_inv_json(total_amount=4600), ["total_mismatch"]),
        "no_sku": (_inv_json(item_sku=...), ["missing_item_sku"]),
        "bad_date": (_inv_json(invoice_date="01/08/2026"), ["date_not_iso"]),
    }
    df = spark.createDataFrame([(k, 7, 1, v[0]) for k, v in cases.items()],
                               "doc_id string, tenant_id int, attempt int, raw_json string")
    got = {r.doc_id: r for r in rp.validate_invoices(df).collect()}
    for k, (_, errors) in cases.items():
        assert got[k].errors == errors, k
        assert got[k].is_valid == (not errors)
        assert got[k].tenant_id == 7
    assert got["string_qty"].quantity_billed == 10


def test_attempt_outcome_and_log(spark):
    rows = [("d1", "r1", 1, 0, False), ("d1", "r2", 2, 0, True), ("d1", "r3", 3, 0, True),
            ("d2", "r4", 1, 0, False), ("d2", "r5", 2, 0, False), ("d2", "r6", 4, 0, True)]
    df = spark.createDataFrame(rows, "doc string, doc_id string, attempt int, tenant_id int, is_valid boolean") \
        .withColumn("errors", F.when(F.col("is_valid"), F.array().cast("array<string>"))
                    .otherwise(F.array(F.concat(F.lit("bad "), F.col("doc_id")))))
    out = {r.doc: r for r in rp.attempt_outcome(df, "doc").collect()}
    assert (out["d1"].status, out["d1"].won_attempt, out["d1"].won_row) == ("SUCCESS", 2, "r2")
    assert (out["d2"].status, out["d2"].error_message) == ("FAILED", "bad r5")
    log = sorted((r.doc, r.attempt, r.status) for r in rp.attempt_log(df, "doc", "invoice").collect())
    assert log == [("d1", 1, "ERROR"), ("d1", 2, "SUCCESS"), ("d2", 1, "ERROR"), ("d2", 2, "ERROR")]


def test_judge_fences(spark):
    df = spark.createDataFrame([(1, '```json\n{"professional_tone": 5, "factually_grounded": 4, '
                                    '"clearly_states_approval_needed": true, "reasoning": "ok"}\n```'),
                                (2, '{"professional_tone": 6, "factually_grounded": 4, '
                                    '"clearly_states_approval_needed": true, "reasoning": "x"}')],
                               "id int, raw_reply string")
    got = {r.id: r for r in rp.validate_judgments(df).collect()}
    assert got[1].is_valid and got[1].professional_tone == 5
    assert got[2].errors == ["professional_tone_out_of_range"]


def test_invoice_fields_layouts(spark):
    texts = [(1, "Invoice ID: ACME-2026-9811   Date: 2026-08-01\nItem SKU: LOG-DIS-01   Qty: 10   "
                 "Unit Price: 450.00 INR\nTotal Balance Due: 4500.00 INR"),
             (2, "*** APEX ***\nInv# APX-99821-X    dated  28/07/2026\nSKU PKG-BOX-XL ..... qty=500 ..... "
                 "@ 42.00 INR each\nTOTAL: Rs. 21,000.00"),
             (3, "Reference No: GLX-2026-0456\nDate: 03-08-2026\nFRT-SEA-20 x 2 units, unit rate 12500.00 INR\n"
                 "Grand Total = 25000.00 INR")]
    got = {r.id: r for r in rp.invoice_fields(spark.createDataFrame(texts, "id int, invoice_text string")).collect()}
    assert (got[1].invoice_number, got[1].quantity_billed, str(got[1].total_amount)) == ("ACME-2026-9811", 10, "4500.00")
    assert (got[2].invoice_number, str(got[2].invoice_date), str(got[2].total_amount)) == ("APX-99821-X", "2026-07-28", "21000.00")
    assert (got[3].item_sku, got[3].date_ambiguous, got[3].invoice_date) == ("FRT-SEA-20", True, None)


def test_audit_rows_and_lifecycle(spark):
    d = spark.createDataFrame([(1, 10, "draft a", None, "approve"), (1, 11, "draft b", "b2", "edit"),
                               (1, 12, "draft c", "c2", "reject"), (1, 13, "draft d", None, None),
                               (1, 14, "draft e", None, "maybe")],
                              "tenant_id int, entity_id long, original_text string, edited_text string, action string")
    rows = {(r.entity_id, r.action): r for r in au.audit_rows(d).collect()}
    import hashlib
    assert rows[(10, "APPROVED")].content_hash == hashlib.sha256(b"draft a").hexdigest()
    assert rows[(11, "EDITED")].edited_payload == '{"text":"b2"}' and rows[(11, "EDITED")].changed
    assert rows[(12, "REJECTED")].content_hash == hashlib.sha256(b"c2").hexdigest()
    assert rows[(12, "REJECTED")].actor == "unknown_reviewer"
    assert (14, "REJECTED") in rows and (13, "DRAFTED") in rows and len(rows) == 9
    states = {r.entity_id: r.state for r in au.approval_lifecycle(au.audit_rows(d)).collect()}
    assert states == {10: "DECIDED", 11: "DECIDED", 12: "DECIDED", 13: "PENDING", 14: "DECIDED"}


def test_line_changes_counts(spark):
    d = spark.createDataFrame([(1, 1, "a\nb\nb\nc\n", "a\nb\nc\nd")],
                              "tenant_id int, entity_id int, original_text string, edited_text string")
    got = {(r.line, r.n_removed, r.n_added) for r in au.line_changes(d).collect()}
    assert got == {("b", 1, 0), ("d", 0, 1)}


def _apply(original, diff):
    """The edit, rebuilt from the original's lines and a diff."""
    lines = original.splitlines()
    removed = {d.line_no for d in diff if d.sign == "-"}
    assert [lines[d.line_no - 1] for d in diff if d.sign == "-"] == [d.line for d in diff if d.sign == "-"]
    rest = [x for i, x in enumerate(lines, 1) if i not in removed]
    for d in (d for d in diff if d.sign == "+"):
        rest.insert(d.line_no - 1, d.line)
    return rest


def test_line_diff_rebuilds_the_edit(spark):
    pairs = [("a\nb", "b\na"), ("a\nb\nc", "a\nx\nc"), ("a\nb", "a\nb\nc"), ("a\nb", "b"), ("", "a"), ("a", ""),
             ("a\na\na", "a\na"), ("a\nb\na", "a"), ("same", "same"), ("x\ny\n", "x\ny"), ("p\r\nq", "p\nr\nq")]
    d = spark.createDataFrame([(1, i, o, e) for i, (o, e) in enumerate(pairs)],
                              "tenant_id int, entity_id int, original_text string, edited_text string")
    got = {r.entity_id: r.diff for r in d.select(
        "entity_id", au.line_diff(F.col("original_text"), F.col("edited_text")).alias("diff")).collect()}
    for i, (o, e) in enumerate(pairs):
        assert _apply(o, got[i]) == e.splitlines(), (o, e, got[i])
    assert [(x.sign, x.line_no, x.line) for x in got[0]] == [("-", 1, "a"), ("-", 2, "b"), ("+", 1, "b"), ("+", 2, "a")]
    assert got[8] == [] and got[9] == []
    rows = au.ordered_changes(d).where("entity_id = 1").collect()
    assert sorted((r.sign, r.line_no, r.line) for r in rows) == [("+", 2, "x"), ("-", 2, "b")]
    logged = au.audit_rows(d.withColumn("action", F.lit("edit"))).where("entity_id = 1").collect()
    assert {r.action: len(r.diff) for r in logged} == {"DRAFTED": 0, "EDITED": 2}


def test_evaluation_keeps_tenants_apart(spark):
    from procura.operators import evals as ev
    labels = spark.createDataFrame([(1, "I1", "LEAKAGE_DETECTED", "PRICE_VARIANCE"), (2, "I1", "APPROVED", None),
                                    (2, "I2", "AMBIGUOUS", None)],
                                   "tenant_id int, invoice_id string, expected_status string, expected_check_type string")
    status = spark.createDataFrame([(1, "I1", "LEAKAGE_DETECTED"), (2, "I1", "APPROVED"), (1, "I2", "LEAKAGE_DETECTED"),
                                    (2, "I2", "APPROVED")], "tenant_id int, invoice_id string, reconciliation_status string")
    found = spark.createDataFrame([(1, "I1", "PRICE_VARIANCE"), (2, "I1", "DUPLICATE_PO")],
                                  "tenant_id int, invoice_id string, check_type string")
    assert tuple(ev.confusion(labels, status).first()) == (1, 0, 1, 0, 1)
    assert tuple(ev.check_type_accuracy(labels, status, found).first()) == (1, 1, 1.0)
    assert [tuple(r) for r in ev.held_out_decisions(labels, status).collect()] == [(2, "I2", "APPROVED")]


def test_cost_status_telemetry(spark):
    rates = rn.rate_table(spark)
    runs = spark.createDataFrame(
        [(1, "r1", "sup", rn.PRIMARY_MODEL, 1000, 2000, 10, "SUCCESS", None, None),
         (1, "r2", "sup", "unknown", 1000, 2000, None, "RATE_LIMITED", "429", None),
         (1, "r3", "sup", rn.PRIMARY_MODEL, None, None, 30, "ERROR", "boom", None),
         (1, "r4", "sup", rn.FALLBACK_MODEL, 1000, 1000, 20, "BLOCKED_INJECTION", None, None)],
        "tenant_id int, run_id string, agent_name string, model string, input_tokens int, output_tokens int, "
        "latency_ms int, status string, error_message string, created_at timestamp")
    log = {r.run_id: r for r in rn.run_log_rows(runs, rates).collect()}
    assert str(log["r1"].estimated_cost_usd) == "0.002170"
    assert str(log["r2"].estimated_cost_usd) == "0.000000"
    assert log["r1"].agent_name == f"sup:{rn.PRIMARY_MODEL}"
    tel = {r.agent_name: r for r in rn.telemetry(rn.run_log_rows(runs, rates).withColumn("agent_name", F.lit("sup"))).collect()}
    assert (tel["sup"].call_count, tel["sup"].success_count, tel["sup"].error_count, tel["sup"].avg_latency_ms) == (4, 1, 2, 20)
    st = spark.createDataFrame([("HTTP 429 Too Many",), ("boom",)], "error_message string")
    assert [r.s for r in st.select(rn.failure_status().alias("s")).collect()] == ["RATE_LIMITED", "ERROR"]


def test_conversation_tail_and_route(spark):
    msgs = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)],
                                 "conv_id int, turn int, role string, text string")
    tail = conversation_tail(msgs).first().conversation
    assert tail == "\n".join(f"{'human' if t % 2 == 0 else 'ai'}: m{t}" for t in range(3, 9))
    labels = spark.createDataFrame([("  - Negotiation ",), ("Label: anomaly.",), ("vendor stuff",), ("???",), (None,)],
                                   "reply string")
    assert [r.x for r in labels.select(route_label(F.col("reply")).alias("x")).collect()] == \
        ["negotiation", "anomaly", "end", "end", "end"]


def test_ground_truth_nested_and_lines(spark, tmp_path):
    doc = {"tenants": [{"tenant_id": "t1", "tenant_name": "A", "tenant_label": "a", "invoices": [
        {"invoice_number": "I1", "expected_status": "APPROVED", "reason": "clean"},
        {"invoice_number": "I2", "expected_status": "LEAKAGE_DETECTED", "check_type": "DUPLICATE_PO",
         "reason": "dup"}]}]}
    p = tmp_path / "gt.json"
    p.write_text(json.dumps(doc, indent=2))
    flat = fl.read_ground_truth(spark, str(p))
    assert sorted((r.tenant_id, r.invoice_number, r.check_type) for r in flat.collect()) == \
        [("t1", "I1", None), ("t1", "I2", "DUPLICATE_PO")]
    out = str(tmp_path / "lines")
    fl.write_ground_truth_lines(flat, out)
    back = fl.read_ground_truth_lines(spark, out)
    assert sorted(back.collect()) == sorted(flat.select(*back.columns).collect())


def test_document_listing_and_keys(spark, tmp_path):
    for name in ["CON-001_Meridian.pdf", "CON-777_Unknown.pdf", "notes.pdf", "CON-002_x.txt"]:
        (tmp_path / name).write_bytes(b"%PDF")
    docs = fl.list_documents(spark, str(tmp_path), "*.pdf").withColumn("tenant_id", F.lit(0))
    contracts = spark.createDataFrame([("CON-001", 1, 0), ("CON-001", 9, 1), ("CON-777", 2, 1)],
                                      "contract_number string, contract_id int, tenant_id int")
    # Other tenants' contracts of the same number are not matched.
    assert [(r.file_name, r.contract_id) for r in fl.doc_key_match(docs, contracts).collect()] == [("CON-001_Meridian.pdf", 1)]
    skipped = {r.file_name: r.reason for r in fl.doc_key_skipped(docs, contracts).collect()}
    assert skipped == {"CON-777_Unknown.pdf": "unknown contract", "notes.pdf": "no key in name"}
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "")], "doc int, page_number int, page_text string")
    assert fl.document_text(pages, "doc").first().document_text == "a\nb\n"


def test_replace_tenants_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "results")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tenant_id int, v string")
    sk.replace_tenants(first, path, [1, 2, 3])
    rerun = spark.createDataFrame([(1, "a2")], "tenant_id int, v string")
    for _ in range(2):
        sk.replace_tenants(rerun, path, [1, 2])
        got = sorted(tuple(r) for r in spark.read.parquet(path).select("tenant_id", "v").collect())
        assert got == [(1, "a2"), (3, "c")]


def test_golden_sections_and_vector_literal(spark, tmp_path):
    from procura.functions.vectors import vector_literal
    golden = {"contracts": [{"file": "c1.pdf", "expected": {"contract_number": "CON-001", "items": [
        {"item_sku": "LOG-DIS-01", "agreed_unit_price": 450.0}]}}],
        "invoices": [{"file": "i1.pdf", "expected": {"invoice_number": "A-1", "quantity_billed": 10,
                                                     "invoice_unit_price": 450.0, "total_amount": 4500.0}}],
        "citation_questions": [{"question": "q?", "expected_contract": "CON-002", "expected_page": 1}]}
    p = tmp_path / "golden.json"
    p.write_text(json.dumps(golden, indent=1))
    g = fl.read_golden(spark, str(p))
    assert g["contracts"].first().contract_number == "CON-001"
    assert g["invoices"].first().quantity_billed == 10
    assert g["citation_questions"].first().expected_page == 1
    v = spark.createDataFrame([([1.0, 0.5, -2.0],)], "v array<double>")
    assert v.select(vector_literal(F.col("v")).alias("s")).first().s == "[1.0,0.5,-2.0]"


def test_broadcast_check_counts_rows_and_bytes(spark):
    from procura.functions.sizing import fits_broadcast
    df = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert fits_broadcast(df) and fits_broadcast(df.limit(0))
    assert not fits_broadcast(df, max_rows=49)
    assert not fits_broadcast(df, max_bytes=50_000)



def test_materialize_round_trip_and_cleanup(spark):
    import os
    from procura.session import drop_materialized, materialize, shared_path
    df = materialize(spark.range(10).withColumnRenamed("id", "x"), "unit")
    assert sorted(r.x for r in df.collect()) == list(range(10))
    drop_materialized(spark)
    root = shared_path(spark, f"tables/{spark.sparkContext.applicationId}").replace("file:", "")
    assert not os.path.exists(root)


def test_each_value_of_a_reply_is_read_from_its_text_once(spark):
    """The rules name a price or a total many times; its text is matched and cast in one place of the plan."""
    replies = spark.createDataFrame([("d", 1, 1, "{}")], "doc_id string, tenant_id int, attempt int, raw_json string")
    plan = rp.validate_invoices(replies)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rp.NUMBER) == 2  # unit price, total
    items = rp.validate_contracts(replies)._jdf.queryExecution().optimizedPlan().toString()
    assert items.count(rp.NUMBER) == 1


def test_narrow_scans_are_dealt_over_more_tasks(spark, tmp_path):
    """One row group is one scan task; rows that are costly later are dealt over all cores first."""
    from procura.sources.tables import spread
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    t = spark.read.parquet(path)
    dealt = spread(t, "id")
    assert t.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert spread(dealt, "id") is dealt
