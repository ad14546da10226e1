"""Invoices and labels derived from one stored table of lines."""

import datetime

from procura.operators import evals as ev
from procura.plans import q_evals
from procura.sources import fixtures as fx
from procura.sources.tables import Tables

LINE = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_tax double,"
        " l_shipdate timestamp_ntz, l_discount double")


def tables(spark, path):
    day = datetime.datetime(2024, 1, 2)
    rows = []
    for i in range(400):
        rows.append((i // 5 % 60, (1, 2, 7, None)[i % 4], i % 23 if i % 31 else None, i % 3 if i % 37 else None,
                     float((13, 17, 19, 5, 20)[i % 5]) if i % 29 else None, (i % 7) / 100 if i % 41 else None, day if i % 43 else None, 0.0))
    rows += rows[:40]  # the same lines twice
    write = {"lineitem": spark.createDataFrame(rows, LINE),
             "part": spark.createDataFrame([(p, 10.0 + p, (None, 25, 3)[p % 3]) for p in [*range(20), 4]], "p_partkey long, p_retailprice double, p_size int"),
             "supplier": spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, None, "c")], "s_suppkey long, s_nationkey int, s_name string"),
             "nation": spark.createDataFrame([(1, "x", 0), (2, "y", 3)], "n_nationkey int, n_name string, n_regionkey int")}
    for name, df in write.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return Tables(spark, str(path)), rows


def expected(rows):
    """The labels by a plain reading of their rule."""
    po, out = {}, []
    for o, n, _, s, *_ in rows:
        if n is not None and n != 7 and o is not None and s is not None:
            po[o, s] = po.get((o, s), 0) + 1
    for o, n, p, s, qty, tax, *_ in rows:
        if s not in (0, 1) or p is None or p >= 20:
            continue
        size = (None, 25, 3)[p % 3]
        missing = (p + s) % 20 == 0 or size == 25
        variance = tax is not None and round(tax, 2) >= 0.03
        dup = n is not None and n != 7 and po.get((o, s), 0) > 1
        status = {13.0: "AMBIGUOUS", 17.0: "APPROVED", 19.0: "LEAKAGE_DETECTED"}.get(qty, "LEAKAGE_DETECTED" if missing or variance or dup else "APPROVED")
        check = None if qty in (13.0, 17.0) else "MISSING_CONTRACT" if missing else "PRICE_VARIANCE" if variance else "DUPLICATE_PO" if dup else None
        number = "-".join(str(x) for x in (o, n, p, s) if x is not None)
        out += [((0, 3)[s], number, status, check)] * (2 if p == 4 else 1)  # part 4 comes twice
    return sorted(out, key=str)


def test_labels_and_invoices_come_from_stored_lines(spark, tmp_path):
    t, rows = tables(spark, tmp_path)
    got = fx.expected_labels(t).select("tenant_id", "invoice_id", "expected_status", "expected_check_type")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert sorted(r["invoice_id"] for r in fx.invoices(t).collect()) == sorted(x[1] for x in expected(rows))
    # What is kept has no text, and labels and invoices are read from it.
    stored = fx.lines(t)
    assert "string" not in dict(stored.dtypes).values()
    for df in (fx.expected_labels(t), fx.invoices(t)):
        assert "fixtures" in str(df.inputFiles()) and "part.parquet" not in str(df.inputFiles())


def test_suppliers_are_broadcast_when_counted_few(spark, tmp_path, monkeypatch):
    t, _ = tables(spark, tmp_path)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plans = [df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") for df in (fx.build_lines(t), fx.build_contract_items(t))]
        monkeypatch.setattr(fx, "SUPPLIER_ROWS", 1)
        few = [df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") for df in (fx.build_lines(t), fx.build_contract_items(t))]
    finally:
        spark.conf.set(name, before)
    assert plans == [2, 2] and few == [1, 1]  # the nations always


def test_evaluation_keeps_and_moves_only_what_it_compares(spark, tmp_path, monkeypatch):
    t, _ = tables(spark, tmp_path)
    kept, write = {}, q_evals.materialize
    monkeypatch.setattr(q_evals, "materialize", lambda df, name, **o: (kept.update({name: df.columns}), write(df, name, **o))[1])
    assert q_evals.q_check_type_accuracy(t).count() == 1
    assert kept["results"] == ["tenant_id", "invoice_id", "check_type"]
    labels = spark.createDataFrame([(1, "a", "AMBIGUOUS", None), (1, "b", None, "X"), (2, "a", "LEAKAGE_DETECTED", "X")],
                                   "tenant_id int, invoice_id string, expected_status string, expected_check_type string")
    status = spark.createDataFrame([(1, "a", "LEAKAGE_DETECTED"), (2, "a", None)], "tenant_id int, invoice_id string, reconciliation_status string")
    j = ev.labelled(labels, status)
    join = next(x for x in j._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert "expected_status" not in join
    assert sorted(map(tuple, j.collect()), key=str) == [(1, "a", None, True, False, True), (1, "b", "X", None, None, False), (2, "a", "X", False, True, False)]
