"""Driver contract: entry smoke run and registry consistency."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["tenant_id", "invoice_id", "supplier_id"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
