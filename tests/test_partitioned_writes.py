"""Tables written by tenant are not sorted by tenant first."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from procura.session import unsorted_partitions
from procura.sources import files as fl
from procura.sources import fixtures as fx
from procura.sources.tables import Tables

NAME = "spark.sql.maxConcurrentOutputFileWriters"


def test_stored_tables_and_labels_keep_files_open(spark, tmp_path, monkeypatch):
    rows = [(str(i % 30), f"i{i}") for i in range(200)]  # more tenants than open files: the rest is sorted
    df = spark.createDataFrame(rows, "tenant_id string, invoice_number string").coalesce(1)
    before, seen = spark.conf.get(NAME), []
    for kind in ("parquet", "json"):
        write = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(DataFrameWriter, kind, lambda self, path, w=write: (seen.append(int(spark.conf.get(NAME))), w(self, path))[1])
    back = fx.stored(Tables(spark, str(tmp_path)), "numbers", lambda t: df)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        fl.write_ground_truth_lines(df, path, compression=compression)
        got = fl.read_ground_truth_lines(spark, path).select("tenant_id", "invoice_number").collect()
        assert sorted(map(tuple, got)) == sorted(rows)
    assert len(seen) == 3 and min(seen) > 0 and spark.conf.get(NAME) == before
    with pytest.raises(ZeroDivisionError), unsorted_partitions(spark):
        1 / 0
    assert spark.conf.get(NAME) == before
