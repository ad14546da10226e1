"""A third of all rows on one key: results stay whole and equal a brute-force model."""

import random
from decimal import Decimal

from procura.operators import reconcile as rc
from procura.sources import sinks as sk

INV = ("invoice_id string, tenant_id int, supplier_id bigint, po_id string, item_sku bigint, "
       "invoice_unit_price decimal(18,5), invoice_date date")
CI = "tenant_id int, supplier_id bigint, item_sku bigint, agreed_unit_price decimal(18,5), is_active boolean"


def test_hot_keys_reconcile_like_brute_force(spark):
    rnd = random.Random(1)
    n = 3000
    items = {(t, s, k): Decimal(rnd.choice([80, 100, 120])) for t in range(2) for s in range(5) for k in range(5)}
    inv = []
    for i in range(n):
        if i % 3 == 0:   # hot contract key and hot PO
            t, s, k, po = 0, 1, 1, "HOT"
        else:
            t, s, k = rnd.randrange(2), rnd.randrange(5), rnd.randrange(6)
            po = None if i % 7 == 0 else f"P{rnd.randrange(800)}"
        inv.append((f"i{i}", t, s, po, k, Decimal(rnd.choice([90, 100, 104, 110, 130])), None))
    prev = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                           "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        got = sorted((r.invoice_id, r.check_type) for r in rc.reconcile(
            spark.createDataFrame(inv, INV),
            spark.createDataFrame([(t, s, k, p, True) for (t, s, k), p in items.items()], CI)).collect())
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    exp = []
    po_count = {}
    for iid, t, s, po, k, price, _ in inv:
        if po is not None:
            po_count[(t, po)] = po_count.get((t, po), 0) + 1
    for iid, t, s, po, k, price, _ in inv:
        agreed = items.get((t, s, k))
        if agreed is None:
            exp.append((iid, "MISSING_CONTRACT"))
        elif agreed != 0 and (price - agreed) / agreed > Decimal("0.05"):
            exp.append((iid, "PRICE_VARIANCE"))
        if po is not None and po_count[(t, po)] > 1:
            exp.append((iid, "DUPLICATE_PO"))
    assert got == sorted(exp)
    assert sum(1 for _, c in got if c == "DUPLICATE_PO") >= n // 3


def test_versioned_writes_never_overwrite(spark, tmp_path):
    base = str(tmp_path / "status")
    df = spark.createDataFrame([(1, "a")], "tenant_id int, v string")
    p1 = sk.write_version(df, base, 1)
    p2 = sk.write_version(spark.read.parquet(p1).withColumnRenamed("v", "v").select("tenant_id", "v"), base, 2)
    assert spark.read.parquet(p2).count() == 1
    try:
        sk.write_version(df, base, 1)
        raise AssertionError("existing version must not be overwritten")
    except Exception as e:
        assert "already exists" in str(e).lower() or "path_already_exists" in str(e).lower()
