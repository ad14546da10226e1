"""Tenant scope of guarded SQL, tenant replacement, numeric rules, storage clean-up."""

import pytest
from pyspark.sql import functions as F

from procura import session
from procura.operators import guards, replies
from procura.sources import sinks


@pytest.fixture
def tables(spark):
    return {"sup": spark.createDataFrame([(1, "a"), (2, "b")], "tenant_id int, name string")}


def test_guarded_sql_reads_only_the_tenants_views(spark, tables, tmp_path):
    path = str(tmp_path / "t")
    tables["sup"].write.parquet(path)
    tables["sup"].createOrReplaceTempView("stale")
    for sql in (f"select count(*) c from parquet.`{path}`", "select reflect('java.lang.System', 'getProperty', 'user.home') x",
                "select * from stale", "select name from sup where name in (select name from stale)", "select * from range(3)",
                "select * from (with c as (select * from stale) select * from c)"):
        with pytest.raises(guards.SQLBlocked):
            guards.guarded_query(spark, tables, 1, sql)
        assert guards.run_guarded(spark, tables, 1, sql, "r")["run"][3] == "ERROR"
    spark.catalog.dropTempView("stale")
    result, _ = guards.guarded_query(spark, tables, 2, "select name from (with c as (select name from sup) select name from c) limit 5")
    assert [r[0] for r in result.collect()] == ["b"]
    assert "sup" not in [t.name for t in spark.catalog.listTables()]
    assert guards.run_guarded(spark, tables, 1, "select name from sup", "r")["row_count"] == 1


JVM_CALL = "reflect('java.lang.System', 'getProperty', 'user.dir')"
WIDE = ", ".join(f"{i} as c{i}" for i in range(40))


@pytest.mark.parametrize("sql", [
    f"select {WIDE}, {JVM_CALL} as x from sup",
    f"select {WIDE}, {JVM_CALL} as x",
    f"select {WIDE}, (select max({JVM_CALL}) from sup) as x from sup",
    f"select * from (select {WIDE}, {JVM_CALL} as x from sup)",
    f"select * from (with c as (select {WIDE}, {JVM_CALL} as x from sup) select * from c)",
    f"select name from sup where {' and '.join(f'{i} < 50' for i in range(40))} and {JVM_CALL} is not null",
    f"select name from sup group by name having max({JVM_CALL}) <> ''",
    f"select name from sup order by {JVM_CALL}",
    f"select transform(array({', '.join(map(str, range(40)))}), x -> {JVM_CALL}) from sup",
    f"select sum(1) over (partition by {JVM_CALL}) from sup",
    f"select a.name from sup a join sup b on a.name = {JVM_CALL}",
    f"select name from sup where exists (select 1 from sup where {JVM_CALL} = 'x')",
    f"select case when 1 = 2 then 'a' else {JVM_CALL} end from sup",
    f"select name from sup union all select {JVM_CALL}",
    "select java_method('java.lang.System', 'getProperty', 'user.dir') x",
    "select try_reflect('java.lang.System', 'getProperty', 'user.dir') x",
    "select `reflect`('java.lang.System', 'getProperty', 'user.dir') x",
    "select system.builtin.reflect('java.lang.System', 'getProperty', 'user.dir') x",
    "select input_file_name() from sup", "select current_user() from sup", "select current_catalog()", "select version()",
    "select * from sup, lateral explode(array(1)) where name in (select name from csv.`/etc/passwd`)",
    "select * from text.`/etc/passwd`", "select * from default.sup", "select * from spark_catalog.default.sup",
    "select * from range(5)", "select * from sup, range(5)", "select * from sql_keywords()",
    "select (select count(*) from other) from sup", "select * from (with c as (select 1 as x) select x from c) join c on true",
    "select raise_error('x') from sup", "select own_function(name) from sup",
])
def test_guarded_sql_refuses_whatever_reaches_outside(spark, tables, sql):
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(guards.SQLBlocked, match="Refused"):
        guards.guarded_query(spark, tables, 1, sql)


@pytest.mark.parametrize("sql", [
    f"select {WIDE}, name from sup",
    "select upper(name) as n, count(*) as c, sum(case when name like 'a%' then 1 else 0 end) as s from sup group by upper(name) having count(*) > 0",
    "select name, row_number() over (partition by tenant_id order by name desc) as r from sup order by 1",
    "select * from (with c as (select name from sup), d as (select * from c) select * from d) x join sup using (name)",
    "select name from sup where name in (select name from sup) and exists (select 1 from sup) and length(name) between 0 and 9",
    "select transform(array(1, 2), x -> x + 1) as t, cast('3' as int) as i, date_trunc('month', date'2024-02-03') as d, name from sup",
    "select tenant_id, name, count(*) from sup group by cube (tenant_id, name)",
    "select name from sup union select name from sup", "select e from sup lateral view explode(array(1, 2)) v as e",
    "select coalesce(name, 'x') || '!' as n, round(avg(tenant_id), 2) as a from sup group by all",
])
def test_guarded_sql_runs_ordinary_statements(spark, tables, sql):
    result, _ = guards.guarded_query(spark, tables, 1, sql)
    count, rows = guards.preview(result)
    assert count == rows.count() > 0


def test_preview_runs_the_statement_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(45).mapInArrow(note, "id long").select("id", F.lit(None).alias("nothing"), F.col("id").alias("id"))
    count, rows = guards.preview(df)
    assert count == 45 and rows.columns == ["id", "nothing", "id"] and [r[0] for r in rows.collect()] == list(range(20))
    assert seen.value == 45


def test_replace_tenants_leaves_other_tenants_and_failed_writes_alone(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "tenant_id int, v string"
    sinks.replace_tenants(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema), path, [1, 2, 3])
    sinks.replace_tenants(spark.createDataFrame([(1, "a2"), (2, "b2")], schema), path, [1, 3])
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("tenant_id", "v").collect())
    assert read() == [(1, "a2"), (2, "b")]
    broken = spark.createDataFrame([(1, "x")], schema).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        sinks.replace_tenants(broken, path, [1, 2])
    assert read() == [(1, "a2"), (2, "b")]


@pytest.mark.parametrize("price", ["NaN", "Infinity", "5d", "-1", "0", "", "1e999"])
def test_prices_must_be_finite_positive_numbers(spark, price):
    raw = ('{"invoice_number": "a", "supplier_name": "s", "item_sku": "k", "quantity_billed": 1, "invoice_unit_price": "%s", '
           '"total_amount": 5.0, "invoice_date": "2024-01-02"}' % price)
    row = replies.validate_invoices(spark.createDataFrame([(1, raw)], "tenant_id int, raw_json string")).first()
    assert not row["is_valid"]
    raw = '{"contract_number": "a", "supplier_name": "s", "items": [{"item_sku": "k", "agreed_unit_price": "%s"}]}' % price
    row = replies.validate_contracts(spark.createDataFrame([(1, raw)], "tenant_id int, raw_json string")).first()
    assert not row["is_valid"]


def test_clean_up_spares_other_applications(spark):
    other = session.shared_path(spark, "tables/another-application/t")
    spark.range(3).write.mode("overwrite").parquet(other)
    mine = session.materialize(spark.range(4))
    assert mine.count() == 4
    session.drop_materialized(spark)
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(mine.inputFiles()[0]).count()
