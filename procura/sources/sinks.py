"""Sinks: append-only run logs and idempotent per-tenant replacement (S-7, S-8, S-9, S-10, S-11).

Tables are stored partitioned by ``tenant_id`` so tenant filters prune
partitions. A job never overwrites the path it reads: derived tables
(statuses, cache) are written as a new version directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_runs(runs: DataFrame, path: str) -> None:
    """S-7: append run-log rows."""
    runs.write.mode("append").partitionBy("tenant_id").parquet(path)


def _fs_delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def _files(spark: SparkSession, path: str) -> set[str]:
    """Names of a folder's files; part files carry their write job's id, so a rewrite shows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(p)} if fs.exists(p) else set()


def replace_tenants(df: DataFrame, path: str, tenants: list) -> None:
    """S-8 / S-9: replace exactly the given tenants' partitions with ``df``'s rows.

    Rows of other tenants in ``df`` are not written, so other partitions stay
    as they are. The rows are written first, once, by dynamic partition
    overwrite; partitions of given tenants that got no rows are removed only
    after that has succeeded, so a failed write leaves the old rows. Which
    tenants got rows shows in their partitions' file names. Re-running gives the same table."""
    if not tenants:
        return
    spark, base = df.sparkSession, path.rstrip("/")
    before = {t: _files(spark, f"{base}/tenant_id={t}") for t in tenants}
    df.where(F.col("tenant_id").isin(list(tenants))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(base)
    for t in tenants:
        if before[t] and _files(spark, f"{base}/tenant_id={t}") == before[t]:
            _fs_delete(spark, f"{base}/tenant_id={t}")


def write_version(df: DataFrame, base: str, version: int) -> str:
    """S-10 / S-11: write a derived table as ``<base>/v=<version>`` and return the path."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").partitionBy("tenant_id").parquet(path)
    return path
