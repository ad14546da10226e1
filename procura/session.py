"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job wants: AQE for runtime re-planning (coalesce, skew
# splitting, broadcast switch), ANSI semantics kept on, UTC time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

OPEN_FILES = 16               # files a task may write at once
ROW_GROUP_BYTES = 32 << 20    # bound of what each of them holds in memory
MAX_BUCKETS = 100_000         # Spark's bound of a table's buckets


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "procura", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster use the session the launcher provides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names this folder; we only create one of our own when the
    setting is absent (local tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="procura-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/procura/{name}"


def default_sf_dir() -> str:
    return os.environ.get("PROCURA_SF_DIR", "/root/testdata/sf0.01")


@contextmanager
def unsorted_partitions(spark: SparkSession):
    """Inside, a write by partition keeps one file open per value (up to ``OPEN_FILES`` a task) instead of
    sorting, and with large tasks spilling, every row by the partition column first. Tasks that meet more values sort."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_batches(spark: SparkSession, most: int):
    """Inside, jobs send rows to Python workers up to ``most`` bytes (or one row) at a time, where Spark's 64 MB and
    10,000 rows would let a batch grow with the rows of a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df, name: str = "table", **options):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage like a reliable checkpoint (it survives executor
    loss), but runs one job instead of compute-then-recompute, and readers get
    columnar scans with column pruning and filter pushdown. Used where one
    derived table feeds several branches of a plan. ``options`` are the writer's."""
    import uuid
    spark = df.sparkSession
    path = shared_path(spark, f"tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Catalog names of the bucketed tables written for each application.
_BUCKETED: dict[str, list[str]] = {}


def materialize_bucketed(df, key: str, name: str, buckets: int | None = None, placed: bool = False):
    """Like :func:`materialize`, as a table of ``buckets`` (the shuffle partitions if not given) by ``key``:
    a later grouping by ``key`` (and more columns) needs no shuffle, also behind a broadcast join. One file a bucket.
    ``placed``: ``df`` groups a table of the same buckets by ``key``, so its rows are in place already."""
    import uuid
    spark = df.sparkSession
    app, buckets = spark.sparkContext.applicationId, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"procura_{name}_{uuid.uuid4().hex}"
    if not placed:
        df = df.repartition(buckets, key)
    with unsorted_partitions(spark):
        df.write.format("parquet").bucketBy(buckets, key) \
            .option("path", shared_path(spark, f"tables/{app}/{table}")).saveAsTable(table)
    _BUCKETED.setdefault(app, []).append(table)
    return spark.table(table)


#: Called by :func:`drop_materialized`, to forget frames that read the dropped tables.
ON_DROP: list = []


def drop_materialized(spark) -> None:
    """Delete the tables that :func:`materialize` wrote for this application.

    Other applications that share the folder keep theirs, as do the stored
    fixtures and stream checkpoints. Call once the jobs that read the tables
    are done; what is memoised on them is forgotten and built anew."""
    path = shared_path(spark, f"tables/{spark.sparkContext.applicationId}")
    for forget in ON_DROP:
        forget()
    for table in _BUCKETED.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {table}")
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        fs.delete(hpath, True)
