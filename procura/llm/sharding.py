"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key

SEED = "shard-1"
HEX = 7  # leading hex digits of the seeded hash that choose a bucket


def _buckets(df: DataFrame) -> int:
    """Buckets a distributed rank is split into. The ranks do not depend on it."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _offsets(rows: DataFrame, group: list[str], bucket: str, key: str) -> DataFrame:
    """For each (group, bucket): the rows of the group in lower buckets, and in all.
    ``key`` is the name of the derived join key."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(row_key(*[F.col(c) for c in [*group, bucket]]).alias(key),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                         F.sum("n").over(W.partitionBy(*group)).alias("members"))


def shard_rows(rows: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source",
               tie_cols: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """Add ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard).

    Rows of a source are ranked in seeded order; rank r of n has the fraction
    (2r - 1) / 2n. All rows, sorted by fraction, are cut into runs of equal
    length, so shard sizes differ by at most one row and every shard has each
    source's share of rows to within a row or two.

    Both ranks are exact and distributed: rows are bucketed by the leading
    digits of what orders them, ranked in the bucket, and shifted by the rows
    in lower buckets. A source with a third of all rows spreads over all
    buckets, and fractions fill the buckets of the second rank evenly.

    Cases: a NULL source is a source of its own; rows with the same id are
    ordered by ``tie_cols``, and rows equal there too are interchangeable; a
    NULL id is ordered like an empty one. Fewer rows than shards leave the last shards
    empty. An empty table gives no rows. ``rows`` must not have columns called
    ``skey, seeded, b1, k1, at1, b2, k2, at2, before, members, fraction,
    shard, slot``."""
    buckets = _buckets(rows)
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))) \
        .withColumn("seeded", hashed) \
        .withColumn("b1", F.expr(f"cast(conv(substring(seeded, 1, {HEX}), 16, 10) as bigint) * {buckets} div {16 ** HEX}")) \
        .withColumn("k1", row_key(F.col("skey"), F.col("b1")))
    first = _offsets(keyed, ["skey"], "b1", "at1")
    ties = [F.col(c) for c in (id_col, *tie_cols)]
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("k1").orderBy("seeded", *ties))) \
        .join(first, F.col("k1") == F.col("at1")) \
        .withColumn("fraction", (2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("members"))) \
        .drop("r", "before", "members", "at1", "k1", "b1") \
        .withColumn("b2", F.floor(F.col("fraction") * buckets).cast("long")) \
        .withColumn("k2", row_key(F.col("b2")))
    second = _offsets(ranked, [], "b2", "at2")
    placed = ranked.withColumn("r", F.row_number().over(W.partitionBy("k2").orderBy("fraction", "skey", "seeded", *ties))) \
        .join(second, F.col("k2") == F.col("at2")) \
        .withColumn("g", F.col("before") + F.col("r") - 1)
    shard = F.expr(f"g * {shards} div members")
    start = F.expr(f"(shard * members + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("g") - start) \
        .withColumn("shard", F.col("shard").cast("int")) \
        .drop("skey", "seeded", "fraction", "b2", "k2", "r", "at2", "before", "members", "g")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard (``shard=<n>``), rows in slot order in each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot") \
        .write.mode("errorifexists").partitionBy("shard").parquet(path)
