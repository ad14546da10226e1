"""Size-checked broadcast.

A side is broadcast only when its rows and bytes, counted map-side, prove it
small; beyond the bounds the caller gets ``False`` and takes its shuffle path
(salted when the join key has few values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of together at most ``max_bytes``
    (written as JSON). One partial aggregate over ``df``; no row leaves its task."""
    size = df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")).alias("bytes")).first()
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def salt_column(key: str, buckets: int):
    """A stable salt in [0, buckets) derived from a row key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def replicate_salts(df: DataFrame, buckets: int, name: str = "_salt") -> DataFrame:
    """One copy of each row per salt value (the small side of a salted join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))


def pair_with_small(big: DataFrame, small: DataFrame, on: list[str], big_key: str,
                    max_rows: int = 10_000) -> DataFrame:
    """Join every row of ``big`` with the rows of a small, bounded side sharing ``on``.

    Broadcast when the size check passes; otherwise the small side is copied
    to every salt bucket and ``big`` rows are hashed to one bucket by
    ``big_key``, so few-valued keys (a tenant) still spread over many tasks."""
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, "inner")
    buckets = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return big.withColumn("_salt", salt_column(big_key, buckets)) \
        .join(replicate_salts(small, buckets), on + ["_salt"], "inner").drop("_salt")
