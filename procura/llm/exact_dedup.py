"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, lower_ascii, row_key

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_col: str | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Group equal texts (equal after lower-casing A-Z) and keep one row of each group.

    Result: one row per input row with ``id``, ``keep_id`` (largest id of the
    group), ``group_size``, ``kept`` and ``full_hash`` (SHA-256 of the normalised
    text; NULL where length or prefix already settled the row and no
    ``hash_col`` was given).

    Levels 1 and 2 use one narrow pass over (length, prefix hash). Only rows
    that share both with another row go to level 3. There ``hash_col`` is used
    if the caller already stores a digest of the normalised text, else the full
    content of those rows, and of no others, is read and hashed.

    Cases: NULL text equals ''. A NULL id is smaller than any id; a group with
    only NULL ids has ``keep_id`` NULL. Rows repeated with the same id and text
    count separately in ``group_size`` and exactly one of them is kept. An
    empty table gives an empty result. Other columns are not read, whatever
    their names.

    Hot groups: counts are combined before each shuffle, and the joins back use
    derived keys so that AQE can split them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Lower-casing A-Z keeps the byte length, so only the prefix is normalised here.
    level2 = [F.octet_length(text).cast("long").alias("len"),
              F.xxhash64(F.octet_length(text), F.xxhash64(lower_ascii(text.substr(1, prefix_chars)))).alias("rkey")]
    given = F.col(hash_col) if hash_col else F.lit(None).cast("string")
    rows = materialize(docs.select(F.col(id_col).alias("id"), *level2, given.alias("given")), "dedup_keys")
    # A length that one row has cannot hold a repeated (length, prefix), so one
    # grouped pass serves both levels. A clash of keys only sends a row on to level 3.
    repeated = rows.groupBy("len", "rkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .select(F.bitwise_not("rkey").alias("key")).distinct()
    repeated = repeated.select(F.bitwise_not("key").alias("rkey"))

    settled = rows.join(repeated, "rkey", "left_anti") \
        .select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                F.lit(True).alias("kept"), F.col("given").alias("full_hash"))

    if hash_col:
        left = rows.join(repeated, "rkey", "left_semi").select("id", "len", F.col("given").alias("full_hash"))
    else:
        left = docs.select(F.col(id_col).alias("id"), *level2, text.alias("body")).join(repeated, "rkey", "left_semi") \
            .select("id", "len", F.sha2(lower_ascii(F.col("body")), 256).alias("full_hash"))
    counted = left.groupBy("id", "len", "full_hash").agg(F.count(F.lit(1)).alias("copies"))
    groups = counted.groupBy("len", "full_hash") \
        .agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")) \
        .select(row_key(F.col("len"), F.col("full_hash")).alias("gkey"), "keep_id", "group_size")
    grouped = counted.withColumn("gkey", row_key(F.col("len"), F.col("full_hash"))) \
        .join(groups, "gkey") \
        .select("id", "keep_id", "group_size", "full_hash",
                F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")) \
        .select("id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                "full_hash")
    return settled.unionByName(grouped)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, columns unchanged.

    Every text is read here anyway, to be written again, so its digest is
    taken as it is read and level 3 compares digests: hashing a text costs
    less than sending it through a shuffle to be hashed. Texts are shuffled
    once, by (id, digest), which names the dropped rows; rows repeated with
    the same id and text meet there and are reduced to one."""
    key, rank, digest = fresh(docs, "dedup_key"), fresh(docs, "dedup_rank"), fresh(docs, "dedup_digest")
    hashed = docs.withColumn(digest, F.sha2(lower_ascii(F.col(text_col)), 256))
    gone = exact_dedup(hashed, id_col, text_col, digest) \
        .filter(~F.col("id").eqNullSafe(F.col("keep_id"))) \
        .select(row_key(F.col("id"), F.col("full_hash")).alias("gone_key")).distinct()
    keyed = hashed.withColumn(key, row_key(F.col(id_col), F.col(digest))).drop(digest)
    kept = keyed.join(gone, keyed[key] == gone["gone_key"], "left_anti")
    return kept.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(key))) \
        .filter(F.col(rank) == 1).drop(key, rank)
