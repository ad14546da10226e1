"""Mix sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, word_count, words

BLOCK = 16                # words in a block
WORDS_PER_SHARD = 65_536  # a shard's share of all words, all sources together
MAX_SHARDS = 8_192        # so that one source's shards stay a small table
MAX_REPEATS = 3
SEED = "mix-1"


def cyclic_weights(docs: DataFrame, source_col: str = "source", cycle: int = 3) -> DataFrame:
    """(source, weight): sources by code point, NULL last, weigh 1, 2, .. cycle, repeating.

    One row a source, so the ordering window runs over the source list only."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    return docs.select(F.col(source_col).alias("source")).distinct() \
        .select("source", ((F.row_number().over(order) - 1) % cycle + 1).cast("double").alias("weight"))


def source_targets(totals: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(skey, source_size, weight) -> adds ``target``: the sources share the
    total of all sizes by weight; a target stops at ``max_repeats`` times its
    source's size and the excess is reshared by weight until none is above.

    Sorted by the level at which a source reaches its cap, the capped sources
    are a prefix, and the common level ``(total - caps before) / (weights from
    here)`` rises until the first uncapped source; its maximum is the solution."""
    cap = F.col("source_size") * F.lit(float(max_repeats))
    usable = totals.withColumn("cap", F.when(F.col("weight") > 0, cap).otherwise(F.lit(0.0)))
    order = W.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)), "skey") \
        .rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = F.when((weights > 0) & (F.col("weight") > 0), left / weights)
    return usable.withColumn("level", level) \
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.max("level").over(whole) * F.col("weight"), F.lit(0.0)))) \
        .drop("cap", "level")


def sainte_lague(parties: DataFrame, share: Column, seats: Column, members: Column, by: list[str],
                 order: list[str]) -> DataFrame:
    """Integer seats to the rows of each group ``by``: the highest quotients
    ``share / (2k - 1)`` win seat k, ties in ``order``.

    ``share`` is a row's fractional entitlement, summing to about ``seats`` in
    its group of ``members`` rows. Rounding all shares misses the total by at
    most half the members, so only the seats near a row's entitlement are
    contested: those below are given, and the rest ranked by quotient. The
    contested seats are a small multiple of the members, whatever the seats."""
    p = parties.withColumn("share", share).withColumn("seats", seats).filter(F.col("share") > 0)
    slack = F.lit(1) + F.ceil(F.lit(2.0) * F.col("share") * members / F.greatest(F.col("seats"), F.lit(1)))
    p = p.withColumn("given", F.greatest(F.lit(0).cast("long"), (F.floor("share") - slack).cast("long"))) \
        .withColumn("upto", (F.floor("share") + slack).cast("long"))
    group = W.partitionBy(*by)
    p = p.withColumn("open", F.col("seats") - F.sum("given").over(group))
    contested = p.withColumn("k", F.explode(F.sequence(F.col("given") + 1, F.col("upto")))) \
        .withColumn("quotient", F.col("share") / (F.lit(2) * F.col("k") - 1))
    rank = F.row_number().over(group.orderBy(F.desc("quotient"), *order, "k"))
    return contested.withColumn("won", (rank <= F.col("open")).cast("long")) \
        .groupBy(*dict.fromkeys([*by, *order])).agg((F.max("given") + F.sum("won")).cast("long").alias("quota"))


def mix_sources(rows: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                size_col: str = "size", block: int = BLOCK, words_per_shard: int = WORDS_PER_SHARD,
                max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` (words the mix takes of the
    row, repeats counted) to rows of (id, source, size, payload columns).

    Blocks of ``block`` words go to sources by highest quotients of their
    targets, and each source's blocks to its shards by highest quotients of
    the words there. A shard is a seeded hash bucket. Within a (source, shard)
    cell the rows, in seeded order, form a ring of words; the cell's quota
    takes that many blocks round the ring. A cell takes ``max_repeats`` times
    its words at most; what it won beyond goes to the source's other cells, in
    proportion to their room, so a source of small cells meets its quota too. So every row is taken whole
    ``quota // cell`` times and the first blocks once more.

    Shards grow with the data, so the window of a cell stays small even for a
    source with a third of all rows. Statistics cover all rows. The result
    depends on the rows only, not on partitioning: rerun, it is the same.

    Cases: a NULL source is a source of its own; a source missing from
    ``weights`` weighs nothing and is not taken; size 0 or NULL is never taken
    (NULL counts as 0). Rows repeated with the same id each take part. An empty
    table gives an empty result. Payload columns must not be called like the
    added ones or ``skey, seeded, bucket, shard, stop, ck, cs, cell, cell_take``."""
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))  # NULL sorts last
    keyed = rows.withColumn(size_col, F.coalesce(F.col(size_col), F.lit(0)).cast("long")) \
        .withColumn("skey", skey).withColumn("seeded", hashed)

    # One pass sums the words by source and bucket; a shard is a run of buckets.
    bucket = F.conv(F.substring("seeded", 25, 8), 16, 10).cast("long") % F.lit(MAX_SHARDS)
    keyed = keyed.withColumn("bucket", bucket)
    sums = materialize(keyed.groupBy("skey", "bucket").agg(F.sum(size_col).alias("words")), "mix_words")
    total = sums.agg(F.sum("words")).first()[0] or 0
    shards = max(1, min(MAX_SHARDS, math.ceil(total / words_per_shard)))
    blocks = int(total / block + 0.5)
    shard = F.expr(f"bucket * {shards} div {MAX_SHARDS}")
    keyed = keyed.withColumn("shard", shard).drop("bucket")

    wt = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("wkey"),
                        F.col("weight").cast("double").alias("weight"))
    cells = sums.withColumn("shard", shard).groupBy("skey", "shard").agg(F.sum("words").alias("cell"))
    totals = cells.groupBy("skey").agg(F.sum("cell").cast("long").alias("source_size"),
                                       F.count(F.when(F.col("cell") > 0, 1)).alias("n_cells"))
    totals = totals.join(wt, totals["skey"] == wt["wkey"], "left").drop("wkey") \
        .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    targets = source_targets(totals, max_repeats)
    n_sources = F.count(F.lit(1)).over(W.partitionBy())
    seats = sainte_lague(targets.withColumn("all", F.lit(0)).withColumn("n_sources", n_sources),
                         F.col("target") / block, F.lit(blocks).cast("long"), F.col("n_sources"),
                         ["all"], ["skey"]).select(F.col("skey").alias("tkey"), F.col("quota").alias("source_quota"))
    plan = targets.join(seats, F.col("skey") == F.col("tkey"), "left").drop("tkey") \
        .withColumn("source_quota", F.coalesce("source_quota", F.lit(0)))

    per_cell = cells.join(plan.select(F.col("skey").alias("pkey"), "source_size", "n_cells", "target", "source_quota"),
                          F.col("skey") == F.col("pkey")).drop("pkey")
    quotas = sainte_lague(per_cell, F.col("source_quota") * F.col("cell") / F.col("source_size"),
                          F.col("source_quota"), F.col("n_cells"), ["skey"], ["shard"]) \
        .select(F.col("skey").alias("qk"), F.col("shard").alias("qs"), "quota")
    most = F.floor(F.col("cell") * max_repeats)
    cell_plan = per_cell.join(quotas, (F.col("skey") == F.col("qk")) & (F.col("shard") == F.col("qs")), "left") \
        .withColumn("won", F.least(F.coalesce("quota", F.lit(0)) * block, most)).withColumn("room", most - F.col("won"))
    # Words that a cell won beyond what it can take go to its source's cells with room, in proportion to
    # it: what the cells up to here are due, less what those before are. No cell gets more than its room.
    source = W.partitionBy("skey")
    room = F.sum("room").over(source)
    over = F.least(F.col("source_quota") * block - F.sum("won").over(source), room)
    upto = F.sum("room").over(source.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
    cell_plan = cell_plan.withColumn("over", over).withColumn("all_room", F.greatest(room, F.lit(1))).withColumn("upto", upto) \
        .withColumn("extra", F.expr("over * upto div all_room - over * (upto - room) div all_room")) \
        .select(F.col("skey").alias("ck"), F.col("shard").alias("cs"), "cell", "source_size", "target",
                (F.col("won") + F.col("extra")).alias("cell_take"))

    ring = W.partitionBy("skey", "shard").orderBy("seeded", F.col(id_col), size_col) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("stop", F.sum(size_col).over(ring))
    again = F.when(F.col("cell") > 0, F.expr("cell_take div cell")).otherwise(F.lit(0))
    rest = F.col("cell_take") - again * F.col("cell")
    part = F.greatest(F.lit(0), F.least(F.col("stop"), rest) - (F.col("stop") - F.col(size_col)))
    return placed.join(cell_plan, (F.col("skey") == F.col("ck")) & (F.col("shard") == F.col("cs"))) \
        .withColumn("taken", (again * F.col(size_col) + part).cast("long")) \
        .withColumn("source_size", F.col("source_size").cast("long")) \
        .drop("skey", "seeded", "shard", "stop", "ck", "cs", "cell", "cell_take")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken q times and
    a bit is q equal rows and one row with the first words of its text, joined
    by single blanks (``chars_col``, if given and present, is set to the cut
    text's length). Documents of which nothing is taken are left out."""
    one = fresh(docs, "mix_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(one),
                         F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                         word_count(F.col(text_col)).alias("size"))
    weights = options.pop("weights", None)
    if weights is None:
        weights = cyclic_weights(docs, source_col)
    mixed = mix_sources(packed, weights, "id", **options).filter("taken > 0")
    part = F.col("taken") % F.col("size")
    takes = F.concat(F.array_repeat(F.lit(0).cast("long"), F.expr("cast(taken div size as int)")),
                     F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = mixed.withColumn("part", F.explode(takes))
    cut = F.concat_ws(" ", F.slice(words(F.col(one)[text_col]), F.lit(1), F.col("part").cast("int")))
    out = out.withColumn("cut", F.when(F.col("part") > 0, cut))
    columns = []
    for c in docs.columns:
        value = F.col(one)[c]
        if c == text_col:
            value = F.when(F.col("part") > 0, F.col("cut")).otherwise(value)
        elif c == chars_col:
            value = F.when(F.col("part") > 0, F.length("cut").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
