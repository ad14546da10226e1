"""Prompts of a batch answered in their order: an answer is stored before the next prompt is looked up (R-7, J-8).

A prompt that misses becomes a cache entry for those after it. Which prompts miss is a clustering by leaders:
in batch order, a prompt is a leader if neither the snapshot nor an earlier leader is similar enough. That looks
sequential, but needs only the pairs of similar prompts (:func:`.cache.similar_pairs`): a prompt without an
undecided earlier neighbour is a leader, what has a leader before it as neighbour is not, and both rules are applied to all
prompts at once until nothing is undecided. Rounds follow the longest chain of similar prompts, not their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cache import SEMANTIC_CACHE_THRESHOLD, cache_idf, dedupe_cache, semantic_matches, similar_pairs, text_vectors
from .conversation import prompt_key
from .runs import PRIMARY_MODEL

SIMILARITY_DIGITS = 9  # equal texts tie whatever the order of summing


def leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The leaders among ``nodes`` (id, seq): those without an earlier leader in ``pairs`` (x, y; both directions)."""
    seq = nodes.select(F.col("id"), "seq")
    edges = pairs.join(seq.toDF("x", "x_seq"), "x").join(seq.toDF("y", "y_seq"), "y") \
        .where((F.col("y_seq") < F.col("x_seq")) | (F.col("y_seq") == F.col("x_seq")) & (F.col("y") < F.col("x"))).select("x", "y")
    edges = materialize(edges, "earlier_similar")
    open_nodes, found = materialize(seq.select("id"), "undecided"), []
    while not edges.isEmpty():
        lead = materialize(open_nodes.join(edges.select(F.col("x").alias("id")).distinct(), "id", "left_anti"), "leaders")
        found.append(lead)
        led = edges.join(lead.select(F.col("id").alias("y")), "y", "left_semi").select(F.col("x").alias("id")).distinct()
        led = materialize(led, "led")
        done = led.unionByName(lead)
        open_nodes = materialize(open_nodes.join(done, "id", "left_anti"), "undecided")
        gone = led.select("id")
        edges = materialize(edges.join(gone.toDF("x"), "x", "left_anti").join(gone.toDF("y"), "y", "left_anti"), "earlier_similar")
    for lead in found:
        open_nodes = open_nodes.unionByName(lead)
    return open_nodes


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(prompt_id, class): prompts whose vectors have the same terms and weights share a class."""
    term = F.struct("term", F.round("weight", 12).alias("weight"))
    whole = vectors.groupBy("tenant_id", "prompt_id").agg(F.array_sort(F.collect_list(term)).alias("terms"))  # the terms of one prompt
    return whole.select("prompt_id", F.sha2(F.concat_ws("|", F.col("tenant_id").cast("string"), F.to_json("terms")), 256).alias("class"))


def resolve_in_order(prompts: DataFrame, cache: DataFrame, threshold: float = SEMANTIC_CACHE_THRESHOLD,
                     model: str = PRIMARY_MODEL) -> DataFrame:
    """R-7 with the batch's own answers: one row per prompt, as if prompts were resolved one by one by ``seq``.

    ``prompts``: prompt_id (unique), seq (order), tenant_id, prompt. ``cache``: as for :func:`.cache.resolve`.
    Result: prompt_id, tenant_id, query_hash, ``source`` (cache_exact, cache_semantic or miss), ``cache_id`` of a
    snapshot entry or ``answered_by``, the prompt of the batch whose stored answer is used, ``similarity`` of a semantic hit
    and the snapshot's ``response_text``.

    An exact entry goes first; else the most similar entry stored before the prompt, if it reaches the threshold (ties:
    snapshot entries, then the smaller id). A prompt asked again may therefore find a better entry than at first.
    Prompts without a known term have no vector and are only found by their key.

    Prompts with equal vectors are one node of the similarity graph, so copies make no pairs. What a class can
    be answered by is reduced to the entries that improve on all earlier ones, and an occurrence takes the one in
    force at its place in the batch."""
    key = ["tenant_id", "query_hash"]
    p = materialize(prompts.withColumn("query_hash", prompt_key(F.col("tenant_id"), F.col("prompt"), model)), "batch")
    c = materialize(dedupe_cache(cache), "snapshot")
    first = p.groupBy(*key).agg(F.min_by(F.struct("prompt_id", "prompt", "seq"), F.struct("seq", "prompt_id")).alias("f")) \
        .select(*key, "f.*").join(c.select(*key, F.col("cache_id").alias("exact_id")), key, "left")
    first = materialize(first, "asked")
    rest = first.where(F.col("exact_id").isNull()).drop("exact_id")
    with_emb = c.where(F.col("has_embedding"))
    idf = cache_idf(with_emb)
    vectors = materialize(text_vectors(rest, "prompt_id", "prompt", idf), "batch_vectors")
    cache_vectors = materialize(text_vectors(with_emb, "cache_id", "prompt_text", idf), "cache_vectors")

    # One node for each class of equal vectors: its earliest prompt.
    member = materialize(vector_classes(vectors).join(rest.select("prompt_id", "seq"), "prompt_id"), "classes")
    node = materialize(member.groupBy("class").agg(F.min_by("prompt_id", F.struct("seq", "prompt_id")).alias("id"), F.min("seq").alias("seq")), "nodes")
    node_vectors = vectors.join(node.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi")
    snapshot = materialize(semantic_matches(node_vectors, cache_vectors, threshold), "snapshot_matches")
    open_nodes = node.join(snapshot.select(F.col("prompt_id").alias("id")), "id", "left_anti").select("id", "seq")
    open_vectors = node_vectors.join(open_nodes.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi") \
        .withColumnRenamed("prompt_id", "cache_id")
    pairs = materialize(similar_pairs(node_vectors, materialize(open_vectors, "open_vectors"), threshold)
                        .where(F.col("prompt_id") != F.col("cache_id"))
                        .select(F.col("prompt_id").alias("x"), F.col("cache_id").alias("y"), "similarity"), "batch_pairs")
    both_open = pairs.join(open_nodes.select(F.col("id").alias("x")), "x", "left_semi").select("x", "y")
    lead = materialize(leaders(open_nodes, both_open).join(node.select("id", "seq"), "id"), "entries")

    # What a class can be answered by, from which place in the batch on (-inf: the snapshot).
    entry = lead.select(F.col("id").alias("y"), F.col("seq").alias("since"))
    batch = pairs.join(entry, "y").select(F.col("x").alias("id"), F.col("y").alias("entry"), "since", "similarity", F.lit(1).alias("own"))
    itself = lead.select("id", F.col("id").alias("entry"), F.col("seq").alias("since"), F.lit(1.0).alias("similarity"), F.lit(1).alias("own"))
    old = snapshot.select(F.col("prompt_id").alias("id"), F.col("cache_id").alias("entry"), F.lit(None).cast("long").alias("since"),
                          "similarity", F.lit(0).alias("own"))
    stored = batch.unionByName(itself).unionByName(old).withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS))
    by_age = Window.partitionBy("id").orderBy(F.col("since").asc_nulls_first(), "entry")
    rank = F.struct(-F.col("similarity"), "own", "entry")
    ages = stored.withColumn("best", F.min(rank).over(by_age.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("before", F.lag("best").over(by_age)).where(F.col("before").isNull() | (F.col("best") != F.col("before")))
    ages = ages.withColumn("until", F.lead("since").over(by_age)) \
        .select("id", "entry", "since", "until", "similarity", "own")

    # Occurrences: by key where their key is stored, else by class.
    none = rest.join(member.select("prompt_id"), "prompt_id", "left_anti").select(*key, F.col("prompt_id").alias("stored_by"), "seq")
    kept = rest.join(lead.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi").select(*key, F.col("prompt_id").alias("stored_by"), "seq")
    by_key = none.unionByName(kept).withColumnRenamed("seq", "stored_at")
    to_node = member.select("prompt_id", "class").join(node.select("class", F.col("id")), "class") \
        .join(rest.select("prompt_id", *key), "prompt_id").select(*key, "id")
    asked = p.select("prompt_id", *key, "seq").join(first.select(*key, "exact_id"), key)
    exact = asked.where(F.col("exact_id").isNotNull()).select(
        "prompt_id", *key, F.lit("cache_exact").alias("source"), F.col("exact_id").alias("cache_id"),
        F.lit(None).cast("string").alias("answered_by"), F.lit(None).cast("double").alias("similarity"))
    open_asked = asked.where(F.col("exact_id").isNull()).drop("exact_id").join(by_key, key, "left")
    own = open_asked.where(F.col("stored_by").isNotNull()).select(
        "prompt_id", *key, F.when(F.col("prompt_id") == F.col("stored_by"), "miss").otherwise("cache_exact").alias("source"),
        F.lit(None).cast("string").alias("cache_id"), F.when(F.col("prompt_id") != F.col("stored_by"), F.col("stored_by")).alias("answered_by"),
        F.lit(None).cast("double").alias("similarity"))
    in_force = (F.col("since").isNull() | (F.col("since") < F.col("seq"))) & (F.col("until").isNull() | (F.col("until") >= F.col("seq")))
    semantic = open_asked.where(F.col("stored_by").isNull()).join(to_node, key).join(ages, "id").where(in_force).select(
        "prompt_id", *key, F.lit("cache_semantic").alias("source"), F.when(F.col("own") == 0, F.col("entry")).alias("cache_id"),
        F.when(F.col("own") == 1, F.col("entry")).alias("answered_by"), "similarity")
    found = exact.unionByName(own).unionByName(semantic)
    return found.join(c.select("cache_id", "response_text"), "cache_id", "left").select(
        "prompt_id", *key, "source", "cache_id", "answered_by", "similarity", "response_text")
