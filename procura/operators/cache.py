"""Prompt cache: exact and semantic resolution, hit counts and upsert
(R-7, J-7, J-8, A-10, S-11, S-12).

A batch of prompts is resolved against one cache snapshot. Each distinct
(tenant, key) is resolved once, however often it is asked: first by an
equi-join on (tenant, key); the rest are matched semantically; the rest
miss. The answers are joined back to the prompts; repeats of a missed key are
marked as repeats of the first (they would hit once the first is answered).

The semantic tier finds, for each prompt, the most similar cache entry of
its tenant with cosine >= threshold. The vectors of a tenant are dealt into
blocks, every prompt block meets every cache block in one group, and a group
scores its pairs exactly in memory (common terms by a matrix product, the others
by their postings) and reports the pairs at or above the threshold, or the best one of
each prompt. Pairs are neither shuffled nor stored: the vectors are, once per block
of the other side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import TIE_DIGITS, block_pairs
from .conversation import prompt_key
from .runs import PRIMARY_MODEL
from .search import corpus_idf, term_table, tfidf_weights

SEMANTIC_CACHE_THRESHOLD = 0.75  # fixed value: inclusive similarity threshold
BLOCK = 8192  # vectors of a block


def text_vectors(texts: DataFrame, id_col: str, text_col: str, idf: DataFrame) -> DataFrame:
    """(tenant_id, id, term, weight) unit-length TF-IDF vectors in the space of ``idf``."""
    return tfidf_weights(term_table(texts, id_col, text_col), id_col, idf) \
        .select("tenant_id", id_col, "term", "weight")


def cache_idf(cache: DataFrame) -> DataFrame:
    """Term idf over the cached prompts (the cache's embedding space)."""
    return corpus_idf(term_table(cache, "cache_id", "prompt_text"), "cache_id")


def _packed(vectors: DataFrame, id_col: str) -> DataFrame:
    """(tenant_id, id, terms, weights): one row per vector. A vector without a tenant meets no other."""
    v = vectors.where(F.col("tenant_id").isNotNull()).groupBy("tenant_id", F.col(id_col).alias("id")) \
        .agg(F.collect_list(F.struct("term", "weight")).alias("v"))  # the terms of one text
    return v.select("tenant_id", "id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))


def _met(pvec: DataFrame, cvec: DataFrame, threshold: float, best: bool, block: int = BLOCK) -> DataFrame:
    """(prompt_id, cache_id, similarity): pairs of a tenant with similarity >= threshold, or with ``best`` the best of
    each prompt and block. The vectors of a tenant are dealt into blocks of about ``block``; every prompt block
    meets every cache block in one group (:func:`.blocks.block_pairs`), so no candidate pair is shuffled or stored."""
    sides = {"p": _packed(pvec, "prompt_id"), "c": _packed(cvec, "cache_id")}
    blocks = None
    for side, v in sides.items():
        n = v.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"{side}_blocks"))
        blocks = n if blocks is None else blocks.join(n, "tenant_id")
    blocks = F.broadcast(materialize(blocks, "blocks"))  # one row a tenant
    dealt = {}
    for side, other in (("p", "c"), ("c", "p")):
        own = F.pmod(F.xxhash64("id"), F.col(f"{side}_blocks")).cast("int").alias(side)
        dealt[side] = sides[side].join(blocks, "tenant_id").select(
            "tenant_id", own, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other), "id", "terms", "weights")
    kind = {side: v.schema["id"].dataType.simpleString() for side, v in sides.items()}
    key = ["tenant_id", "p", "c"]

    def score(prompts: pa.Table, cache: pa.Table) -> pa.Table:
        return block_pairs(prompts, cache, threshold, best)

    return dealt["p"].groupBy(*key).cogroup(dealt["c"].groupBy(*key)) \
        .applyInArrow(score, f"prompt_id {kind['p']}, cache_id {kind['c']}, similarity double")


def similar_pairs(pvec: DataFrame, cvec: DataFrame, threshold: float) -> DataFrame:
    """(prompt_id, cache_id, similarity) of all pairs of a tenant with similarity >= threshold.
    Exact; see module doc."""
    return _met(pvec, cvec, threshold, best=False)


def semantic_matches(pvec: DataFrame, cvec: DataFrame, threshold: float) -> DataFrame:
    """(prompt_id, cache_id, similarity) for the best cache entry of each prompt with
    similarity >= threshold (ties to the smallest cache id)."""
    sims = _met(pvec, cvec, threshold, best=True)
    # Best per prompt: highest similarity, then smallest cache id, out of one row a cache block.
    best = sims.groupBy("prompt_id").agg(F.min_by(
        F.struct("cache_id", "similarity"), F.struct(-F.round("similarity", TIE_DIGITS), F.col("cache_id"))).alias("b"))
    return best.select("prompt_id", F.col("b.cache_id").alias("cache_id"), F.col("b.similarity").alias("similarity"))


def dedupe_cache(cache: DataFrame) -> DataFrame:
    """One entry per (tenant, key), the smallest cache id: the unique constraint of the
    cache table. A grouped min (partial aggregation) picks the id, so a key repeated
    by a third of all rows is reduced map-side; the row is then fetched by its id."""
    keep = cache.groupBy("tenant_id", "query_hash").agg(F.min("cache_id").alias("cache_id"))
    return cache.join(keep, ["tenant_id", "query_hash", "cache_id"], "left_semi")


def resolve(prompts: DataFrame, cache: DataFrame, threshold: float = SEMANTIC_CACHE_THRESHOLD,
            model: str = PRIMARY_MODEL, checkpoint: bool = True) -> DataFrame:
    """R-7: one row per prompt: source (cache_exact / cache_semantic / batch_repeat /
    miss), the cache entry and text used, and the similarity of a semantic hit.

    ``prompts``: prompt_id, seq (batch order), tenant_id, prompt.
    ``cache``: cache_id, tenant_id, query_hash, prompt_text, response_text, has_embedding.

    The keyed batch, its distinct keys, the deduplicated snapshot and both vector
    tables feed several branches, so with ``checkpoint`` they are written once to the
    shared checkpoint folder instead of being re-derived per branch."""
    keep = materialize if checkpoint else (lambda d: d)
    p = keep(prompts.withColumn("query_hash", prompt_key(F.col("tenant_id"), F.col("prompt"), model)))
    c = keep(dedupe_cache(cache))
    key = ["tenant_id", "query_hash"]
    first = p.groupBy(*key).agg(F.min_by(F.struct("prompt_id", "prompt"), "seq").alias("_f"))
    asked = keep(first.select(*key, F.col("_f.prompt_id").alias("first_prompt_id"), F.col("_f.prompt").alias("prompt"))
                 .join(c.select(*key, F.col("cache_id").alias("exact_id")), key, "left"))
    rest = asked.where(F.col("exact_id").isNull()).select("tenant_id", F.col("first_prompt_id").alias("prompt_id"), "prompt")
    with_emb = c.where(F.col("has_embedding"))
    idf = cache_idf(with_emb)
    sem = semantic_matches(keep(text_vectors(rest, "prompt_id", "prompt", idf)),
                           keep(text_vectors(with_emb, "cache_id", "prompt_text", idf)), threshold) \
        .select(F.col("prompt_id").alias("first_prompt_id"), F.col("cache_id").alias("semantic_id"), "similarity")
    texts = c.select("cache_id", "response_text")
    answers = asked.drop("prompt").join(sem, "first_prompt_id", "left") \
        .withColumn("cache_id", F.coalesce("exact_id", "semantic_id")).join(texts, "cache_id", "left")
    missed = F.col("cache_id").isNull()
    repeat = F.col("prompt_id") != F.col("first_prompt_id")
    return p.select("prompt_id", *key).join(answers, key).select(
        "prompt_id", *key, "cache_id",
        F.when(F.col("exact_id").isNotNull(), "cache_exact").when(~missed, "cache_semantic")
         .when(repeat, "batch_repeat").otherwise("miss").alias("source"),
        "similarity", F.when(missed, F.col("first_prompt_id")).alias("first_prompt_id"), "response_text")


def hit_counts(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """S-12: each cache entry with its hit counter raised by this batch's hits."""
    hits = resolved.where(F.col("source").isin("cache_exact", "cache_semantic")) \
        .groupBy("cache_id").agg(F.count(F.lit(1)).alias("_hits"))
    return cache.join(hits, "cache_id", "left").withColumn(
        "hit_count", (F.col("hit_count") + F.coalesce("_hits", F.lit(0))).cast("bigint")).drop("_hits")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """S-11: merge new answers on (tenant, key). An existing entry keeps its id, prompt
    text, embedding and model, takes the new response (also a NULL one) and resets
    hit_count to 0; a new key is inserted. Within ``new`` the latest row (largest seq) per key wins.

    Plain files have no MERGE, so this is a full outer join written as a new version."""
    cols = [c for c in new.columns if c not in ("tenant_id", "query_hash", "seq")]
    latest = new.groupBy("tenant_id", "query_hash").agg(F.max_by(F.struct(*cols), "seq").alias("_n"))
    n = latest.select("tenant_id", "query_hash", "_n.*")
    o = cache.alias("o")
    j = o.join(n.alias("n"), ["tenant_id", "query_hash"], "full_outer")
    both = F.col("o.cache_id").isNotNull() & F.col("n.cache_id").isNotNull()
    return j.select(
        F.coalesce("o.cache_id", "n.cache_id").alias("cache_id"), "tenant_id", "query_hash",
        F.coalesce("o.prompt_text", "n.prompt_text").alias("prompt_text"),
        F.when(F.col("n.cache_id").isNotNull(), F.col("n.response_text"))
         .otherwise(F.col("o.response_text")).alias("response_text"),
        F.coalesce("o.model_used", "n.model_used").alias("model_used"),
        F.coalesce("o.has_embedding", "n.has_embedding").alias("has_embedding"),
        F.when(both | F.col("o.cache_id").isNull(), F.lit(0).cast("bigint"))
         .otherwise(F.col("o.hit_count")).alias("hit_count"))
