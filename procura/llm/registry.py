"""Queries ``opN_*`` of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import once
from ..session import materialize
from . import (alignment, chat, exact_dedup, licenses, mixing, packing, periodic, quality, sharding, simhash, substring,
               topk, url_filter)
from .common import lower_ascii, word_count, words
from .oracles import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL"]

# The URL rules of the query op4.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, site prior and posterior quality; hosts are sources, paths languages."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.classify(docs, labels).select(
        F.col("id").alias("doc_id"), *[F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "site_prior", "quality")], "keep")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies. The result needs every row's digest, so the operator is given it as the full hash."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text") \
        .withColumn("digest", F.sha2(lower_ascii(F.col("text")), 256))
    return exact_dedup.exact_dedup(docs, hash_col="digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of near copies."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.simhash_groups(docs).select(
        F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    rules = spark.createDataFrame(list(URL_RULES), url_filter.RULE_SCHEMA)
    return url_filter.filter_urls(_read(spark, sf_dir, "pages", "page_id", "url"), rules, payload=("page_id",))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 512, 1024, 2048 or 4096 words."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", word_count(F.col("text")).alias("size"))
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of every document."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text") \
        .select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = materialize(docs, "mix_sizes")  # texts are read once
    return mixing.mix_sources(docs, mixing.cyclic_weights(docs)) \
        .select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, source by source in proportion; shard counts differ by at most one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(docs, SHARDS, tie_cols=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has as well, removed."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return substring.substring_dedup(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector's five best inner products."""
    return topk.top_k(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in documents, short ones as well."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return licenses.scan_licenses(docs, licenses.notices(spark, short=True)).withColumnRenamed("id", "doc_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of the byte-level and the piece tokenizer in every document, and their links' corpus counts."""
    return alignment.align_documents(_read(spark, sf_dir, "documents", "doc_id", "text")) \
        .select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all documents; where crc32 of the id says so, the words from one on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    read = once(docs.select("doc_id", "text"), _g=F.floor(h / 10).cast("long"),
                _words=F.when(chosen, words(F.col("text"))).otherwise(F.array().cast("array<string>")))
    n = F.size("_words")
    read = once(read.withColumn("_a", F.try_mod("_g", n)),
                _p=F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)).cast("long"))
    repeated = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return read.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the strongest of them, and digests of the runs and of the text without repeats."""
    docs = planted_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))
    found = once(periodic.periodic_runs(docs), best=periodic.strongest("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# Fixed value: what both turns of the added conversation -1 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 that speaks in control strings, formatted and read back."""
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, chat.USER, CONTROL_TEXT), (-1, 1, chat.ASSISTANT, CONTROL_TEXT)], turns.schema)
    trees = chat.chains(turns.unionByName(added), "conv_id", ["turn", "role", "text"], ["role", "text"])
    return chat.read_back(chat.format_conversations(trees)).withColumnRenamed("tree", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_simhash, op4_url_filter, op5_packing, op6_mixing,
                            op7_sharding, op8_substring_dedup, op9_topk_search, op10_licenses, op11_alignment,
                            op12_periodic, op13_chat)}
