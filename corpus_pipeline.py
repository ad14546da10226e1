"""A training corpus out of the table ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor
and returns a DataFrame that is written as Parquet and read again. All but the
last return the columns of ``docs``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import word_count
from procura.llm.exact_dedup import drop_exact_copies
from procura.llm.mixing import mixed_documents
from procura.llm.packing import pack
from procura.llm.quality import good_documents
from procura.llm.simhash import drop_near_copies
from procura.session import shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated, cut or left out to meet their source's target."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, bin_id, capacity, position."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"))
    return pack(sized).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SimHash's XXH64 and the packing plan are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    folder = shared_path(spark, f"pipeline/{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
