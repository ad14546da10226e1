"""Vector arithmetic as built-in higher-order expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dense dot product of two equal-length arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """``1 - cosine distance``; NULL when either vector has zero norm."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_with_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine when norms are precomputed (once per stored vector, not per pair)."""
    return F.try_divide(dot(a, b), norm_a * norm_b)


def vector_literal(a: Column) -> Column:
    """R-2b: text form ``[a,b,…]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
