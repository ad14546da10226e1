"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns evaluated exactly once per row.

    A later filter on a derived column is pushed below projections with
    every alias substituted, which repeats an expensive expression (a JSON
    parse, a rule list) once per reference. Producing the columns from a
    one-element ``inline`` makes them generator output: predicates on them
    stay above the generator and read the stored value."""
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.inline(F.array(packed)))
