"""Column expressions and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but the ASCII blanks (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays. NULL becomes ''.

    ASCII texts take the faster general ``lower``, which is the same for them."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)) \
        .otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text, in order. NULL and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, underscored until no column of ``df`` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*parts: Column) -> Column:
    """One exact, NULL-safe string key out of several columns.

    Joins use it instead of the grouping columns themselves. An aggregate's
    output is partitioned by its own keys, so Spark would join it without a
    shuffle, and then cannot split a hot key; a derived key gives both sides a
    plain exchange, whose skewed partitions AQE splits."""
    safe = []
    for p in parts:
        text = p.cast("string")
        safe.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *safe)
