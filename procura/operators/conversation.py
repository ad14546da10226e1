"""Prompt keys, conversation tails and route labels (R-6, R-9, R-10, R-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, py_strip, sha256_hex
from .runs import PRIMARY_MODEL

# Routing labels in the order they are tried as substrings,
# and the message-type names used when a conversation is printed.
ROUTE_LABELS = ["supplier_intel", "anomaly", "negotiation", "end"]
FALLBACK_LABEL = "end"
MESSAGE_TYPES = {"user": "human", "assistant": "ai"}
TAIL_MESSAGES = 6


def normalize_prompt(prompt: Column) -> Column:
    """Lower-cased, trimmed, whitespace runs collapsed to one space."""
    return collapse_ws(F.lower(prompt))


def prompt_key(tenant: Column, prompt: Column, model: str | Column = PRIMARY_MODEL) -> Column:
    """R-6: ``sha256("<tenant>:<model>:<normalised prompt>")``."""
    m = F.lit(model) if isinstance(model, str) else model
    return sha256_hex(F.concat_ws(":", tenant.cast("string"), m, normalize_prompt(prompt)))


def conversation_tail(messages: DataFrame, n: int = TAIL_MESSAGES) -> DataFrame:
    """R-9: the last ``n`` messages of each conversation as ``"type: content"`` lines.

    ``row_number() <= n`` is planned as a WindowGroupLimit, so only n rows
    per conversation per task reach the shuffle; the collected list is
    bounded by n."""
    mtype = F.coalesce(F.element_at(F.create_map(*[x for kv in MESSAGE_TYPES.items() for x in map(F.lit, kv)]),
                                    F.col("role")), F.col("role"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    lines = tail.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", mtype, F.col("text")).alias("line"))))
        .alias("msgs"))
    return lines.select("conv_id", F.array_join(F.transform("msgs", lambda m: m["line"]), "\n")
                        .alias("conversation"))


def route_label(reply: Column) -> Column:
    """R-10: normalise a classifier reply to a route; exact label, else the first
    label contained in it (fixed order), else ``end``."""
    cand = py_strip(F.regexp_replace(F.lower(py_strip(reply)), "^[-*• \t]+", ""))
    out = F.lit(FALLBACK_LABEL)
    for lab in reversed(ROUTE_LABELS):
        out = F.when(cand.contains(lab), F.lit(lab)).otherwise(out)
    exact = F.when(cand.isin(*ROUTE_LABELS), cand)
    return F.when(reply.isNull(), F.lit(FALLBACK_LABEL)).otherwise(F.coalesce(exact, out))
