"""Audit and approval tables (D-1 .. D-6, S-13).

Rows are built as set operations over a decisions table. An edit's line diff is an array
expression over the two texts (:func:`line_diff`), bounded by one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256_hex, split_lines
from .guards import redact_pii

ENTITY_TYPE = "negotiation_email"
DEFAULT_ACTOR = "unknown_reviewer"
DRAFT_ACTOR = "agent"
# Decision word -> audit action; anything else (or missing) rejects.
DECISION_ACTIONS = {"approve": "APPROVED", "edit": "EDITED"}
REJECTED = "REJECTED"
DRAFTED = "DRAFTED"
APPROVAL_NOTE = "Not to be sent before a person has read and released it."


def content_hash(text: Column) -> Column:
    """D-2: SHA-256 hex of the UTF-8 text."""
    return sha256_hex(text)


def decision_action(action: Column) -> Column:
    """D-4: approve -> APPROVED, edit -> EDITED, anything else -> REJECTED."""
    out = F.lit(REJECTED)
    for word, act in reversed(list(DECISION_ACTIONS.items())):
        out = F.when(action == word, F.lit(act)).otherwise(out)
    return out


def line_diff(original: Column, edited: Column) -> Column:
    """D-1 / D-3: removed and added lines with their numbers, ``array<struct<sign,line_no,line>>``,
    empty where the texts are equal.

    Lines shared at the start and at the end are left out; of the rest, the original's lines are removed
    (numbered in the original) and the edit's added (numbered in the edit). So every changed,
    inserted, dropped or moved line shows, in order, in time linear in the two texts. NULL is an empty text."""
    text = [F.coalesce(c, F.lit("")) for c in (original, edited)]
    o, e = (split_lines(c) for c in text)

    def common(a: Column, b: Column) -> Column:
        at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)))

    def numbered(sign: str, lines: Column, head: Column, tail: Column) -> Column:
        middle = F.slice(lines, head + 1, F.greatest(F.lit(0), F.size(lines) - head - tail))
        return F.transform(middle, lambda x, i: F.struct(F.lit(sign).alias("sign"), (head + i + 1).alias("line_no"),
                                                         x.alias("line")))

    def middle(p: Column) -> Column:
        head, tail = p["head"], F.least(p["tail"], F.least(F.size(p["o"]), F.size(p["e"])) - p["head"])
        return F.concat(numbered("-", p["o"], head, tail), numbered("+", p["e"], head, tail))

    parts = F.struct(o.alias("o"), e.alias("e"), common(o, e).alias("head"),
                     common(F.reverse(o), F.reverse(e)).alias("tail"))
    # One-element transform: the lines are split once, not for each use.
    changed = F.element_at(F.transform(F.array(parts), middle), 1)
    return F.when(text[0] != text[1], changed).otherwise(
        F.array().cast("array<struct<sign:string,line_no:int,line:string>>"))


def audit_row(tenant: Column, entity_type: Column, entity_id: Column, action: Column,
              original: Column, edited: Column, actor: Column, created_at: Column) -> Column:
    """D-1: one audit record. Edited text defaults to the original; the hash is of
    the edited text; payloads are ``{"text": ...}`` JSON; ``diff`` is the :func:`line_diff`."""
    edited = F.coalesce(edited, original)
    return F.struct(
        sha256_hex(F.concat_ws("|", tenant.cast("string"), entity_type, entity_id.cast("string"),
                               action)).alias("audit_id"),
        tenant.alias("tenant_id"), entity_type.alias("entity_type"), entity_id.alias("entity_id"),
        action.alias("action"),
        F.to_json(F.struct(original.alias("text"))).alias("original_payload"),
        F.to_json(F.struct(edited.alias("text"))).alias("edited_payload"),
        (edited != original).alias("changed"), line_diff(original, edited).alias("diff"),
        actor.alias("actor"), sha256_hex(edited).alias("content_hash"),
        created_at.alias("created_at"))


def audit_rows(decisions: DataFrame, entity_type: str = ENTITY_TYPE) -> DataFrame:
    """D-1 / D-4 / S-13: a DRAFTED row per entity, plus a decision row when a decision exists.

    ``decisions``: tenant_id, entity_id, original_text, edited_text, action
    (NULL = still pending), optional actor and drafted_at."""
    cols = decisions.columns
    actor = F.col("actor") if "actor" in cols else F.lit(None).cast("string")
    drafted_at = F.col("drafted_at") if "drafted_at" in cols else \
        F.expr("timestampadd(SECOND, cast(entity_id as bigint), timestamp_ntz'1970-01-01 00:00:00')")
    et = F.lit(entity_type)
    drafted = audit_row(F.col("tenant_id"), et, F.col("entity_id"), F.lit(DRAFTED),
                        F.col("original_text"), F.lit(None).cast("string"), F.lit(DRAFT_ACTOR),
                        drafted_at)
    act = decision_action(F.col("action"))
    decided = audit_row(F.col("tenant_id"), et, F.col("entity_id"), act, F.col("original_text"),
                        # approve keeps the draft; edit and reject keep any edited text
                        F.when(act == "APPROVED", F.lit(None).cast("string"))
                         .otherwise(F.col("edited_text")),
                        F.coalesce(actor, F.lit(DEFAULT_ACTOR)),
                        F.timestamp_add("SECOND", F.lit(1), drafted_at))
    rows = decisions.select(F.inline(F.when(
        F.col("action").isNull(), F.array(drafted)).otherwise(F.array(drafted, decided))))
    return rows


def approval_lifecycle(audit: DataFrame) -> DataFrame:
    """D-5: per entity, counts of drafts and decisions and the derived state
    (PENDING = drafted only; DECIDED = one draft and one decision; else INVALID)."""
    a = F.col("action")
    g = audit.groupBy("tenant_id", "entity_id").agg(
        F.count_if(a == DRAFTED).alias("n_drafted"),
        F.count_if(a.isin("APPROVED", "EDITED", REJECTED)).alias("n_decisions"),
        F.max(F.when(a != DRAFTED, a)).alias("decision"))
    return g.withColumn("state", F.when((F.col("n_drafted") == 1) & (F.col("n_decisions") == 0), "PENDING")
                        .when((F.col("n_drafted") == 1) & (F.col("n_decisions") == 1), "DECIDED")
                        .otherwise("INVALID"))


def line_changes(pairs: DataFrame) -> DataFrame:
    """D-3: net line counts of an edit; :func:`ordered_changes` has the places.

    Lines are exploded and counted per (entity, line) on each side; a line
    appearing k times in the original and m times in the edit gives
    min(k, m) kept and the rest added or removed. Grouped counting keeps a
    document with many repeated lines from landing in one task."""
    base = pairs.where(F.col("edited_text").isNotNull() & (F.col("edited_text") != F.col("original_text")))
    orig = base.select("tenant_id", "entity_id", F.explode(split_lines(F.col("original_text"))).alias("line"),
                       F.lit(1).alias("o"), F.lit(0).alias("e"))
    edit = base.select("tenant_id", "entity_id", F.explode(split_lines(F.col("edited_text"))).alias("line"),
                       F.lit(0).alias("o"), F.lit(1).alias("e"))
    c = orig.unionByName(edit).groupBy("tenant_id", "entity_id", "line") \
        .agg(F.sum("o").alias("n_orig"), F.sum("e").alias("n_edit"))
    kept = F.least("n_orig", "n_edit")
    return c.select("tenant_id", "entity_id", "line",
                    (F.col("n_orig") - kept).alias("n_removed"),
                    (F.col("n_edit") - kept).alias("n_added"),
                    kept.alias("n_kept")) \
        .where((F.col("n_removed") > 0) | (F.col("n_added") > 0))


def ordered_changes(pairs: DataFrame) -> DataFrame:
    """D-3: one row per removed (-) or added (+) line of an edited text, with its line number."""
    base = pairs.where(F.col("edited_text").isNotNull() & (F.col("edited_text") != F.col("original_text")))
    return base.select("tenant_id", "entity_id", F.inline(line_diff(F.col("original_text"), F.col("edited_text"))))


def draft_decisions(drafts: DataFrame) -> DataFrame:
    """D-6: dispute drafts as pending decisions, for :func:`audit_rows` to log as DRAFTED."""
    return drafts.select("tenant_id", F.col("supplier_id").alias("entity_id"), F.col("draft_text").alias("original_text"),
                         F.lit(None).cast("string").alias("edited_text"), F.lit(None).cast("string").alias("action"))


def dispute_drafts(flagged: DataFrame, suppliers: DataFrame) -> DataFrame:
    """D-6 (re-aimed): one dispute draft per flagged supplier, from a fixed template,
    PII-redacted, ready to be logged as DRAFTED.

    The issue summary is built from per-supplier aggregates (counts and the
    summed overcharge), never from a gathered list of invoices."""
    agg = flagged.groupBy("tenant_id", "supplier_id").agg(
        F.count_if(F.col("check_type") == "PRICE_VARIANCE").alias("n_price"),
        F.count_if(F.col("check_type") == "DUPLICATE_PO").alias("n_dup"),
        F.count_if(F.col("check_type") == "MISSING_CONTRACT").alias("n_missing"),
        F.sum("variance_amount").cast("decimal(38,5)").alias("overcharge"))
    s = suppliers.select("tenant_id", "supplier_id", F.col("name").alias("supplier_name"))
    body = F.format_string(
        "Dear %s billing team,\n\nOur reconciliation found %d invoice lines priced above contract "
        "(summed unit-price excess %s), %d lines billed against a purchase order already invoiced, and "
        "%d lines with no active contract price. Please review these items and send corrected "
        "invoices or supporting documents.\n\n" + APPROVAL_NOTE,
        F.col("supplier_name"), F.col("n_price"), F.coalesce(F.col("overcharge").cast("string"), F.lit("0")),
        F.col("n_dup"), F.col("n_missing"))
    drafts = agg.join(s, ["tenant_id", "supplier_id"], "inner").withColumn("draft_raw", body)
    return redact_pii(drafts, "draft_raw").select(
        "tenant_id", "supplier_id", "supplier_name", "n_price", "n_dup", "n_missing",
        F.col("redacted_text").alias("draft_text"),
        (F.size(F.split(F.col("redacted_text"), r"\s+")) < 150).alias("under_150_words"))
