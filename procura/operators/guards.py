"""Guardrails over text and SQL columns (G-1, G-2, G-3, G-4, A-11, X-5).

Each screen is a set of built-in column expressions, evaluated inside
whole-stage code generation over any number of rows; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import once
from ..functions.text import py_pattern, py_strip
from ..session import materialize
from .scope import scoped_views
from .sql_plan import refusals

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# PII patterns in application order; each is applied to the already redacted text.
PII_PATTERNS = [
    ("EMAIL", r"[\w.\-]+@[\w.\-]+\.\w+"),
    ("PHONE_IN", r"(?:\+91[-\s]?)?\b[6-9]\d{9}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("PAN_IN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("IFSC_IN", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
]
# Prompt-injection patterns, matched case-insensitively, reported in this order.
INJECTION_PATTERNS = [
    r"ignore (all |the )?(previous|prior|above) instructions",
    r"disregard (all |the )?(previous|prior|above)",
    r"you are now",
    r"system\s*prompt",
    r"new instructions?\s*:",
    r"act as (a|an)\s",
    r"reveal (your|the) (system )?(prompt|instructions)",
    r"forget (everything|all) (you|that)",
    r"</?system>",
    r"\[system\]",
    r"override.*instructions",
]
# SQL screen: forbidden substrings (first in list order is reported) and limits.
FORBIDDEN_SQL_WORDS = [
    "insert", "update", "delete", "drop", "alter", "truncate", "grant",
    "revoke", "create", "execute", "call", "copy", "vacuum", "reindex",
    "--", "/*", "*/", "pg_", "information_schema",
]
MAX_LIMIT = 200
DEFAULT_LIMIT = 50
MSG_MULTI = "Multiple statements are not allowed."
MSG_NOT_SELECT = "Only SELECT statements are allowed."
MSG_FORBIDDEN = "Forbidden keyword detected: '%s'"
AGENT_BLOCKED = "sql_agent:blocked"
AGENT_EXECUTE = "sql_agent:execute"
# ---------------------------------------------------------------------------


def redact_pii(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """G-1: adds ``redacted_text`` and ``findings`` (array of (type, count), count > 0).

    Stages are separate projections so each intermediate text is computed
    once (the optimizer keeps projections apart rather than repeat a regex)."""
    cur = f"{prefix}_pii0"
    out = df.withColumn(cur, F.col(text_col))
    counts = []
    for i, (kind, pat) in enumerate(PII_PATTERNS, start=1):
        jp = py_pattern(pat)
        n = f"{prefix}n_{kind.lower()}"
        nxt = f"{prefix}_pii{i}"
        out = out.withColumn(n, F.regexp_count(F.col(cur), F.lit(jp))) \
                 .withColumn(nxt, F.regexp_replace(F.col(cur), jp, f"[REDACTED_{kind}]")) \
                 .drop(cur)
        counts.append((kind, n))
        cur = nxt
    findings = F.filter(
        F.array(*[F.struct(F.lit(k).alias("type"), F.col(n).cast("int").alias("count"))
                  for k, n in counts]),
        lambda s: s["count"] > 0)
    return out.withColumnRenamed(cur, f"{prefix}redacted_text") \
        .withColumn(f"{prefix}findings", findings) \
        .drop(*[n for _, n in counts])


def pii_counts(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """A-11: one row per (id, PII type) with its match count, types with no match omitted."""
    red = redact_pii(df.select(*id_cols, text_col), text_col)
    return red.select(*id_cols, F.explode("findings").alias("f")) \
        .select(*id_cols, F.col("f.type").alias("pii_type"), F.col("f.count").alias("match_count"))


def injection_matches(text: Column) -> Column:
    """G-2: array of the patterns that match, in pattern order."""
    return F.array_compact(F.array(*[
        F.when(text.rlike(py_pattern(p, ignore_case=True)), F.lit(p)) for p in INJECTION_PATTERNS]))


def scan_injection(df: DataFrame, text_col: str = "text") -> DataFrame:
    """G-2: adds ``matched_patterns`` and ``is_suspicious``."""
    return df.withColumn("matched_patterns", injection_matches(F.col(text_col))) \
        .withColumn("is_suspicious", F.size("matched_patterns") > 0)


def extraction_gate(docs: DataFrame, text_col: str, kind: str) -> DataFrame:
    """X-5: documents that match an injection pattern are not extracted.

    Returns every document with ``gate_status`` (``BLOCKED_INJECTION`` or
    ``ADMITTED``) and, for blocked ones, the run-log error text."""
    s = scan_injection(docs, text_col)
    return s.select(
        *[c for c in docs.columns if c != text_col],
        F.lit(f"extractor:{kind}").alias("agent_name"),
        F.when(F.col("is_suspicious"), "BLOCKED_INJECTION").otherwise("ADMITTED").alias("gate_status"),
        F.when(F.col("is_suspicious"), F.format_string(
            "Matched patterns: [%s]",
            F.array_join(F.transform("matched_patterns", lambda p: F.concat(F.lit("'"), p, F.lit("'"))),
                         ", "))).alias("error_message"))


def _limit_too_big(digits: Column) -> Column:
    """``int(digits) > MAX_LIMIT`` for an unbounded digit string."""
    d = F.regexp_replace(digits, "^0+", "")
    cap = str(MAX_LIMIT)
    return (F.length(d) > len(cap)) | ((F.length(d) == len(cap)) & (d > F.lit(cap)))


def screen_sql(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    """G-3 / Q-9: adds ``allowed``, ``reason`` and ``safe_sql``.

    Check order fixes the reported reason: ';' inside, then SELECT-only, then
    the first forbidden substring. Without a ``limit n`` a LIMIT 50 is
    appended; when the first ``limit n`` exceeds 200, every ``limit n`` becomes
    LIMIT 200."""
    raw = F.col(sql_col)
    stripped = F.regexp_replace(py_strip(raw), ";+$", "")
    lowered = F.lower(F.col("_stripped"))
    forbidden = F.coalesce(*[F.when(F.col("_lowered").contains(w), F.lit(w))
                             for w in FORBIDDEN_SQL_WORDS])
    limit_re = r"\blimit\s+(\d+)\b"
    reason = (F.when(F.col("_stripped").contains(";"), F.lit(MSG_MULTI))
              .when(~F.col("_stripped").rlike(py_pattern(r"^\s*select\b", ignore_case=True)),
                    F.lit(MSG_NOT_SELECT))
              .when(F.col("_forbidden").isNotNull(),
                    F.format_string(MSG_FORBIDDEN, F.col("_forbidden"))))
    has_limit = F.col("_lowered").rlike(py_pattern(limit_re))
    first_n = F.regexp_extract(F.col("_lowered"), py_pattern(limit_re), 1)
    safe = (F.when(F.col("reason").isNotNull(), F.lit(None).cast("string"))
            .when(~has_limit, F.concat(F.col("_stripped"), F.lit(f" LIMIT {DEFAULT_LIMIT}")))
            .when(_limit_too_big(first_n),
                  F.regexp_replace(F.col("_stripped"), py_pattern(r"\blimit\s+\d+\b", True),
                                   f"LIMIT {MAX_LIMIT}"))
            .otherwise(F.col("_stripped")))
    # Stripped text and reason are produced once per row (see functions.plan.once), so a
    # later filter on ``allowed`` does not re-inline the whole screen into its predicate.
    staged = once(df, _stripped=stripped).withColumn("_lowered", lowered) \
        .withColumn("_forbidden", forbidden)
    return once(staged, reason=reason) \
        .withColumn("allowed", F.col("reason").isNull()) \
        .withColumn("safe_sql", safe) \
        .drop("_stripped", "_lowered", "_forbidden")


PREVIEW_ROWS = 20  # rows shown with the full row count


def preview(result: DataFrame, n: int = PREVIEW_ROWS) -> tuple[int, DataFrame]:
    """Q-9: the full row count and the first ``n`` rows of a guarded result, from one execution.

    The result is stored as it is computed and counted on the way (an observed metric), so count and preview
    show the same answer even if its tables change. Columns are stored by position, so repeated names and
    untyped NULLs are kept; a row's place in the result's order is stored with it."""
    counted = Observation()
    stored = [F.col(f"c{i}").cast("string") if kind == "void" else F.col(f"c{i}") for i, (_, kind) in enumerate(result.dtypes)]
    placed = result.toDF(*[f"c{i}" for i in range(len(result.columns))]).select(
        *[c.alias(f"c{i}") for i, c in enumerate(stored)], F.monotonically_increasing_id().alias("place"))
    kept = materialize(placed.observe(counted, F.count(F.lit(1)).alias("rows")), "guarded_result")
    first = kept.orderBy("place").limit(n).drop("place")
    shown = first.select(*[F.lit(None) if kind == "void" else F.col(f"c{i}") for i, (_, kind) in enumerate(result.dtypes)])
    return counted.get["rows"], shown.toDF(*result.columns)


OUTSIDE = "Query reads something other than the tenant's tables."


def _run_scoped(spark: SparkSession, tables: dict[str, DataFrame], tenant_id, sql: str) -> DataFrame:
    """Analyse ``sql`` over the tenant's views, which exist for that moment only."""
    refused = refusals(spark, sql, tables)
    if refused:
        raise SQLBlocked(f"{OUTSIDE} Refused: {', '.join(refused)}.")
    views = scoped_views(spark, tables, tenant_id)
    try:
        return spark.sql(sql)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


class SQLBlocked(Exception):
    """Raised by :func:`guarded_query` when the screen refuses a statement."""


def guarded_query(spark: SparkSession, tables: dict[str, DataFrame], tenant_id, sql: str,
                  preview_rows: int = 20) -> tuple[DataFrame, str]:
    """G-4: screen one statement, expose only the tenant's rows, run it with Spark SQL.

    Returns ``(result_frame, safe_sql)``; :func:`preview` counts and shows its rows. Raises
    :class:`SQLBlocked` with the reason: the screen's, or what :func:`.sql_plan.refusals` found."""
    screened = screen_sql(spark.createDataFrame([(sql,)], "sql string")).first()
    if not screened["allowed"]:
        raise SQLBlocked(screened["reason"])
    return _run_scoped(spark, tables, tenant_id, screened["safe_sql"]), screened["safe_sql"]


def blocked_run_rows(screened: DataFrame, id_col: str = "query_id", sql_col: str = "sql") -> DataFrame:
    """G-4 / S-7: a run-log row for every refused statement of a screened log
    (status ERROR, ``"<reason> | generated_sql=<statement>"``, cost 0)."""
    return screened.where(~F.col("allowed")).select(
        "tenant_id", F.col(id_col).alias("run_id"), F.lit(AGENT_BLOCKED).alias("agent_name"),
        F.lit("ERROR").alias("status"),
        F.concat(F.col("reason"), F.lit(" | generated_sql="), F.col(sql_col)).alias("error_message"),
        F.lit(0).cast("decimal(18,6)").alias("estimated_cost_usd"))


def run_guarded(spark: SparkSession, tables: dict[str, DataFrame], tenant_id, sql: str, run_id: str,
                preview_rows: int = PREVIEW_ROWS) -> dict:
    """G-4 end to end for one statement: screen, run over the tenant's views, count,
    and describe the run-log row (blocked, failed or succeeded). The preview is a
    DataFrame of at most ``preview_rows`` rows; nothing else reaches the driver."""
    import time
    start = time.time()
    screened = screen_sql(spark.createDataFrame([(sql,)], "sql string")).first()
    if not screened["allowed"]:
        reason = screened["reason"]
        return {"generated_sql": sql, "error": reason, "row_count": None, "rows": None,
                "run": (tenant_id, run_id, AGENT_BLOCKED, "ERROR", None, f"{reason} | generated_sql={sql}")}
    safe = screened["safe_sql"]
    try:
        count, rows = preview(_run_scoped(spark, tables, tenant_id, safe), preview_rows)
    except SQLBlocked as e:
        return {"generated_sql": safe, "error": str(e), "row_count": None, "rows": None,
                "run": (tenant_id, run_id, AGENT_BLOCKED, "ERROR", None, f"{e} | generated_sql={sql}")}
    except Exception as e:  # analysis or execution failure is reported, as the reference does
        return {"generated_sql": safe, "error": str(e), "row_count": None, "rows": None,
                "run": (tenant_id, run_id, AGENT_EXECUTE, "ERROR", None, f"{e} | sql={safe}")}
    latency = int((time.time() - start) * 1000)
    return {"generated_sql": safe, "error": None, "row_count": count, "rows": rows,
            "run": (tenant_id, run_id, AGENT_EXECUTE, "SUCCESS", latency, None)}
