"""Column-expression helpers for text: normalisation, regex flags, hashing.

Python's ``re`` treats ``\\w``, ``\\d``, ``\\s`` and ``\\b`` as Unicode classes;
Java needs the ``(?U)`` flag for the same behaviour, and ``(?d)`` so that
``.`` stops only at ``\\n`` as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PY_RE = "(?dU)"         # Python-like classes, '.' excludes only '\n'
PY_RE_ICASE = "(?idU)"  # same, case-insensitive (Unicode case folding)


def py_pattern(pattern: str, ignore_case: bool = False) -> str:
    return (PY_RE_ICASE if ignore_case else PY_RE) + pattern


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """``" ".join(s.split())``: runs of Unicode whitespace to one space, ends trimmed."""
    return py_strip(F.regexp_replace(c, r"(?U)\s+", " "))


def sha256_hex(c: Column) -> Column:
    """SHA-256 hex digest of the UTF-8 bytes."""
    return F.sha2(c, 256)


def strip_fences(c: Column) -> Column:
    """X-7: remove markdown code fences (```json and ```), then strip."""
    return py_strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


# Line breaks recognised by str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def split_lines(c: Column) -> Column:
    """``str.splitlines()``: an array of lines; a final line break adds no empty line."""
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})$", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))
