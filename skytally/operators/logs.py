"""Log line filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Markers of errors anywhere, and of lines worth keeping about a subject.
GLOBAL_ERRORS = [" ERROR ", " CRITICAL ", "Traceback", "Exception"]
DIAGNOSTICS = [
    "weatherrecord supervisor", "event cache refreshed", "timing refresh", "timing unavailable", "weatherrecord poll",
    "weatherrecord extreme", "clob momentum candidate", "clob momentum baseline", "clob momentum trigger", "price momentum",
    "tgftp window", "metar buy", "skip_buy", "order submitted", "order filled", "submit_buy", "ERROR", "CRITICAL",
    "Traceback", "Exception", "failed", "timeout", "timed out", "429",
]
STAMP = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})"


def with_stamp(lines: DataFrame, value: str = "value") -> DataFrame:
    text = F.col(value)
    part = lambda i: F.when(text.rlike(STAMP), F.regexp_extract(text, STAMP, i))
    return lines.withColumn("line_date", part(1)).withColumn("line_time", part(2))


def in_time_range(date: str = "", start: str = "", end: str = "") -> Column:
    """String comparison of the stamp; lines without one are out."""
    ok = F.col("line_date").isNotNull()
    if date:
        ok = ok & (F.col("line_date") == date)
    if start:
        ok = ok & (F.col("line_time") >= start)
    if end:
        ok = ok & (F.col("line_time") <= end)
    return ok


def _any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words if w))


def filter_lines(
    lines: DataFrame, subjects: Sequence[str], all_matches: bool = False, global_errors: bool = False,
    diagnostics: Sequence[str] = DIAGNOSTICS, date: str = "", start: str = "", end: str = "", value: str = "value",
) -> DataFrame:
    """Keep global errors, and subject lines that are diagnostic (or all of them)."""
    if not any(subjects):
        raise ValueError("name at least one subject")
    text = F.col(value)
    low = F.lower(text)
    keep = _any(low, [s.lower() for s in subjects])
    if not all_matches:
        keep = keep & _any(low, [d.lower() for d in diagnostics])
    if global_errors:
        keep = keep | _any(text, GLOBAL_ERRORS)
    return with_stamp(lines, value).filter(in_time_range(date, start, end) & keep)
