"""Read-only ad-hoc SQL with a hard row cap."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab as V

DEFAULT_ROWS, HARD_ROWS = 100, 500


def check_query(query: str) -> str:
    """The single SELECT/WITH statement, or ValueError."""
    body = query.strip()
    if body.endswith(";"):
        body = body[:-1].strip()
    if not body:
        raise ValueError("query is empty")
    if ";" in body:
        raise ValueError("only one statement is allowed")
    if body.split(None, 1)[0].lower() not in ("select", "with"):
        raise ValueError("only SELECT or WITH is allowed")
    if re.search(r"\b(" + "|".join(V.MUTATING_SQL_WORDS) + r")\b", body, re.I):
        raise ValueError("changing keywords are not allowed")
    if re.search(r"\bselect\b[\s\S]*\binto\b", body, re.I):
        raise ValueError("SELECT INTO is not allowed")
    return body


def capped_sql(spark: SparkSession, query: str, max_rows: int = DEFAULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row report). One row beyond the cap is fetched to know whether the result was cut."""
    cap = max(1, min(max_rows, HARD_ROWS))
    probe = spark.sql(check_query(query)).limit(cap + 1)
    report = probe.selectExpr(f"least(count(1), {cap}) AS row_count", f"count(1) > {cap} AS truncated")
    return probe.limit(cap), report
