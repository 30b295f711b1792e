"""Bounded looks into tables and queries."""

from __future__ import annotations

import datetime
import functools
import operator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sql import statements


def any_filter(df: DataFrame, clauses: str) -> DataFrame:
    """Rows for which one of the clauses, parted by semicolons, holds; all rows without clauses."""
    parts = [F.expr(c) for c in statements(clauses)]
    return df.where(functools.reduce(operator.or_, parts)) if parts else df


def mentions(df: DataFrame, clause: str) -> bool:
    """Whether a clause for all tables is about one of this table's columns."""
    import re

    words = {w.lower() for w in re.findall(r"\w+", clause)}
    return any(c.lower() in words for c in df.columns)


def padded(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, in order, found in any case; null for those that are not there."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns))


def _shown(v: Any) -> Any:
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    return v if v is None or isinstance(v, (str, int, float, bool)) else str(v)


def preview(df: DataFrame, limit: int = 5, where: str = "", columns: list[str] | None = None) -> dict[str, Any]:
    """columns, rows and limit (1 to 200) of the first rows."""
    limit = max(1, min(200, limit))
    df = any_filter(df, where)
    df = padded(df, columns) if columns else df
    rows = [[_shown(v) for v in r] for r in df.limit(limit).collect()]
    return {"columns": df.columns, "rows": rows, "row": rows[0] if rows else None, "limit": limit}


def query_preview(spark: Any, text: str, limit: int = 5) -> dict[str, Any]:
    """preview() of one statement that reads; ValueError for several."""
    if len(statements(text)) != 1:
        raise ValueError("one statement is needed")
    return preview(spark.sql(statements(text)[0]), limit)


def output_table(outputs: list[str], name: str) -> str:
    """The declared table that a name means: its whole name, else the last part of one. KeyError for names that no output has."""
    tables = [u.removeprefix("table://") for u in outputs if u.startswith("table://")]
    last = name.rpartition(".")[2].lower()
    for same in (lambda t: t.lower() == name.lower(), lambda t: t.rpartition(".")[2].lower() == last):
        if found := [t for t in tables if same(t)]:
            return found[0]
    raise KeyError(f"no output {name}; there are {', '.join(tables)}")


def columns(df: DataFrame) -> list[str]:
    return list(df.columns)
