"""Files of SQL statements: splitting, parameters, and what Spark's catalog cannot do in one statement."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import WeftError

_PARTS = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;|(?<![:\w])[:$]([A-Za-z_]\w*)", re.DOTALL)
_CREATE = re.compile(r"\s*create\s+(?:or\s+replace\s+)?table\s+(if\s+not\s+exists\s+)?([\w.`]+)\s+as\s+(.*)", re.IGNORECASE | re.DOTALL)
_DELETE = re.compile(r"\s*delete\s+from\s+([\w.`]+)(?:\s+where\s+(.*))?\s*$", re.IGNORECASE | re.DOTALL)
_INSERT = re.compile(r"\s*insert\s+(?:into|overwrite)\s+(?:table\s+)?([\w.`]+)", re.IGNORECASE)
#: The property of tables whose files a snapshot keeps.
SHARED = "weft.shared"


class SqlTaskError(WeftError):
    pass


def referenced_tables(spark: SparkSession, statement: str) -> list[str]:
    """The tables that a statement names, without its CTEs: last part of each name, in lower case. The tables needn't exist."""
    from ..operators.resolver import parsed, tables_of

    return tables_of(parsed(spark, statement))


def statements(text: str) -> list[str]:
    """Statements parted by semicolons outside quotes and comments."""
    out, at = [], 0
    for m in _PARTS.finditer(text):
        if m[0] == ";":
            out.append(text[at : m.start()])
            at = m.end()
    return [s.strip() for s in [*out, text[at:]] if re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.DOTALL).strip()]


def parameters(statement: str) -> list[str]:
    """Names used as :name or $name outside quotes and comments."""
    return list(dict.fromkeys(m[1] for m in _PARTS.finditer(statement) if m[1]))


def run_statement(spark: SparkSession, statement: str, args: dict[str, Any] | None = None) -> DataFrame:
    """One statement. CREATE [OR REPLACE] TABLE AS writes the table anew, also if it reads itself."""
    text = _PARTS.sub(lambda m: f":{m[1]}" if m[1] else m[0], statement)
    used = {k: v for k, v in (args or {}).items() if k in parameters(statement)}
    if d := _DELETE.match(text):  # tables of plain files are written anew without the rows
        name, new = d[1], f"{d[1].replace('`', '')}__new"
        kept = f"select * from {name}" + (f" where not coalesce({d[2]}, false)" if d[2] else " where false")
        spark.sql(f"drop table if exists {new}")
        spark.sql(kept, args=used or None).write.mode("overwrite").saveAsTable(new)
        _put(spark, new, name)
        return spark.table(name)
    if i := _INSERT.match(text):
        own(spark, i[1])
    m = _CREATE.match(text)
    if not m:
        return spark.sql(text, args=used or None)
    name = m[2]
    if m[1] and spark.catalog.tableExists(name.replace("`", "")):
        return spark.table(name)
    df = spark.sql(m[3], args=used or None)
    new = f"{name.replace('`', '')}__new"
    spark.sql(f"drop table if exists {new}")
    df.write.mode("overwrite").saveAsTable(new)
    _put(spark, new, name)
    return spark.table(name)


def own(spark: SparkSession, name: str) -> None:
    """Makes a table whose files a snapshot keeps a copy of them, before rows are added."""
    if not spark.catalog.tableExists(name.replace("`", "")) or not spark.sql(f"show tblproperties {name}").where(f"key = '{SHARED}'").head(1):
        return
    new = f"{name.replace('`', '')}__new"
    spark.sql(f"drop table if exists {new}")
    spark.table(name).write.saveAsTable(new)
    _put(spark, new, name)


def _put(spark: SparkSession, new: str, name: str) -> None:
    """The table new takes the place of another, which is there until it has."""
    plain, old = name.replace("`", ""), f"{name.replace('`', '')}__old"
    there = spark.catalog.tableExists(plain)
    if there:
        spark.sql(f"drop table if exists {old}")
        spark.sql(f"alter table {name} rename to {old}")
    spark.sql(f"alter table {new} rename to {name}")
    if there:
        spark.sql(f"drop table {old}")


def run_text(spark: SparkSession, text: str, args: dict[str, Any] | None = None) -> DataFrame | None:
    parts, df = statements(text), None
    for i, s in enumerate(parts, 1):
        try:
            df = run_statement(spark, s, args)
        except Exception as e:
            raise SqlTaskError(f"statement {i}/{len(parts)} failed: {s[:120]}: {e}") from e
    return df


_FILE = re.compile(r"\b(csv|json|parquet|text|orc)\.`([^`:/][^`:]*)`", re.IGNORECASE)


def run_file(spark: SparkSession, path: str, args: dict[str, Any] | None = None) -> DataFrame | None:
    """Files that the statements read by a relative path are beside the file of statements."""
    here = Path(path).resolve().parent
    return run_text(spark, _FILE.sub(lambda m: f"{m[1]}.`{here / m[2]}`", Path(path).read_text()), args)
