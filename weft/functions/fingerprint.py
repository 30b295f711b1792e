"""Fingerprints of tables, files and code."""

from __future__ import annotations

import ast
import hashlib
import inspect
import re
import textwrap
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import HashError

#: Bytes of joined texts that go to the driver at once, and of a column that may go there in all.
BLOCK, MOST = 1 << 20, 1 << 33


def column_digests(df: DataFrame, most: int = MOST) -> DataFrame:
    """column_name, digest: md5 of each column's texts in order, joined by commas; `null` for columns without values. HashError for columns of more bytes than most.

    Equal texts are counted, then sorted by ranges and joined to blocks where they are; only the md5, which is defined over all of
    them in order, reads block after block in the driver. Columns are measured first, in one pass; for large tables see table_fingerprint.
    """
    sizes = df.agg(*(F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string")).cast("long") + 1), F.lit(0)).alias(f"s{i}") for i, c in enumerate(sorted(df.columns)))).first()
    if large := [c for i, c in enumerate(sorted(df.columns)) if sizes[f"s{i}"] > most]:
        raise HashError(f"columns of more than {most} bytes: {', '.join(large)}")
    rows = [(c, _column_digest(df.select(F.col(f"`{c}`").cast("string").alias("v")))) for c in sorted(df.columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, digest string")


def _column_digest(values: DataFrame) -> str:
    """md5 of the values of v in order, joined by commas."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[bytes] = []
        size = 0

        def out(block: bytes, times: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([block], pa.binary()), pa.array([times], pa.int64())], ["block", "times"])

        for batch in batches:
            for v, n in zip(batch.column("v").to_pylist(), batch.column("n").to_pylist(), strict=True):
                text = v.encode() + b","
                if len(text) * n > BLOCK:
                    if part:
                        yield out(b"".join(part), 1)
                    part, size = [], 0
                    yield out(text, n)
                    continue
                part.append(text * n)
                size += len(text) * n
                if size >= BLOCK:
                    yield out(b"".join(part), 1)
                    part, size = [], 0
        if part:
            yield out(b"".join(part), 1)

    counted = values.where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy("v")
    digest, last = hashlib.md5(), None
    for r in counted.mapInArrow(blocks, "block binary, times long").toLocalIterator(prefetchPartitions=True):
        if last is not None:
            digest.update(last)
        block = bytes(r.block)
        at_once = max(1, BLOCK // len(block))
        whole, rest = divmod(r.times - 1, at_once)
        many = block * at_once if whole else b""
        for _ in range(whole):
            digest.update(many)
        digest.update(block * rest)
        last = block
    if last is None:
        return "null"
    digest.update(last[:-1])  # no comma after the last value
    return digest.hexdigest()


def compatible_fingerprint(df: DataFrame) -> str:
    """md5 of the row count and the column digests; of `empty:` for no rows."""
    rows = df.count()
    if not rows:
        return hashlib.md5(b"empty:").hexdigest()
    digests = [r.digest for r in column_digests(df).orderBy("column_name").collect()]
    return hashlib.md5(f"{rows}:{';'.join(digests)}".encode()).hexdigest()


def _xxhash(row: list[Column], lane: int) -> Column:
    return F.xxhash64(*([F.lit(1)] if lane else []), *row)


def portable(row: list[Column], lane: int) -> Column:
    """A row hash below 2^60 that other engines have too: hexadecimal digits of the md5 of the columns' texts, each with its length before it, or a dash for a null."""
    text = F.concat(*(F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in row))
    return F.conv(F.substring(F.md5(text), 1 + 15 * lane, 15), 16, 10).cast("long")


def summary(df: DataFrame, row_hash: Callable[[list[Column], int], Column] = _xxhash) -> list[Column]:
    """Aggregates of a table's rows: n_rows, and two order-free sums of row hashes, h1 and h2."""
    row = [F.col(f"`{c}`") for c in sorted(df.columns)]
    big = "decimal(38,0)"
    total = lambda h: F.coalesce(F.sum(h.cast(big)), F.lit(0).cast(big))
    return [F.count(F.lit(1)).alias("n_rows"), total(row_hash(row, 0)).alias("h1"), total(row_hash(row, 1)).alias("h2")]


def table_summary(df: DataFrame, row_hash: Callable[[list[Column], int], Column] = _xxhash) -> DataFrame:
    """One row: the row count and two order-free sums of row hashes (of 64 bits, or portable ones), aggregated before they are shuffled."""
    return df.agg(*summary(df, row_hash))


def fingerprint_of(schema: T.StructType, s: Any) -> str:
    """That of a table with a schema and a row of table_summary()."""
    return hashlib.sha256(f"{schema.json()}|{s.n_rows}|{s.h1}|{s.h2}".encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> str:
    """The default for tables of any size: schema, rows and both sums."""
    return fingerprint_of(df.schema, table_summary(df).first())


def file_fingerprint(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def files_fingerprint(spark: Any, path: str) -> DataFrame:
    """path, digest of every file below a folder, hashed where Spark reads them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("digest"))


def _plain(fn: Any) -> str:
    tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.ClassDef, ast.Module)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant):
            n.body = n.body[1:] or [ast.Pass()]
    return ast.dump(tree)


def _named(code: Any, scope: dict[str, Any]) -> Iterator[Any]:
    """What the code, and the code of functions within it, may call: its global names, and their attributes where they are modules."""
    names = code.co_names
    for name in names:
        found = scope.get(name)
        yield found
        modules = [found] if inspect.ismodule(found) else []
        while modules:  # a.b.fn(): b is a name of the same code
            m = modules.pop()
            for g in (vars(m).get(a) for a in names):
                yield g
                if inspect.ismodule(g) and g.__name__.startswith(m.__name__ + "."):
                    modules.append(g)
    for inner in code.co_consts:
        if inspect.iscode(inner):
            yield from _named(inner, scope)


def _codes(f: Any) -> list[tuple[Any, dict[str, Any]]]:
    """The code of a function, or of the methods and properties of a class, each with the names that it sees."""
    if not inspect.isclass(f):
        return [(f.__code__, f.__globals__)] if hasattr(f, "__code__") else []
    found = []
    for member in vars(f).values():
        parts = [member.fget, member.fset, member.fdel] if isinstance(member, property) else [getattr(member, "__func__", member)]
        found += [(m.__code__, m.__globals__) for p in parts if inspect.isfunction(m := inspect.unwrap(p) if callable(p) else p)]
    return found


def code_fingerprint(fn: Any) -> str:
    """Of a function and the functions and classes of its package that it names, alone or through their module, without comments, docstrings and layout. A class counts with its methods and the classes it is derived from."""
    fn = inspect.unwrap(fn)
    root = (fn.__module__ or "").split(".")[0]
    seen: dict[str, str] = {}
    todo = [fn]
    while todo:
        f = inspect.unwrap(todo.pop())
        key = f"{f.__module__}.{f.__qualname__}"
        if key in seen:
            continue
        try:
            seen[key] = _plain(f)
        except (OSError, TypeError, SyntaxError):
            seen[key] = repr(getattr(f, "__code__", None) and f.__code__.co_code)
        named = [g for code, scope in _codes(f) for g in _named(code, scope)] + (list(f.__bases__) if inspect.isclass(f) else [])
        for g in named:
            g = g if inspect.ismodule(g) or inspect.isclass(g) else getattr(g, "run", g)
            if (inspect.isfunction(g) or inspect.isclass(g)) and (g.__module__ or "").split(".")[0] == root:
                todo.append(g)
    return hashlib.sha256(":".join(hashlib.sha256(seen[k].encode()).hexdigest() for k in sorted(seen)).encode()).hexdigest()


def row_fingerprint(df: DataFrame, most: int = MOST) -> str:
    """md5 of the md5s of the rows (as JSON) in order; of a fixed text for no rows. The digests go through the driver: HashError if they have more bytes than most; for large tables see table_fingerprint."""
    n = df.count()
    if 32 * n > most:
        raise HashError(f"digests of {n} rows")
    if not n:
        return hashlib.md5(b"empty-table").hexdigest()
    rows = df.select(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).alias("h"))
    digest = hashlib.md5()
    for r in rows.orderBy("h").toLocalIterator(prefetchPartitions=True):
        digest.update(r.h.encode())
    return digest.hexdigest()


def object_fingerprint(value: Any) -> str:
    """SHA-1 of an object's text."""
    return hashlib.sha1(str(value).encode()).hexdigest()


def output_files(spark: Any, pattern: str, values: dict[str, Any] | None = None) -> dict[str, str]:
    """Digests by path of the files that a pattern names, on any file system that Spark reads: ${name} is its value, or anything."""
    pattern = re.sub(r"\$\{(\w+)\}", lambda m: str((values or {}).get(m[1], "*")), pattern)
    if not _exists(spark, pattern):
        return {}
    rows = spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("digest"))
    return {r.path: r.digest for r in rows.orderBy("path").collect()}  # a row for each file


def _exists(spark: Any, pattern: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def output_fingerprint(spark: Any, outputs: tuple[str, ...], table: Callable[[str], DataFrame | str | None] | None = None, digests: Any = None) -> str | None:
    """Of a task's outputs: files and folders on any file system, and tables written `table://name`. None if it has none or one is missing. table: reads tables, or gives their fingerprints, if not the session. digests: kept ones, of which files that haven't changed are taken."""
    parts = []
    for uri in outputs:
        if uri.startswith("table://"):
            name = uri.removeprefix("table://")
            df = table(name) if table else spark.table(name) if spark.catalog.tableExists(name) else None
            if df is None:
                return None
            parts.append(df if isinstance(df, str) else digests.table(name) if digests and not table else table_fingerprint(df))
        elif uri.partition("://")[0] in {"csv", "json", "parquet", "orc"}:  # published files
            from ..sources import sink

            if (found := sink.fingerprint(spark, uri.partition("://")[2])) is None:
                return None
            parts.append(found)
        elif "://" not in uri and Path(uri).is_file():
            parts.append(file_fingerprint(uri))
        elif not _exists(spark, uri):
            return None
        elif digests:
            parts.append(digests.folder(uri))
        else:
            rows = files_fingerprint(spark, uri).agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "digest").cast("decimal(38,0)")).alias("h")).first()
            parts.append(f"{rows.n}:{rows.h}")
    return hashlib.sha256(":".join(sorted(parts)).encode()).hexdigest() if parts else None
