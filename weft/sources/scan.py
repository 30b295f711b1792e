"""Files of several formats as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file or folder of CSV (with a header), JSON lines or Parquet, by its ending."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", "true").option("inferSchema", str(schema is None).lower()).csv(path)
    if kind in {"json", "jsonl", "ndjson"}:
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no scan of {path}")


def scan_all(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Several scans, columns matched by name; null where one has no such column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (scan(spark, p, schema) for p in paths))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
