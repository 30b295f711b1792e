"""Files that are written in whole versions: a write goes to a folder of its own, is read back and checked, and counts from the moment its mark is renamed into place.

Readers take the last version that has a mark, so they see all rows of one write or of the one before, also if a writer stops between the two. Versions that are replaced stay for
readers that have begun, until so many newer ones are there.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from ..errors import WeftError
from ..functions.fingerprint import fingerprint_of, summary, table_summary
from ..operators.log import delete, hadoop

#: Versions that are kept.
KEPT = 2
_MARK = "PUBLISHED"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# How formats are written, so that nulls, empty texts, spaces, line ends and parts of seconds come back.
_OPTIONS = {
    "csv": {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": _TIME},
    "json": {"ignoreNullFields": "false", "timestampFormat": _TIME},
    "parquet": {},
    "orc": {},
}
FORMATS = frozenset(_OPTIONS)


class SinkError(WeftError):
    """What was written isn't what was to be written; readers still see the version before."""


def _options(kind: str) -> dict[str, str]:
    if kind not in _OPTIONS:
        raise ValueError(f"no format {kind}; there are {', '.join(_OPTIONS)}")
    return _OPTIONS[kind]


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Writes a version that no reader sees yet, reads it back and checks that the rows are those that were written, by their number and sums of their hashes; its name, for publish().

    Not every value can be in every format (in CSV the text \\N is a null): then the check fails.
    """
    spark = df.sparkSession
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *summary(df)).write.format(kind).options(**_options(kind)).partitionBy(*partition_by).save(f"{path}/{name}/data")
    wrote = seen.get
    about = {"format": kind, "schema": json.loads(df.schema.json()), "rows": wrote["n_rows"]}
    back = _read(spark, f"{path}/{name}", about)
    there = table_summary(back).first()
    if there.n_rows != wrote["n_rows"]:
        raise SinkError(f"{path}: {wrote['n_rows']} rows were written, {there.n_rows} are there")
    if (there.h1, there.h2) != (wrote["h1"], wrote["h2"]):
        raise SinkError(f"{path}: the rows that are there are not those that were written")
    spark.createDataFrame([(json.dumps(about | {"fingerprint": fingerprint_of(back.schema, there)}),)], "about string").coalesce(1).write.text(f"{path}/{name}/_about")
    return name


def publish(spark: SparkSession, path: str, name: str, keep: int = KEPT) -> None:
    """Makes a version the one that readers take, and deletes those that are older than so many."""
    fs, at = hadoop(spark, f"{path}/{name}/_about")
    if not fs.rename(at, hadoop(spark, f"{path}/{name}/{_MARK}")[1]):
        raise SinkError(f"{path}: {name} could not be published")
    for old in versions(spark, path)[:-keep]:
        delete(spark, f"{path}/{old}")


def put(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """write() and publish()."""
    name = write(df, path, kind, partition_by)
    publish(df.sparkSession, path, name)
    return name


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions, the last one last."""
    fs, at = hadoop(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in names if n.startswith("v-") and fs.exists(hadoop(spark, f"{path}/{n}/{_MARK}")[1])]


def _about(spark: SparkSession, path: str) -> tuple[str, dict[str, Any]]:
    found = versions(spark, path)
    if not found:
        raise SinkError(f"{path}: nothing is published")
    return found[-1], json.loads(spark.read.text(f"{path}/{found[-1]}/{_MARK}").first().value)


def _read(spark: SparkSession, place: str, about: dict[str, Any]) -> DataFrame:
    schema = T.StructType.fromJson(about["schema"])
    return spark.read.schema(schema).format(about["format"]).options(**_options(about["format"])).load(f"{place}/data").select(*(f"`{c}`" for c in schema.names))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last published version, in the columns and kinds that were written."""
    name, about = _about(spark, path)
    return _read(spark, f"{path}/{name}", about)


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """That of the rows of the last published version; None if there is none."""
    return _about(spark, path)[1]["fingerprint"] if versions(spark, path) else None
