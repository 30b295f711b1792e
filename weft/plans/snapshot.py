"""Checkpoints: what a pipeline's tasks have made so far, as tables in a shared folder, and the state that goes with it.

A task with checkpoint=True is followed by a snapshot: a manifest of the tables that the tasks up to it declare, and of their rows of the state store. A table's rows are
in a folder named by their fingerprint, so snapshots between which it didn't change share it, and what no manifest names is deleted. The
manifest is written last, so a snapshot that was interrupted is none. A run that finds no state of its pipeline begins with the
furthest snapshot of which every task is as it was, and deletes those that are out of date. One run of a pipeline at a time may write snapshots.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import table_fingerprint
from ..operators.log import delete, hadoop
from ..sources.sql import SHARED

MANIFEST = "task string, kind string, name string, value string"


@dataclass(frozen=True)
class Snapshot:
    task: str
    path: str
    hashes: dict[str, str]
    tables: dict[str, str]  # by name, the folder of their rows

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.tables[name])

    def rows(self, spark: SparkSession, name: str, digests: Any) -> DataFrame | str:
        """A table, or with kept digests its fingerprint."""
        return digests.rows(self.table(spark, name), self.tables[name]) if digests else self.table(spark, name)


def folder(spark: SparkSession, place: str | None, pipeline: str) -> str | None:
    """place, or the session's checkpoint folder; without either there are no checkpoints."""
    place = place or spark.conf.get("spark.checkpoint.dir", None)
    return f"{place}/snapshots/{pipeline}" if place else None


def _whole(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(at))


def _kept(spark: SparkSession, place: str, table: str, digests: Any) -> str:
    """The folder with the rows of a table, which is written if there is none yet."""
    address = digests.table(table) if digests else table_fingerprint(spark.table(table))
    path = f"{place}/objects/{address}"
    if not _whole(spark, path):
        new = f"{place}/objects/.{address}-{uuid.uuid4().hex}"
        spark.table(table).write.parquet(new)
        delete(spark, path)
        fs, at = hadoop(spark, new)
        fs.rename(at, hadoop(spark, path)[1])
    return address


def save(spark: SparkSession, place: str, task: str, tables: Iterable[str], hashes: dict[str, str], digests: Any = None) -> None:
    """Writes a snapshot beside those of the same task, and then deletes these."""
    old = [s for s in found(spark, place) if s.task == task]
    path = f"{place}/tasks/{task}/{uuid.uuid4().hex}"
    rows = [(task, "table", t, _kept(spark, place, t, digests)) for t in tables if spark.catalog.tableExists(t)] + [(task, "state", k, v) for k, v in sorted(hashes.items())]
    spark.createDataFrame(rows or [(task, "none", None, None)], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    for s in old:
        delete(spark, s.path)
    sweep(spark, place)


def found(spark: SparkSession, place: str) -> list[Snapshot]:
    """The whole snapshots of a pipeline."""
    fs, at = hadoop(spark, f"{place}/tasks")
    if not fs.exists(at):
        return []
    paths = [one.getPath().toString() for task in fs.listStatus(at) for one in fs.listStatus(task.getPath())]
    if not (paths := [p for p in paths if _whole(spark, f"{p}/manifest")]):
        return []
    rows = spark.read.schema(MANIFEST).parquet(*(f"{p}/manifest" for p in paths)).select("*", F.regexp_extract("_metadata.file_path", "/([0-9a-f]{32})/manifest/", 1).alias("id")).collect()  # a row for each task and table
    out = []
    for path in paths:
        own = [r for r in rows if r.id == path.rpartition("/")[2]]
        out.append(Snapshot(own[0].task, path, {r.name: r.value for r in own if r.kind == "state"}, {r.name: f"{place}/objects/{r.value}" for r in own if r.kind == "table"}))
    return out


def references(spark: SparkSession, place: str) -> dict[str, int]:
    """How many manifests name each folder of rows; 0 for what none does."""
    fs, at = hadoop(spark, f"{place}/objects")
    count = {f.getPath().getName(): 0 for f in fs.listStatus(at)} if fs.exists(at) else {}
    for s in found(spark, place):
        for path in set(s.tables.values()):
            name = path.rpartition("/")[2]
            count[name] = count.get(name, 0) + 1
    return count


def sweep(spark: SparkSession, place: str) -> None:
    """Deletes folders of rows that no manifest names."""
    for name, n in references(spark, place).items():
        if not n:
            delete(spark, f"{place}/objects/{name}")


def candidate(spark: SparkSession, place: str, tasks: list[Any], fresh: Callable[[Any, Snapshot], str | None]) -> Snapshot | None:
    """The snapshot of the furthest task, of tasks in order, at which all before it with outputs are as they were. fresh: a task's fingerprint with the snapshot's tables."""
    names = [t.name for t in tasks]
    for s in sorted(found(spark, place), key=lambda s: names.index(s.task) if s.task in names else -1, reverse=True):
        before = tasks[: names.index(s.task) + 1] if s.task in names else []
        if before and all(_whole(spark, path) for path in s.tables.values()) and all(s.hashes.get(t.name) == fresh(t, s) for t in before if t.outputs and t.kind in {"python", "sql"}):
            return s
        delete(spark, s.path)
    sweep(spark, place)
    return None


def restore(spark: SparkSession, s: Snapshot, write_hash: Callable[[str, str], None]) -> None:
    """Makes the snapshot's tables those of the session, where they are, and its state the store's. A statement that adds to such a table makes it a copy first."""
    for t, path in s.tables.items():
        spark.sql(f"drop table if exists {t}")
        spark.catalog.createTable(t, path, "parquet")
        spark.sql(f"alter table {t} set tblproperties ('{SHARED}' = 'true')")
    for task, value in s.hashes.items():
        write_hash(task, value)
