"""Task state: the last fingerprint of each (storage_key, pipeline_name, task_name)."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StateStoreError
from .log import MergeLog

# The key columns of task state, and the status of a task that is done.
KEY = ["storage_key", "pipeline_name", "task_name"]
SCHEMA = "storage_key string, pipeline_name string, task_name string, output_hash string, status string, ran_at string, seq long, deleted boolean"
ITEMS = "storage_key string, pipeline_name string, task_name string, item string, status string, started_at timestamp, ended_at timestamp, output_hash string, error string, deleted boolean"


def latest(log: DataFrame) -> DataFrame:
    """The current rows of an append-only log: the last of each key, unless it is a deletion."""
    rest = [c for c in log.columns if c not in KEY]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    return last.select(*KEY, "_last.*").where("not deleted").drop("deleted")


class MemoryStore:
    def __init__(self) -> None:
        self.rows: dict[tuple[str, str, str], str] = {}
        self.items: dict[tuple[str, str, str], dict[str, str]] = {}

    def batch(self) -> contextlib.AbstractContextManager[None]:
        """What is written within is kept at its end, at once."""
        return contextlib.nullcontext()

    def item_hashes(self, *key: str) -> dict[str, str]:
        """The fingerprint of each item of a task's list that was well when it was last run."""
        return dict(self.items.get(key, {}))

    def write_items(self, key: tuple[str, str, str], rows: list[tuple[str, str, datetime, datetime, str | None, str | None]]) -> None:
        """rows: item, status, start, end, fingerprint, error; all of a list at once."""
        own = self.items.setdefault(key, {})
        for item, status, _, _, output_hash, _ in rows:
            if status == "SUCCESS" and output_hash is not None:
                own[item] = output_hash
            else:
                own.pop(item, None)

    def read_hash(self, *key: str) -> str | None:
        return self.rows.get(key)

    def write_hash(self, storage_key: str, pipeline: str, task: str, output_hash: str) -> None:
        self.rows[storage_key, pipeline, task] = output_hash

    def delete(self, *key: str) -> None:
        self.rows.pop(key, None)

    def list_tasks(self, storage_key: str, pipeline: str) -> list[str]:
        return sorted(t for s, p, t in self.rows if (s, p) == (storage_key, pipeline))


class NoStore(MemoryStore):
    """Keeps nothing: every task runs."""

    def write_hash(self, storage_key: str, pipeline: str, task: str, output_hash: str) -> None:
        pass

    def write_items(self, key: tuple[str, str, str], rows: list[tuple[str, str, datetime, datetime, str | None, str | None]]) -> None:
        pass


class TableStore(MemoryStore):
    """State as Parquet files that are only added to, and read once for a run; a lost table is begun anew."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path = spark, path
        try:
            found = latest(spark.read.schema(SCHEMA).parquet(path)).collect()  # a row for each task
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = []
        self.rows = {(r.storage_key, r.pipeline_name, r.task_name): r.output_hash for r in found}
        self.log = MergeLog(spark, f"{path.rstrip('/')}-items", ITEMS, [*KEY, "item"])
        self.waiting: list[tuple] | None = None

    @contextlib.contextmanager
    def batch(self) -> Iterator[None]:
        self.waiting = []
        try:
            yield
        finally:
            rows, self.waiting = self.waiting, None
            self._put(rows)

    def _put(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def _add(self, key: tuple[str, ...], output_hash: str | None, deleted: bool) -> None:
        row = (*key, output_hash, "success", datetime.now(UTC).isoformat(), time.time_ns(), deleted)
        if self.waiting is not None:
            self.waiting.append(row)
        else:
            self._put([row])

    def item_rows(self, *key: str) -> DataFrame:
        """item, status, started_at, ended_at, output_hash, error of each item of a task's list, as it was last run."""
        same = [F.col(c) == v for c, v in zip(KEY, key, strict=True)]
        return self.log.current().where(same[0] & same[1] & same[2]).drop(*KEY, "deleted")

    def item_hashes(self, *key: str) -> dict[str, str]:
        rows = self.item_rows(*key).where("status = 'SUCCESS' and output_hash is not null").select("item", "output_hash")
        return {r["item"]: r.output_hash for r in rows.collect()}  # lists are on the driver, and so are their items

    def write_items(self, key: tuple[str, str, str], rows: list[tuple[str, str, datetime, datetime, str | None, str | None]]) -> None:
        if rows:
            self.log.append(self.spark.createDataFrame([(*key, *r, False) for r in rows], ITEMS))

    def write_hash(self, storage_key: str, pipeline: str, task: str, output_hash: str) -> None:
        super().write_hash(storage_key, pipeline, task, output_hash)
        self._add((storage_key, pipeline, task), output_hash, False)

    def delete(self, *key: str) -> None:
        super().delete(*key)
        self._add(key, None, True)

    def compact(self) -> None:
        """One file instead of one for each write. The old folder is kept until the new one is in its place."""
        now = latest(self.spark.read.schema(SCHEMA).parquet(self.path)).withColumn("deleted", F.lit(False))
        new, old = f"{self.path}-{uuid.uuid4().hex}", f"{self.path}-{uuid.uuid4().hex}"
        now.coalesce(1).write.parquet(new)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not (fs.rename(path(self.path), path(old)) and fs.rename(path(new), path(self.path))):
            raise StateStoreError(f"{self.path} could not be put in place; the state is in {old}")
        fs.delete(path(old), True)


def store(kind: str, spark: SparkSession | None = None, path: str | None = None) -> MemoryStore:
    """The store of a kind: memory, none, or table, which takes a folder."""
    if kind == "table":
        if not path:
            raise StateStoreError("a table store needs a folder")
        return TableStore(spark, path)
    if kind not in {"memory", "none"}:
        raise ValueError(f"no store {kind}; there are memory, none, table")
    return MemoryStore() if kind == "memory" else NoStore()
