"""Rows of tasks and of their subtasks: written in batches, changed where they are, and read as relations.

Both are logs, so a change of many rows is one append of those rows as they are now. An update touches rows that are there, and nothing else; deleting a
task takes its subtasks with it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StateStoreError
from . import relations
from .log import MergeLog

# The key of a task's row.
KEY = ["storage_key", "pipeline_name", "task_name"]
TASKS = "storage_key string, pipeline_name string, task_name string, status string, code_hash string, input_hash string, data_hash string, output_hash string, subtask_count long, started_at timestamp, ended_at timestamp, updated_at timestamp, deleted boolean"
SUBTASKS = "storage_key string, pipeline_name string, task_name string, idx long, item string, started_at timestamp, ended_at timestamp, output_hash string, deleted boolean"


class TaskRows:
    """Tasks and subtasks of one pipeline. place: a shared folder, in which other pipelines may have rows too."""

    def __init__(self, spark: SparkSession, place: str, storage_key: str, pipeline: str) -> None:
        self.spark, self.own = spark, {"storage_key": storage_key, "pipeline_name": pipeline}
        self.tasks = MergeLog(spark, f"{place}/tasks", TASKS, KEY)
        self.parts = MergeLog(spark, f"{place}/subtasks", SUBTASKS, [*KEY, "idx"])

    def _of(self, log: MergeLog) -> DataFrame:
        rows = log.current()
        return rows.where((F.col("storage_key") == self.own["storage_key"]) & (F.col("pipeline_name") == self.own["pipeline_name"]))

    def _filled(self, rows: DataFrame, log: MergeLog) -> DataFrame:
        """rows with all columns of the log; those they lack are null, and none is deleted."""
        if unknown := [c for c in rows.columns if c not in log.columns]:
            raise StateStoreError(f"no column {', '.join(unknown)}; there are {', '.join(log.columns)}")
        more: dict[str, Column] = {c: F.lit(v) for c, v in self.own.items()} | {"deleted": F.lit(False)}
        return rows.withColumns(more | {c: F.lit(None) for c in log.columns if c not in rows.columns and c not in more})

    def put(self, rows: DataFrame) -> None:
        """Tasks by task_name, new ones and ones that replace what is there."""
        self.tasks.append(self._filled(rows, self.tasks).withColumn("updated_at", F.current_timestamp()))

    def list(self) -> DataFrame:
        """All tasks, by name."""
        return self._of(self.tasks).drop("deleted", *self.own).orderBy("task_name")

    def get(self, task: str) -> dict[str, Any] | None:
        rows = self.list().where(F.col("task_name") == task).collect()
        return rows[0].asDict() if rows else None

    def set(self, rows: DataFrame) -> None:
        """rows(task_name, columns): these columns of tasks that are there become what they say, nulls too."""
        changed = [c for c in rows.columns if c != "task_name"]
        self._filled(rows, self.tasks)
        now = self._of(self.tasks).join(rows.select("task_name", *(F.col(c).alias(f"_{c}") for c in changed)), "task_name")
        self.tasks.append(now.withColumns({c: F.col(f"_{c}") for c in changed} | {"updated_at": F.current_timestamp()}))

    def delete(self, names: DataFrame) -> None:
        """names(task_name): these tasks go, with their subtasks."""
        for log in (self.parts, self.tasks):
            log.append(self._of(log).join(names.select("task_name").distinct(), "task_name", "left_semi").withColumn("deleted", F.lit(True)))

    def create_subtasks(self, items: DataFrame, count: bool = True) -> None:
        """items(task_name, idx, item) as the subtasks of their tasks, which have none but these then; count: the tasks say how many."""
        lost = self._of(self.parts).join(items.select("task_name").distinct(), "task_name", "left_semi").join(items.select("task_name", "idx"), ["task_name", "idx"], "left_anti")
        self.parts.append(self._filled(items.select("task_name", "idx", "item"), self.parts).select(*self.parts.columns).union(lost.withColumn("deleted", F.lit(True)).select(*self.parts.columns)))
        if count:
            self.set(items.groupBy("task_name").agg(F.count("*").alias("subtask_count")))

    def subtasks(self) -> DataFrame:
        """task_name, idx, item, started_at, ended_at, output_hash."""
        return self._of(self.parts).drop("deleted", *self.own)

    def started(self, which: DataFrame) -> None:
        """which(task_name, idx): subtasks that begin now, and have no end yet."""
        now = self._of(self.parts).join(which.select("task_name", "idx"), ["task_name", "idx"], "left_semi")
        self.parts.append(now.withColumns({"started_at": F.current_timestamp(), "ended_at": F.lit(None)}))

    def ended(self, which: DataFrame) -> None:
        """which(task_name, idx, output_hash): subtasks that end now; a fingerprint that is null leaves the one before."""
        now = self._of(self.parts).join(which.select("task_name", "idx", F.col("output_hash").alias("_hash")), ["task_name", "idx"])
        self.parts.append(now.withColumns({"ended_at": F.current_timestamp(), "output_hash": F.coalesce("_hash", "output_hash")}))

    def decisions(self, now: DataFrame) -> DataFrame:
        """now(task_name, code_hash, input_hash, data_hash, ignore_cache, selected) to task_name, should_run, reason, array_size.

        The reason is the first of relations.submission_reason() that holds. Mapped tasks that run have the number of their subtasks. Tasks that aren't selected don't run.
        """
        then = self.list().select("task_name", "status", "subtask_count", "ended_at", *(F.col(c).alias(f"_{c}") for c in ("code_hash", "input_hash", "data_hash")))
        rows = now.join(then, "task_name", "left")
        pair = lambda c: (F.col(c), F.col(f"_{c}"))
        reason = relations.submission_reason(F.col("ignore_cache"), F.lit(False), F.col("status"), pair("code_hash"), pair("input_hash"), pair("data_hash"), F.col("ended_at"))
        reason = F.when(~F.col("selected"), "Task not selected").otherwise(reason)
        runs = F.col("selected") & F.col("reason").isNotNull()
        return rows.withColumn("reason", reason).select("task_name", runs.alias("should_run"), "reason", F.when(runs, F.col("subtask_count")).alias("array_size"))
