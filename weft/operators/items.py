"""Tasks over the items of a relation: group after group, on executors, with items, states and results as rows.

Items are numbered. So many consecutive ones are a bundle, which is what is run again as a whole, and so many bundles a group. The next group begins only if all of this one is
well. Groups of many items are a job each; small ones share a job, whose tasks Spark's barrier mode begins together and which agree after each group. The rows of a job, each with
the item's state and its result, are appended to a log at once, so state and result cannot differ; a job that has run for a while begins no other group, so a driver that is lost
costs no more than that. A later run goes on at the first bundle that isn't well: an item is done if its row says so for the same item and the same fingerprint. Rows of numbers that there are no more go.
"""

from __future__ import annotations

import contextlib
import secrets
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Listener
from typing import Any

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TaskError
from .log import MergeLog, stored

# The status of an item.
SUCCESS, FAILURE = "SUCCESS", "FAILURE"
#: Results of a bin.
BIN = 500
#: Bundles of a group, and items of a bundle, unless a task says otherwise.
GROUP, BUNDLE = 64, 1000
#: Items of the groups that share a job, at most, and seconds after which a job begins no other group.
SHARED, LONG = 1 << 20, 60.0
_STATE = "idx long, bin long, item string, bundle long, status string, started_at timestamp, ended_at timestamp, output_hash string, error string, deleted boolean"
#: Named in an error.
_SHOWN = 3


def apart(df: DataFrame) -> DataFrame:
    """df with the fields of its struct columns as columns of their own: the parts of composite keys."""
    out = [F.col(f"`{f.name}`.`{g.name}`").alias(g.name) if g else F.col(f"`{f.name}`") for f in df.schema for g in (f.dataType if isinstance(f.dataType, T.StructType) else [None])]
    return df.select(*out)


@dataclass
class Results:
    """The rows of a task's items. place: a folder of its own; schema: the columns of a result, in SQL."""

    spark: SparkSession
    place: str
    schema: str

    def __post_init__(self) -> None:
        self.log = MergeLog(self.spark, self.place, f"{_STATE}, value struct<{_fields(self.spark, self.schema)}>", ["idx"], merge_at=256)

    def state(self) -> DataFrame:
        """idx, item, bundle, status, started_at, ended_at, output_hash, error of each item, as it was last run."""
        return self.log.current().drop("value", "bin", "deleted")

    def values(self) -> DataFrame:
        """idx and the columns of the result, of the items that are well."""
        return self.log.current().where(F.col("status") == SUCCESS).select("idx", "value.*")

    def bundles(self) -> DataFrame:
        """bundle, n_ok, n_items, status."""
        good, n = F.count_if(F.col("status") == SUCCESS), F.count("*")
        return self.log.current().groupBy("bundle").agg(good.alias("n_ok"), n.alias("n_items"), F.when(good == n, SUCCESS).when(good == 0, FAILURE).otherwise("INCOMPLETE").alias("status"))

    def put(self, values: DataFrame, output_hash: str) -> None:
        """Takes rows (idx, columns of the result) as a whole result; those beyond the last idx go."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        now = F.current_timestamp()
        state = [F.col("idx").cast("long"), F.floor(F.col("idx") / BIN).cast("long").alias("bin"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("bundle"), F.lit(SUCCESS).alias("status"), now.alias("started_at"), now.alias("ended_at"), F.lit(output_hash).alias("output_hash"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("deleted")]
        rows = values.select(*state, F.struct(*(F.col(f"`{c}`") for c in names)).cast(f"struct<{_fields(self.spark, self.schema)}>").alias("value"))
        self.log.replace(rows)

    def output_hash(self) -> str | None:
        """The fingerprint under which the whole result was put; None if there is none."""
        rows = self.log.current().select("output_hash").distinct().limit(2).collect()
        return rows[0].output_hash if len(rows) == 1 else None


def _fields(spark: SparkSession, schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)


def _called(fn: Callable[..., Any], columns: list[str], given: dict[str, Any], schema: T.StructType) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Runs fn for each row of (idx, bundle, item, _c0, _c1, ...), which has the columns in order; its value is a single one, a tuple or a dictionary."""
    names = schema["value"].dataType.names  # type: ignore[union-attr]

    def shaped(v: Any) -> dict[str, Any]:
        if isinstance(v, dict) and not (len(names) == 1 and names[0] not in v):
            return {c: v.get(c) for c in names}
        return dict(zip(names, v if isinstance(v, tuple) else (v,), strict=True))

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        values, errors, began, ended = [], [], [], []
        for own in zip(*(batch[f"_c{k}"] for k in range(len(columns))), strict=True) if columns else [()] * len(batch):
            value = error = None
            began.append(time.time_ns() // 1000)
            try:
                value = shaped(fn(**dict(zip(columns, own, strict=True)), **given))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            ended.append(time.time_ns() // 1000)
            values.append(value)
            errors.append(error)
        at = {c: pd.to_datetime(pd.Series(x, index=batch.index, dtype="int64"), unit="us", utc=True) for c, x in (("started_at", began), ("ended_at", ended))}
        return batch[["idx", "bundle", "item"]].assign(status=[FAILURE if e else SUCCESS for e in errors], **at, error=errors, value=values)

    return call


@contextlib.contextmanager
def _agreed(key: bytes) -> Iterator[Callable[[bool], bool]]:
    """A function that the tasks of a barrier call together: whether it was called with a yes in any of them.

    The barrier's own gathering takes a second, since Spark looks for answers once in a second; so that is done once, for the place where the first task hears the others.
    """
    context = BarrierTaskContext.get()
    own, n = context.partitionId(), len(context.getTaskInfos())
    host = context.getTaskInfos()[own].address.rpartition(":")[0]
    with contextlib.ExitStack() as opened:
        heard = opened.enter_context(Listener((host, 0), backlog=n, authkey=key)) if own == 0 else None
        host, _, port = context.allGather(f"{host}:{heard.address[1]}" if heard else "")[0].rpartition(":")
        links = [opened.enter_context(heard.accept() if heard else Client((host, int(port)), authkey=key)) for _ in range(n - 1 if heard else 1)]

        def agreed(said: bool) -> bool:
            if not heard:
                links[0].send_bytes(b"yes" if said else b"no")
                return links[0].recv_bytes() == b"yes"
            said = b"yes" in [b"yes" if said else b"no", *(x.recv_bytes() for x in links)]
            for x in links:
                x.send_bytes(b"yes" if said else b"no")
            return said

        yield agreed


def _in_turn(call: Callable[[pd.DataFrame], pd.DataFrame], groups: list[int], size: int, tasks: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """call for the rows of one group of so many items after the other; all tasks stop after the first group in which one of them has a failed item or is late."""
    key, limit = secrets.token_bytes(32), LONG

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (own for batch in batches for _, own in batch.groupby(batch["idx"] // size))  # rows come by idx
        with _agreed(key) if tasks > 1 else contextlib.nullcontext(bool) as agreed:
            late = time.monotonic() + limit
            part = next(parts, None)
            for g in groups:
                stop = False
                while part is not None and part["idx"].iat[0] // size == g:
                    out = call(part)
                    stop = stop or bool((out["status"] == FAILURE).any())
                    yield out
                    part = next(parts, None)
                if agreed(stop or time.monotonic() > late):
                    break
        for _ in batches:  # the rest is read and left
            pass

    return run


def _slots(spark: SparkSession, profile: Any) -> int:
    """Tasks of one core that run at the same time; 0 if that isn't known, as where executors come and go."""
    context = spark.sparkContext
    conf, n = context.getConf(), context.defaultParallelism
    if profile is not None or conf.get("spark.dynamicAllocation.enabled", "false") == "true" or conf.get("spark.task.cpus", "1") != "1" or conf.contains("spark.default.parallelism"):
        return 0
    return n if n > 2 or context.master.partition("[")[0] == "local" else 0  # a cluster of one core says 2


def run_groups(results: Results, items: DataFrame, fn: Callable[..., Any], columns: list[str], given: dict[str, Any], output_hash: str, bundle: int = BUNDLE, group: int = GROUP, force: bool = False, profile: Any = None) -> list[int]:
    """items(idx, columns) through fn, group after group; the groups that had something to run. TaskError after the first group with items that failed.

    fn is called with the columns by name, and with what is given. Items with a null are passed as None or NaN, as pandas has them. Each job reads its items by their range of
    idx, so items that are made at some cost are best stored. profile: of resources, for the stages that call fn; with one, or with executors that come and go, each group is a job.
    """
    spark, size = results.spark, bundle * group
    text = F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns))
    at = F.floor(F.col("idx") / bundle).cast("long")
    given_as = [f"_c{k}" for k in range(len(columns))]  # so that columns may have any names
    rows = items.select(F.col("idx").cast("long").alias("idx"), at.alias("bundle"), text.alias("item"), *(F.col(f"`{c}`").alias(a) for a, c in zip(given_as, columns, strict=True))).withColumn("grp", F.floor(F.col("bundle") / group).cast("long"))
    open_, first = None, results.log.empty()
    if not force and not first:
        done = results.state().where((F.col("status") == SUCCESS) & (F.col("output_hash") == output_hash)).select("idx", "item")
        open_ = stored(rows.join(done, ["idx", "item"], "left_anti").select("grp", "bundle").distinct())
    counts = {r.grp: r.n for r in (rows.select("grp", "bundle").distinct() if open_ is None else open_).groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a number for each group
    schema = f"idx long, bundle long, item string, status string, started_at timestamp, ended_at timestamp, error string, value struct<{_fields(spark, results.schema)}>"
    call = _called(fn, columns, given, spark.createDataFrame([], schema).schema)
    slots = _slots(spark, profile)
    ran, left, run = [], sorted(counts), uuid.uuid4().hex if first else ""  # in a first run each item has one row
    while left:
        now = left[: max(1, SHARED // size) if slots else 1]
        own = rows.where(F.col("idx").between(now[0] * size, (now[-1] + 1) * size - 1))
        if open_ is not None:
            own = own.join(open_.where(F.col("grp").between(now[0], now[-1])), ["grp", "bundle"], "left_semi")
        tasks = min(max(counts[g] for g in now), slots if len(now) > 1 else spark.sparkContext.defaultParallelism * 4)
        own = own.repartitionById(tasks, F.pmod("bundle", F.lit(tasks)).cast("int")).drop("grp")
        if len(now) > 1:
            made = own.sortWithinPartitions("idx").mapInPandas(_in_turn(call, now, size, tasks), schema, barrier=tasks > 1)
        else:
            made = own.mapInPandas(lambda batches: map(call, batches), schema, profile=profile)
        batch = results.log.append(made.withColumns({"bin": F.floor(F.col("idx") / BIN).cast("long"), "output_hash": F.lit(output_hash), "deleted": F.lit(False)}), run)
        last = batch.agg(F.max("idx")).first()[0] // size if len(now) > 1 else now[0]
        ran += [g for g in now if g <= last]
        left = [g for g in left if g > last]
        if bad := batch.where(F.col("status") == FAILURE).orderBy("idx").limit(_SHOWN).collect():
            raise TaskError("; ".join(f"[{r['item']}]: {r['error']}" for r in bad))
    if first:
        return ran
    gone = results.log.current().join(rows.select("idx"), "idx", "left_anti")
    if not gone.isEmpty():
        results.log.append(gone.withColumn("deleted", F.lit(True)))
    return ran
