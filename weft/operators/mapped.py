"""Mapped execution on executors: one function over a collection, with errors kept by item."""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def map_items(items: DataFrame, fn: Callable[..., Any], columns: list[str]) -> DataFrame:
    """items(idx, columns) to idx, ok, result, error. result is JSON; one failing item leaves the others alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for idx, *values in batch[["idx", *columns]].itertuples(index=False, name=None):
                try:
                    out.append((idx, True, json.dumps(fn(*values), default=str), None))
                except Exception as e:
                    out.append((idx, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["idx", "ok", "result", "error"])

    return items.select("idx", *columns).mapInPandas(run, "idx long, ok boolean, result string, error string")


def run_items(spark: SparkSession, fn: Callable[..., Any], items: list[Any], given: dict[str, Any]) -> list[tuple[bool, Any, str | None, datetime, datetime]]:
    """(ok, value, error, start, end) of fn(item, **given) for each item of a list, which executors work on, a few items a task. For collections that the driver has; see items.run_groups for others."""
    if not items:
        return []
    data = pickle.dumps  # items and values are Python's own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for idx, item in batch.itertuples(index=False, name=None):
                began = datetime.now(UTC)
                try:
                    out.append((idx, True, data(fn(pickle.loads(item), **given)), None, began, datetime.now(UTC)))
                except Exception as e:
                    out.append((idx, False, None, f"{type(e).__name__}: {e}", began, datetime.now(UTC)))
            yield pd.DataFrame(out, columns=["idx", "ok", "value", "error", "began", "ended"])

    rows = spark.createDataFrame([(k, data(x)) for k, x in enumerate(items)], "idx long, item binary").repartition(min(len(items), spark.sparkContext.defaultParallelism))
    found = rows.mapInPandas(run, "idx long, ok boolean, value binary, error string, began timestamp, ended timestamp").orderBy("idx").collect()  # as many as the list has
    return [(r.ok, pickle.loads(r.value) if r.ok else None, r.error, r.began, r.ended) for r in found]


def item_state(results: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """results(key, now_hash) and stored(key, output_hash) to key and action: RUN for items without a hash or with another than stored, else SKIP."""
    rows = results.join(stored, key, "left")
    same = F.coalesce(F.col("now_hash") == F.col("output_hash"), F.lit(False))
    return rows.select(*key, F.when(same, "SKIP").otherwise("RUN").alias("action"))


def combined_hash(hashes: DataFrame, block: int = 10_000) -> str:
    """Of the items' hashes(idx, output_hash) in order: of blocks of consecutive ones, where they are, and then of the blocks' digests."""
    parts = hashes.groupBy(F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("output_hash", F.lit("")).alias("h")))).alias("own"))
    parts = parts.select("block", F.sha1(F.array_join(F.transform("own", lambda x: x["h"]), "\n")).alias("h"))
    digest = hashlib.sha1()
    for r in parts.orderBy("block").toLocalIterator():
        digest.update(r.h.encode() + b"\n")
    return digest.hexdigest()
