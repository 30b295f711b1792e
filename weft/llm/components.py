"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours are linked with the least of them: its larger ones, or itself and its smaller ones."""
    if larger:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = ends.join(least, "u").where(F.col("v") > F.col("u") if larger else F.lit(True)).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        linked = linked.union(least.select(F.col("u"), F.col("m")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), of longs, in (node, component): the smallest node that links reach, for each node of an edge.

    No edges give no rows; loops and repeated edges change nothing. Each round is a written
    table, so lost executors cost one round. Rounds grow with the logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        before, now = now, stored(_star(_star(now, True), False), "edges")
        forget(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == last:
            break
        last = seen
    found = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return found.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
