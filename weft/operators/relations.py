"""The engine's decisions as relations, for plans, states and collections of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from .log import scratch, stored

#: Rows that are numbered in one task, and nodes that an error names.
_ONE_TASK, _NAMED = 1 << 16, 10


def staleness(current: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """current(key, now_hash), stored(key, output_hash) to key, is_stale, reason."""
    rows = current.join(stored, key, "left")
    now, then = F.col("now_hash"), F.col("output_hash")
    reason = F.when(now.isNull(), "no outputs").when(then.isNull(), "not run before").when(now == then, "cached").otherwise(F.concat(F.lit("changed "), F.substring(then, 1, 8), F.lit(" to "), F.substring(now, 1, 8)))
    return rows.select(*key, (now.isNotNull() & (then.isNull() | (now != then))).alias("is_stale"), reason.alias("reason"))


def submission_reason(ignore_cache: Column, subset: Column, status: Column, code: tuple[Column, Column], inputs: tuple[Column, Column], data: tuple[Column, Column], finished: Column) -> Column:
    """Why a task is submitted, or null; of several reasons the first in this order. Pairs are (now, then)."""
    return (
        F.when(status.isNull(), "No cached state").when(ignore_cache, "ignore_cache").when(subset, "Subset mode").when(status == "FAILURE", "FAILURE").when(~code[0].eqNullSafe(code[1]), "Code changed")
        .when(~inputs[0].eqNullSafe(inputs[1]), "Inputs changed").when(~data[0].eqNullSafe(data[1]), "Data changed").when(status == "INCOMPLETE", "INCOMPLETE").when(finished.isNull(), "Not finished")
    )


def cascade(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges(src, dst), start(node) to the nodes that are reached, themselves included: a round is a join, and as many run as the longest way has edges."""
    place = scratch(edges.sparkSession)
    frontier = stored(start.select("node").distinct(), f"{place}/round=0")
    reached, n = frontier, 0
    while True:
        frontier = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        n += 1
        frontier = stored(frontier, f"{place}/round={n}")
        reached = edges.sparkSession.read.schema(reached.schema).parquet(*(f"{place}/round={k}" for k in range(n + 1)))
        if frontier.isEmpty():
            return reached


def heads(edges: DataFrame) -> DataFrame:
    """edges(src, dst) to the nodes that nothing leads to."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def tails(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def wrapper_cascade(subtasks: DataFrame, group: list[str], position: str, stale: str) -> DataFrame:
    """subtasks and must_run: the first stale one of a group and all after it."""
    w = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return subtasks.withColumn("must_run", F.max(F.col(stale).cast("int")).over(w) == 1)


def _fields(column: Column, kind: T.DataType) -> list[Column]:
    """What sorts as a column does: the fields of a struct, which Spark sorts by in less time, and whether it is one."""
    if not isinstance(kind, T.StructType):
        return [column]
    return [x for f in kind for x in _fields(column[f.name], f.dataType)] + [column.isNotNull()]


def indexed(items: DataFrame, order: list[str]) -> DataFrame:
    """items and idx, 0 to n - 1 in a total order: positions within ranges of the order, and where each range begins."""
    order = [x for c in order for x in _fields(F.col(f"`{c}`"), items.schema[c].dataType)]
    part, first = F.spark_partition_id(), F.shiftleft(F.spark_partition_id().cast("long"), 33)  # the first of a partition's ids
    parts = stored(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": part, "_nth": F.monotonically_increasing_id() - first}))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))  # one row for each range
    return parts.join(F.broadcast(begins), "_part").withColumn("idx", (F.col("_begin") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_begin")


def bundled(items: DataFrame, size: int, column: str, idx: str = "idx") -> DataFrame:
    """bundle, n, items: consecutive chunks of size items in the order of idx."""
    bundle = F.floor(F.col(idx) / size).cast("long").alias("bundle")
    listed = F.array_sort(F.collect_list(F.struct(idx, column)))
    return items.groupBy(bundle).agg(F.count("*").alias("n"), F.transform(listed, lambda s: s[column]).alias("items"))


def map_status(results: DataFrame, group: list[str], ok: str) -> DataFrame:
    """group, n_ok, n_items, status: SUCCESS if all items are well, FAILURE if none, else INCOMPLETE."""
    n, good = F.count("*"), F.count_if(F.col(ok))
    return results.groupBy(*group).agg(good.alias("n_ok"), n.alias("n_items"), F.when(good == n, "SUCCESS").when(good == 0, "FAILURE").otherwise("INCOMPLETE").alias("status"))


def unfinished(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The items that are to run again, with the index they had."""
    return items.join(done.select(*key), key, "left_anti")


def subset(items: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    return items.join(wanted.select(*key), key, "left_semi")


def binned(values: DataFrame, position: str, size: int = 500) -> DataFrame:
    """values and bin, by position."""
    return values.withColumn("bin", F.floor(F.col(position) / size).cast("long"))


def bin_lists(values: DataFrame, position: str, value: str, size: int = 500) -> DataFrame:
    """bin and items: the values of each bin in order, `size` of them at most."""
    listed = F.array_sort(F.collect_list(F.struct(position, value)))
    return binned(values, position, size).groupBy("bin").agg(F.transform(listed, lambda x: x[value]).alias("items"))


def unbinned(bins: DataFrame, size: int = 500) -> DataFrame:
    """bins(bin, items) to position and item, as they were."""
    return bins.select("bin", F.posexplode("items").alias("nth", "item")).select((F.col("bin").cast("long") * size + F.col("nth")).alias("position"), "item")


def with_item(bins: DataFrame, position: int, item: Column, size: int = 500) -> DataFrame:
    """bins(bin, items) with another item at a position; only its bin changes."""
    new = F.transform("items", lambda x, i: F.when(i == position % size, item).otherwise(x))
    return bins.withColumn("items", F.when(F.col("bin") == position // size, new).otherwise(F.col("items")))


def peeled(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """edges(src, dst), nodes(node, declared) to node, level, position: nodes leave when nothing they wait for is left.

    level is the longest way to a node. position is that of a queue: of the nodes of a level those come first whose last predecessor did, and of several those that were declared first.
    Without nodes, they are those of the edges, and declared by themselves. A round takes away what is ready, and its edges from the counts of those it leads to; so it takes as many rounds as there are
    levels, and what is left then waits for a cycle, which is a GraphError, as an edge to a node that isn't declared is.
    """
    spark, place = edges.sparkSession, scratch(edges.sparkSession)
    edges = stored(edges.groupBy("src", "dst").agg(F.count("*").alias("n")), f"{place}/edges")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if nodes is None:
        nodes = ends.withColumn("declared", F.col("node"))
    elif lost := ends.join(nodes, "node", "left_anti").limit(_NAMED).collect():
        raise GraphError(f"no node {', '.join(str(r.node) for r in lost)}")
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("open"))
    waits = nodes.select("node", "declared").join(counts, "node", "left").select("node", "declared", F.coalesce("open", F.lit(0)).alias("open"), F.lit(None).cast("long").alias("last"))
    level = begun = 0
    while True:
        waits = stored(waits, f"{place}/waits-{level}")
        n = waits.where("open = 0").count()
        ready = waits.where("open = 0").select("node", "declared", "last")
        order = ["last", "declared", "node"]
        nth = ready.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")) if n <= _ONE_TASK else indexed(ready, order)
        ready = stored(nth.select("node", F.lit(level).alias("level"), (F.col("idx") + begun).alias("position")), f"{place}/done/round={level}")
        if not n:
            break
        begun += n
        freed = edges.join(ready, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("freed"), F.max("position").alias("by"))
        waits = waits.where("open > 0").join(freed, "node", "left").select("node", "declared", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open"), F.greatest("last", "by").alias("last"))
        level += 1
    if left := waits.orderBy("declared").limit(_NAMED).collect():
        raise GraphError("cycle: " + ", ".join(str(r.node) for r in left))
    return spark.read.schema(ready.schema).parquet(*(f"{place}/done/round={k}" for k in range(level + 1)))


def levels(edges: DataFrame) -> DataFrame:
    """edges(src, dst) to node, level: the longest way that leads to a node; a cycle is an error."""
    return peeled(edges).select("node", "level")
