"""Column lineage of a query, from the plan that Spark has analysed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sql import referenced_tables
from .relations import cascade, indexed


def _seq(s: Any) -> list[Any]:
    return [s.apply(i) for i in range(s.size())]


def column_sources(df: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """For each output column the (table, column) pairs its value comes from, through aliases, joins, aggregates, CTEs and subqueries in FROM."""
    made: dict[int, set[int]] = {}
    leaf: dict[int, tuple[str, str]] = {}
    defined: dict[int, list[int]] = {}
    used: list[tuple[int, list[int]]] = []

    def ids(expression: Any) -> set[int]:
        refs = expression.references().iterator()
        out = set()
        while refs.hasNext():
            out.add(refs.next().exprId().id())
        return out

    def walk(plan: Any, table: str) -> None:
        kind = plan.nodeName()
        if kind == "SubqueryAlias":
            table = plan.identifier().name()
        children = _seq(plan.children())
        if kind in {"Project", "Aggregate", "Window"}:
            for e in _seq(plan.expressions()):
                if e.nodeName() == "Alias":
                    made.setdefault(e.exprId().id(), set()).update(ids(e.child()))
        if kind == "Union":
            outs = [_seq(c.output()) for c in children]
            for k, a in enumerate(_seq(plan.output())):
                made.setdefault(a.exprId().id(), set()).update(o[k].exprId().id() for o in outs if o[k].exprId().id() != a.exprId().id())
        if kind == "CTERelationDef":
            defined[plan.id()] = [a.exprId().id() for a in _seq(plan.output())]
        if kind == "CTERelationRef":
            used.append((plan.cteId(), [a.exprId().id() for a in _seq(plan.output())]))
        elif not children:
            for a in _seq(plan.output()):
                leaf[a.exprId().id()] = (table, a.name())
        for c in children:
            walk(c, table)

    plan = df._jdf.queryExecution().analyzed()
    walk(plan, "")
    for cte, outs in used:
        for a, b in zip(outs, defined.get(cte, []), strict=False):
            if a != b:
                made.setdefault(a, set()).add(b)

    def sources(i: int, seen: frozenset[int]) -> set[tuple[str, str]]:
        if i in seen:
            return set()
        found = {leaf[i]} if i in leaf else set()
        for j in made.get(i, ()):
            found |= sources(j, seen | {i})
        return found

    return {a.name(): sorted(sources(a.exprId().id(), frozenset())) for a in _seq(plan.output())}


def lineage_edges(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    """from_table, from_column, to_table, to_column of tables made by queries."""
    rows = [(t, c, name, out) for name, q in queries.items() for out, found in column_sources(spark.sql(q)).items() for t, c in found]
    return spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string")


class Tree:
    """Tables by the queries that make them, and what they depend on. Only names are needed, so none of the tables must exist."""

    def __init__(self, spark: SparkSession, queries: dict[str, str]) -> None:
        self.names = {n.lower(): n for n in queries}
        self.needs = {n.lower(): referenced_tables(spark, q) for n, q in queries.items()}

    def depends_on(self, table: str) -> list[str]:
        """Display names of the tables that a table is made of."""
        if table.lower() not in self.needs:
            raise KeyError(f"no table {table}; there are {', '.join(sorted(self.names.values()))}")
        return [self.names.get(t, t) for t in self.needs[table.lower()]]

    def edges(self, spark: SparkSession) -> DataFrame:
        """src, dst of all dependencies; tables that no query makes are sources."""
        return spark.createDataFrame([(self.names.get(t, t), self.names[n]) for n, needs in self.needs.items() for t in needs], "src string, dst string")


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges(src, dst), start(node) to node, way, direct: what start leads to (down) and what leads to it (up), in one edge or more."""
    out = None
    for way, a, b in (("down", "src", "dst"), ("up", "dst", "src")):
        along = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        near = along.join(start, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        far = cascade(along, start).join(start, "node", "left_anti")
        found = far.join(near.withColumn("near", F.lit(True)), "node", "left").select("node", F.lit(way).alias("way"), F.coalesce("near", F.lit(False)).alias("direct"))
        out = found if out is None else out.union(found)
    return out


def payload(tables: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tables(position, name), edges(from_table, from_column, to_table, to_column) to nodes(idx, name, external) and links(from_idx, from_column, to_idx, to_column).

    Tables are numbered in the order of their positions; what edges name besides them is external, and is numbered after them by name. Equal edges are one.
    """
    outside = edges.select(F.col("from_table").alias("name")).union(edges.select("to_table")).where("name is not null").distinct().join(tables.select("name"), "name", "left_anti")
    every = tables.select("name", "position", F.lit(False).alias("external")).union(outside.select("name", F.lit(None), F.lit(True)))
    nodes = indexed(every, ["external", "position", "name"]).select("idx", "name", "external")
    at = nodes.select("name", "idx")
    links = edges.distinct().join(at.select(F.col("name").alias("from_table"), F.col("idx").alias("from_idx")), "from_table").join(at.select(F.col("name").alias("to_table"), F.col("idx").alias("to_idx")), "to_table")
    return nodes, links.select("from_idx", "from_column", "to_idx", "to_column")
