"""Composition of tasks into a graph. All of it is small and stays on the driver; the work of tasks is Spark's."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..errors import GraphError


@dataclass(eq=False)
class Node:
    """kind: python, sql, noop, parallel, stage, map, pipeline or config. Nodes are told apart by identity, names may repeat."""

    name: str
    kind: str = "python"
    run: Callable[..., Any] | None = None
    outputs: tuple[str, ...] = ()
    optional: str | None = None
    requires: tuple[Any, ...] = ()
    checkpoint: bool = False
    path: str | None = None
    over: str | None = None
    values: dict[str, Any] = field(default_factory=dict)
    members: tuple[str, ...] = ()
    result: str | None = None
    bundle: int | None = None
    group: int | None = None
    compute: dict[str, Any] | None = None

    def __rshift__(self, other: Any) -> Graph:
        return Graph.of(self) >> other

    def __rrshift__(self, other: Any) -> Graph:
        return Graph.of(other) >> self

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        if self.run is None:
            raise TypeError(f"{self.name} cannot be called")
        return self.run(*args, **kwargs)


@dataclass(eq=False)
class Graph:
    nodes: list[Node] = field(default_factory=list)
    edges: list[tuple[Node, Node]] = field(default_factory=list)
    required: set[tuple[Node, Node]] = field(default_factory=set)

    @staticmethod
    def of(x: Any) -> Graph:
        if isinstance(x, Graph):
            return x
        if isinstance(x, Node):
            return Graph([x])
        if callable(x):
            return Graph([task(x)])
        raise TypeError(f"not a task or graph: {x!r}")

    def heads(self) -> list[Node]:
        """Nodes that nothing leads to, requirements aside."""
        to = {b for a, b in self.edges if (a, b) not in self.required}
        return [n for n in self.nodes if n not in to]

    def tails(self) -> list[Node]:
        away = {a for a, _ in self.edges}
        return [n for n in self.nodes if n not in away]

    def merged(self, other: Graph, *more: tuple[Node, Node]) -> Graph:
        nodes = list(dict.fromkeys([*self.nodes, *other.nodes]))
        return Graph(nodes, list(dict.fromkeys([*self.edges, *other.edges, *more])), self.required | other.required)

    def __rshift__(self, other: Any) -> Graph:
        other = Graph.of(other)
        return self.merged(other, *((a, b) for a in self.tails() for b in other.heads()))

    def __rrshift__(self, other: Any) -> Graph:
        return Graph.of(other) >> self


def task(fn: Callable | None = None, *, outputs: Iterable[str] = (), optional: str | None = None, requires: Iterable[Any] = (), checkpoint: bool = False, name: str | None = None, result: str | None = None, compute: dict[str, Any] | None = None) -> Any:
    """Makes a task of a function; usable as a decorator with or without arguments. The task stays callable.

    result: the columns of the rows that it returns, in SQL. They are kept, and tasks that follow can be mapped over them, or take them as a relation by the task's name.
    compute: cpu and memory that it asks for where it is mapped over rows.
    """

    def wrap(f: Callable) -> Node:
        n = Node(name or f.__name__, run=f, outputs=tuple(outputs), optional=optional, requires=tuple(requires), checkpoint=checkpoint, result=result, compute=compute)
        functools.update_wrapper(n, f)
        return n

    return wrap(fn) if fn is not None else wrap


def sql_task(path: str, *, outputs: Iterable[str] = (), optional: str | None = None, requires: Iterable[Any] = (), checkpoint: bool = False) -> Node:
    """A file of SQL statements; its name is the file's stem. Called directly it takes spark= and args=, and caches nothing; in a run its parameters are the values and arguments that tasks get."""

    def run(*, spark: Any, args: dict[str, Any] | None = None) -> Any:
        from ..sources.sql import run_file

        if spark is None:
            raise TypeError("spark is needed")
        return run_file(spark, path, args)

    return Node(Path(path).stem, "sql", run, tuple(outputs), optional, tuple(requires), checkpoint, path)


def _group(kind: str, name: str, branches: tuple[Any, ...]) -> Graph:
    if not branches:
        raise ValueError(f"{kind} needs branches")
    graphs = [Graph.of(b) for b in branches]
    start = Node(name, kind, members=tuple(dict.fromkeys(n.name for g in graphs for n in g.nodes)))
    out = Graph([start])
    for g in graphs:
        out = out.merged(g, *((start, h) for h in g.heads()))
    return out


def parallel(*branches: Any) -> Graph:
    """Branches side by side; a first argument that is a string names them."""
    name, rest = (branches[0], branches[1:]) if branches and isinstance(branches[0], str) else ("parallel", branches)
    return _group("parallel", name, rest)


def stage(name: str, *branches: Any) -> Graph:
    """Branches of which a profile selects some; without a selection all run."""
    return _group("stage", name, branches)


def map_over(t: Any, over: str, bundle: int | None = None, group: int | None = None) -> Node:
    """Runs a task for each item of a collection, `task.path`, or for each row of a task's kept result. bundle: rows that are run again as a whole; group: bundles of a job, after which the next begins."""
    if not callable(t) and not isinstance(t, Node):
        raise TypeError(f"not a task: {t!r}")
    n = t if isinstance(t, Node) else task(t)
    return Node(n.name, "map", n.run, n.outputs, n.optional, n.requires, n.checkpoint, n.path, over, result=n.result, bundle=bundle, group=group, compute=n.compute)


def noop() -> Node:
    return Node("noop", "noop")


def config(**values: Any) -> Node:
    """Values for the tasks that follow, by parameter name: callables, or (callable, alias)."""
    for k, v in values.items():
        if not callable(v[0] if isinstance(v, tuple) else v):
            raise TypeError(f"{k} must be callable")
    return Node("config", "config", values=values)


@dataclass(frozen=True)
class AnyOf:
    tasks: tuple[Node, ...]


def any_of(*tasks: Node) -> AnyOf:
    """A requirement that one present task meets; it brings none in."""
    if not tasks:
        raise ValueError("any_of needs tasks")
    if not all(isinstance(t, Node) for t in tasks):
        raise TypeError("any_of takes tasks")
    return AnyOf(tasks)


def expanded(graph: Graph) -> Graph:
    """graph with the tasks that its tasks require, once for each name; a task the user has placed is used where it is."""
    by_name = {n.name: n for n in graph.nodes}
    out, todo = Graph(list(graph.nodes), list(graph.edges), set(graph.required)), list(graph.nodes)
    while todo:
        n = todo.pop(0)
        for r in n.requires:
            if isinstance(r, AnyOf):
                continue
            need = by_name.get(r.name)
            if need is None:
                need = by_name[r.name] = r
                out.nodes.append(need)
                todo.append(need)
            if (need, n) not in out.edges:
                out.edges.append((need, n))
                out.required.add((need, n))
    order(out)
    return out


@dataclass(eq=False)
class Pipeline(Graph):
    name: str = "pipeline"

    def __init__(self, name: str, graph: Any):
        g = expanded(Graph.of(graph))
        start = Node(name, "pipeline", members=tuple(n.name for n in g.nodes))
        super().__init__([start, *g.nodes], [*((start, h) for h in g.heads()), *g.edges], g.required)
        self.name = name

    def run(self, spark: Any, **options: Any) -> dict[str, Any]:
        from .run import run

        return run(self, spark, **options)

    def __call__(self, spark: Any, **options: Any) -> dict[str, Any]:
        """Runs all tasks, whatever is cached, and keeps no state."""
        if "no_cache" in options:
            raise TypeError("a call never caches")
        return self.run(spark, no_cache=True, **options)


def order(graph: Graph) -> list[Node]:
    """Depth-first topological order: chains stay together, and of several heads the first declared comes first."""
    known = set(graph.nodes)
    for a, b in graph.edges:
        if a not in known or b not in known:
            raise GraphError(f"edge {a.name} -> {b.name} leaves the graph")
    before: dict[Node, int] = {n: 0 for n in graph.nodes}
    after: dict[Node, list[Node]] = {n: [] for n in graph.nodes}
    for a, b in graph.edges:
        before[b] += 1
        after[a].append(b)
    out: list[Node] = []

    def visit(first: Node) -> None:
        todo = [iter([first])]  # of each node on the way down, those after it that are left
        while todo:
            n = next(todo[-1], None)
            if n is None:
                todo.pop()
            elif before[n] <= 0:
                out.append(n)
                todo.append(iter([m for m in after[n] if met(m)]))

    def met(n: Node) -> bool:
        before[n] -= 1
        return not before[n]

    for n in [n for n in graph.nodes if not before[n]]:
        visit(n)
    if len(out) < len(graph.nodes):
        raise GraphError("cycle: " + ", ".join(sorted(n.name for n, w in before.items() if w > 0)))
    return out


def lanes(graph: Graph) -> list[list[Node]]:
    """Nodes by level: all that a node depends on is in earlier lanes, so a lane can run at once."""
    level: dict[Node, int] = {}
    for n in order(graph):
        level[n] = max((level[a] + 1 for a, b in graph.edges if b is n), default=0)
    return [[n for n in graph.nodes if level[n] == k] for k in range(max(level.values(), default=-1) + 1)]
