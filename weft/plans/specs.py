"""Pipelines that are written down as data, such as YAML: graphs of named tasks, which take in the tasks of others.

    graphs:
      base: {tasks: {load: {call: "jobs:load", outputs: ["table://items"]}}}
      report:
        extends: [{graph: base, args: {load: {rows: 5}}}]
        tasks: {sums: {file: sums.sql, deps: load}}

A graph has the tasks of those it extends, in that order, and then its own; of tasks of one name the first counts. args of an extended graph are put over those that its tasks have there.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from ..errors import GraphError
from . import dag
from .profiles import Profile

# What is said of a task besides what it runs, under the names that dag.task() has.
_MORE = ("outputs", "optional", "checkpoint", "result", "compute")
_KNOWN = {"call", "file", "deps", "args", "map_over", "bundle", "group", *_MORE}


def _listed(x: Any) -> list[Any]:
    return [v for v in x if v] if isinstance(x, (list, tuple)) else [] if x in (None, "") else [x]


def _entry(task: str, raw: Any) -> dict[str, Any]:
    """What is said of a task; a text or a list alone are its deps."""
    entry = dict(raw) if isinstance(raw, dict) else {"deps": raw}
    if unknown := entry.keys() - _KNOWN:
        raise GraphError(f"{task}: unknown {', '.join(sorted(unknown))}")
    return entry | {"deps": _listed(entry.get("deps"))}


def flattened(graphs: dict[str, Any], name: str) -> dict[str, dict[str, Any]]:
    """The tasks of a graph with those it takes in. GraphError for graphs that aren't there or extend one another, and for deps on tasks that aren't there."""
    done: dict[str, dict[str, dict[str, Any]]] = {}

    def tasks(graph: str, way: tuple[str, ...]) -> dict[str, dict[str, Any]]:
        if graph in way:
            raise GraphError("graphs extend one another: " + " -> ".join((*way[way.index(graph) :], graph)))
        if graph not in done:
            if not isinstance(graphs.get(graph), dict):
                raise GraphError(f"no graph {graph}")
            found: dict[str, dict[str, Any]] = {}
            for task, entry in said(graph, (*way, graph)):
                found.setdefault(task, entry)
            if not found:
                raise GraphError(f"{graph} has no tasks")
            for task, entry in found.items():
                if lost := [d for d in entry["deps"] if d not in found]:
                    raise GraphError(f"{graph}: {task} depends on {', '.join(lost)}, which isn't there")
            done[graph] = found
        return done[graph]

    def said(graph: str, way: tuple[str, ...]) -> Iterator[tuple[str, dict[str, Any]]]:
        for parent in _listed(graphs[graph].get("extends")):
            parent = {"graph": parent} if isinstance(parent, str) else parent
            over = parent.get("args") or {}
            for task, entry in tasks(parent["graph"], way).items():
                yield task, entry | {"args": {**(entry.get("args") or {}), **over[task]}} if over.get(task) else entry
        for task, raw in (graphs[graph].get("tasks") or {}).items():
            yield task, _entry(task, raw)

    return tasks(name, ())


def _called(entry: dict[str, Any]) -> Callable[..., Any]:
    if "call" not in entry:
        return lambda: None
    module, _, name = entry["call"].partition(":")
    return getattr(importlib.import_module(module), name)


def pipeline(graphs: dict[str, Any], name: str, base: str = ".") -> tuple[dag.Pipeline, Profile]:
    """The pipeline of a graph, and a profile with the arguments of its tasks. Files of SQL are beside base."""
    tasks = flattened(graphs, name)
    nodes: dict[str, dag.Node] = {}
    for task, entry in tasks.items():
        more = {k: entry[k] for k in _MORE if k in entry}
        if "file" in entry:
            nodes[task] = dag.sql_task(str(Path(base) / entry["file"]), **{k: v for k, v in more.items() if k not in {"result", "compute"}})
            nodes[task].name = task
        else:
            nodes[task] = dag.task(_called(entry), name=task, **more)
        if over := entry.get("map_over"):
            nodes[task] = dag.map_over(nodes[task], over, entry.get("bundle"), entry.get("group"))
    edges = [(nodes[d], nodes[t]) for t, entry in tasks.items() for d in entry["deps"]]
    return dag.Pipeline(name, dag.Graph(list(nodes.values()), edges)), Profile(args={t: e["args"] for t, e in tasks.items() if e.get("args")})
