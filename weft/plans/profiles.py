"""Profiles: which stages, optional groups, arguments and part of a pipeline a run takes."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..errors import ProfileError
from .dag import AnyOf, Graph, Node, order


@dataclass(frozen=True)
class Profile:
    stages: dict[str, tuple[str, ...]] = field(default_factory=dict)
    groups: dict[str, bool] = field(default_factory=dict)
    args: dict[str, dict[str, Any]] = field(default_factory=dict)
    start_from: str | None = None
    stop_after: str | None = None


def load(path: str) -> dict[str, dict[str, Any]]:
    """The profiles of a YAML file; none if it is absent or empty."""
    import yaml

    if not Path(path).exists():
        return {}
    try:
        found = yaml.safe_load(Path(path).read_text()) or {}
    except yaml.YAMLError as e:
        raise ProfileError(str(e)) from e
    if not isinstance(found, dict) or not isinstance(found.get("profiles", {}), dict):
        raise ProfileError(f"{path} must be a mapping")
    return found.get("profiles", {})


def resolve(profiles: dict[str, dict[str, Any]], name: str) -> Profile:
    """A profile with what it extends, ancestors first: stage selections add up, of groups the last counts, arguments merge by task, start and stop are its own."""
    line: list[str] = []

    def walk(n: str, way: tuple[str, ...]) -> None:
        if n in way:
            raise ProfileError("profiles extend one another: " + " -> ".join((*way, n)))
        if n not in profiles:
            raise ProfileError(f"no profile {n}")
        parents = profiles[n].get("extends") or []
        for p in [parents] if isinstance(parents, str) else parents:
            walk(p, (*way, n))
        if n not in line:
            line.append(n)

    walk(name, ())
    stages: dict[str, tuple[str, ...]] = {}
    groups: dict[str, bool] = {}
    args: dict[str, dict[str, Any]] = {}
    known = {"extends", "stage_selections", "optional_groups", "args", "start_from", "stop_after"}
    for n in line:
        raw = profiles[n] or {}
        short = {k: v for k, v in raw.items() if k not in known}  # a list selects of a stage, a truth value switches a group
        for k, v in {**raw.get("stage_selections", {}), **{k: v for k, v in short.items() if isinstance(v, list)}}.items():
            stages[k] = tuple(dict.fromkeys((*stages.get(k, ()), *v)))
        groups |= {**raw.get("optional_groups", {}), **{k: v for k, v in short.items() if isinstance(v, bool)}}
        for k, v in raw.get("args", {}).items():
            args[k] = {**args.get(k, {}), **v}
    own = profiles[name] or {}
    return Profile(stages, groups, args, own.get("start_from"), own.get("stop_after"))


def _on(profile: Profile, group: str, pipeline: str) -> bool:
    found = False
    for k, v in profile.groups.items():
        if k in {group, f"*.{group}", f"{pipeline}.{group}"}:
            found = v
    return found


def _without(graph: Graph, dead: set[Node], bridged: set[Node]) -> Graph:
    """graph without dead nodes; what leads to a bridged one leads to what follows it."""
    edges = dict.fromkeys(graph.edges)
    for n in bridged:
        before, after = [a for a, b in edges if b is n], [b for a, b in edges if a is n]
        edges = dict.fromkeys([e for e in edges if n not in e] + [(a, b) for a in before for b in after])
    gone = dead | bridged
    kept = [e for e in edges if not gone & set(e)]
    return Graph([n for n in graph.nodes if n not in gone], kept, {e for e in graph.required if e in kept})


def prune(graph: Graph, profile: Profile, pipeline: str = "pipeline") -> Graph:
    """Unselected stage branches go, and what only they lead to; tasks of groups that are off are bridged."""
    dead: set[Node] = set()
    for s in (n for n in graph.nodes if n.kind == "stage" and n.name in profile.stages):
        branches = {b.name: b for a, b in graph.edges if a is s}
        for chosen in profile.stages[s.name]:
            if chosen not in branches:
                near = difflib.get_close_matches(chosen, branches, 1)
                raise ProfileError(f"stage {s.name} has no branch {chosen}" + (f". Did you mean {near[0]}?" if near else ""))
        dead |= {b for k, b in branches.items() if k not in profile.stages[s.name]}
    heads = set(dead)
    for n in order(graph):
        before = [a for a, b in graph.edges if b is n and (a, b) not in graph.required]
        if n not in dead and before and all(a in dead for a in before):
            dead.add(n)
    # a stage with no branch left leads to what joined its branches
    for s in (n for n in graph.nodes if n.kind == "stage" and n not in dead):
        branches = [b for a, b in graph.edges if a is s]
        if len(branches) > 1 and all(b in heads for b in branches):
            reach = [_reach(graph, b) for b in branches]
            joined = [n for n in order(graph) if all(n in r for r in reach)]
            if joined:
                dead -= {n for n in joined}
                graph = replace(graph, edges=[*graph.edges, (s, joined[0])])
    off = {n for n in graph.nodes if n.optional and n not in dead and not _on(profile, n.optional, pipeline)}
    return _without(graph, dead, off)


def _reach(graph: Graph, start: Node) -> set[Node]:
    out, todo = {start}, [start]
    while todo:
        n = todo.pop()
        for b in [b for a, b in graph.edges if a is n and b not in out]:
            out.add(b)
            todo.append(b)
    return out


def gate(graph: Graph) -> Graph:
    """Without tasks of whose any_of requirements none is present, and those that require them."""
    while True:
        names = {n.name for n in graph.nodes}
        gone = {n for n in graph.nodes for r in n.requires if isinstance(r, AnyOf) and not any(t.name in names for t in r.tasks)}
        gone |= {b for a, b in graph.required if a in gone}
        if not gone:
            return graph
        graph = _without(graph, set(), gone)


def cut(graph: Graph, profile: Profile) -> tuple[Graph, set[Node]]:
    """The graph up to stop_after, and the nodes before start_from, which are kept but not run.

    Stages stay whole: a cursor at a branch is one at its stage. So do parallels and pipelines at which a run stops: all their tasks are kept.
    """
    nodes = order(graph)
    at = {n.name: k for k, n in enumerate(nodes)}
    stage = {b.name: a for a, b in graph.edges if a.kind == "stage"}
    for c in (profile.start_from, profile.stop_after):
        if c and c not in at:
            near = difflib.get_close_matches(c, at, 1)
            raise ProfileError(f"no task {c}" + (f". Did you mean {near[0]}?" if near else ""))

    def group(c: str) -> Node:
        return stage.get(c, nodes[at[c]])

    first = at[group(profile.start_from).name] if profile.start_from else 0
    last = len(nodes) - 1
    if profile.stop_after:
        end = group(profile.stop_after)
        last = max(at[m] for m in (end.name, *end.members) if m in at)
    if last < first:
        raise ProfileError("stop_after comes before start_from")
    kept = set(nodes[: last + 1])
    return _without(graph, set(graph.nodes) - kept, set()), set(nodes[:first])
