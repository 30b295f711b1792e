"""Configuration of runs: values, factories by name, included files, and what tasks ask for."""

from __future__ import annotations

import importlib
import inspect
import json
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from ..errors import ProfileError
from .dag import Graph, Node


def merged(*parts: dict[str, Any], way: str = "") -> dict[str, Any]:
    """Dictionaries put into one, level by level; lists add up, and values that differ are an error."""
    out: dict[str, Any] = {}
    for part in parts:
        for k, v in part.items():
            if k not in out:
                out[k] = v
            elif isinstance(out[k], dict) and isinstance(v, dict):
                out[k] = merged(out[k], v, way=f"{way}{k}.")
            elif isinstance(out[k], list) and isinstance(v, list):
                out[k] = out[k] + [x for x in v if x not in out[k]]
            elif out[k] != v:
                raise ProfileError(f"{way}{k} is both {out[k]!r} and {v!r}")
    return out


def included(path: str) -> Any:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _named(text: str) -> Any:
    module, _, name = text.partition(":")
    return getattr(importlib.import_module(module), name)


def values_of(raw: dict[str, Any], base: str = ".") -> dict[str, Any]:
    """Values of a configuration: `module:function` texts under `call` are called, files under `include` are merged in, the rest is as it is."""
    parts = []
    for path in [raw["include"]] if isinstance(raw.get("include"), str) else raw.get("include", []):
        parts.append(values_of(included(str(Path(base) / path)) or {}, base))
    own = {k: v for k, v in raw.items() if k not in {"include", "call", "aliases"}}
    own |= {k: _named(v)() for k, v in raw.get("call", {}).items()}
    out = merged(*parts, own)
    for alias, k in raw.get("aliases", {}).items():
        out[alias] = out[k]
    return out


def selected(graph: Graph, names: str) -> list[Node]:
    """The tasks of a list of names parted by commas; ValueError for one that isn't there."""
    by_name = {n.name: n for n in graph.nodes}
    wanted = [x.strip() for x in names.split(",") if x.strip()]
    if missing := [x for x in wanted if x not in by_name]:
        raise ValueError(f"no task {', '.join(missing)}; there are {', '.join(sorted(by_name))}")
    return [by_name[x] for x in wanted]


def problems(graph: Graph, given: dict[str, dict[str, Any]], values: Iterable[str] = ()) -> list[str]:
    """What is wrong with the arguments that a profile gives to tasks: unknown tasks, arguments that a task doesn't take, and those that nothing gives it. values: names of a configuration."""
    by_name = {n.name: n for n in graph.nodes}
    shared = {alias for n in graph.nodes if n.kind == "config" for k, v in n.values.items() for alias in [v[1] if isinstance(v, tuple) else k]} | {"spark", *values} | {n.name for n in graph.nodes if n.result}
    out = [f"no task {t}" for t in given if t not in by_name]
    for n in graph.nodes:
        if n.kind not in {"python", "map"} or n.run is None:
            continue
        try:
            wanted = inspect.signature(n.run).parameters
        except ValueError:  # built-in functions may tell nothing
            continue
        every = any(p.kind is p.VAR_KEYWORD for p in wanted.values())
        own = given.get(n.name, {})
        out += [f"{n.name} takes no {k}" for k in own if k not in wanted and not every]
        open_ = [k for k, p in wanted.items() if p.default is p.empty and p.kind in {p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY} and k not in own and k not in shared]
        if n.kind == "map":  # an item, or the columns of a row
            source = by_name.get(n.over.split(".")[0]) if n.over else None
            open_ = [] if source is not None and source.result else open_[1:]
        out += [f"{n.name} gets no {k}" for k in open_]
    return out


def given(fn: Callable[..., Any], values: dict[str, Any], results: dict[str, Any]) -> dict[str, Any]:
    """The arguments that fn takes of values. `{"ref": "task"}` is that task's result, `{"ref": "task.a.b"}` what is at a.b in it; texts become paths where fn says so."""
    try:
        wanted = inspect.signature(fn).parameters
    except ValueError:
        return {}
    every = any(p.kind is p.VAR_KEYWORD for p in wanted.values())
    return {k: _as(wanted[k].annotation if k in wanted else None, _referred(v, results)) for k, v in values.items() if every or k in wanted}


def _referred(v: Any, results: dict[str, Any]) -> Any:
    if not (isinstance(v, dict) and v.keys() == {"ref"} and isinstance(v["ref"], str)):
        return v
    task, *way = v["ref"].split(".")
    if task not in results:
        raise ProfileError(f"ref {v['ref']}: {task} has no result yet")
    found = results[task]
    for step in way:
        found = found.get(step) if isinstance(found, dict) else getattr(found, step, None)
    return found


def _as(annotation: Any, v: Any) -> Any:
    """v as a path, or a list of paths, where that is asked for."""
    asked = str(getattr(annotation, "__name__", annotation) if not hasattr(annotation, "__args__") else annotation)
    if "Path" not in asked:
        return v
    if isinstance(v, str):
        return Path(v)
    return [Path(x) if isinstance(x, str) else x for x in v] if isinstance(v, (list, tuple)) else v
