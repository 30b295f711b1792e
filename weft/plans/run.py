"""Runs a pipeline: skips what is cached, forces what follows a change, and materialises declared tables inside their task."""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import HashError, ProfileError, TaskError
from ..functions.digests import Digests
from ..functions.fingerprint import code_fingerprint, file_fingerprint, output_fingerprint
from ..operators import items as rows_of
from ..operators import mapped, relations
from ..operators.state import MemoryStore, NoStore, TableStore
from ..sources import sink
from . import profiles as P
from . import snapshot
from .config import given, problems, selected, values_of
from .dag import Graph, Node, Pipeline, lanes, order
from .resources import Compute, profile_for


def compiled(pipeline: Pipeline, profile: P.Profile | None) -> tuple[Graph, set[Node]]:
    graph: Graph = pipeline
    skipped: set[Node] = set()
    if profile is not None:
        graph = P.prune(graph, profile, pipeline.name)
        graph, skipped = P.cut(graph, profile)
    return P.gate(graph), skipped


def _code(n: Node) -> str:
    return file_fingerprint(n.path) if n.path else code_fingerprint(n.run)


def fingerprint(spark: SparkSession, n: Node, table: Callable[[str], DataFrame | str | None] | None = None, digests: Digests | None = None) -> str | None:
    """Of a task's code and its outputs; None while an output is missing. table: where tables are read from, if not the session's."""
    if n.outputs and (found := output_fingerprint(spark, n.outputs, table, digests)) is None:
        return None
    return hashlib.sha256(f"{_code(n)}:{found if n.outputs else ''}".encode()).hexdigest()


def plan(pipeline: Pipeline, spark: SparkSession, store: Any = None, profile: P.Profile | None = None, storage_key: str = "") -> list[tuple[str, str]]:
    """(action, task) in order: RUN, SKIP or MAP; what a run would force after a change is not simulated."""
    graph, skipped = compiled(pipeline, profile)
    out = []
    for n in order(graph):
        if n.kind in {"python", "sql"} and n not in skipped:
            try:
                now = fingerprint(spark, n) if n.outputs else None
            except HashError:  # such a task runs
                now = None
            out.append(("SKIP" if now and store and store.read_hash(storage_key, pipeline.name, n.name) == now else "RUN", n.name))
        elif n.kind == "map":
            out.append(("MAP", n.name))
    return out


_EVENT = re.compile(r"\[(\w+)\] (\S+(?: \d+)?)(?: - (.*))?")


def events(spark: SparkSession, log: list[str]) -> DataFrame:
    """nth, event, task, note of the lines of a run's log."""
    found = [(k, *m.groups()) for k, line in enumerate(log) if (m := _EVENT.match(line))]
    return spark.createDataFrame(found, "nth long, event string, task string, note string")


def run(
    pipeline: Pipeline, spark: SparkSession, store: Any = None, profile: P.Profile | None = None, storage_key: str = "", force: bool = False, no_cache: bool = False, checkpoints: str | None = None,
    results: str | None = None, digests: Digests | None = None, config: dict[str, Any] | None = None, base: str = ".", tasks: str | None = None,
) -> dict[str, Any]:
    """Results by task name. Lanes run one after the other, the tasks of one at the same time; the first failure ends the run, and what is done stays recorded.

    no_cache: every task runs and no state is kept. checkpoints, results: the folders of snapshots and of kept results, if not the session's. digests: kept digests
    of outputs, so that files that haven't changed aren't read for fingerprints; beside a table store they are kept anyway. config: values for all tasks, see config.values_of, with files beside base; tasks: names of those
    that are to run, parted by commas. Arguments that don't fit the tasks are a ProfileError before anything runs.
    """
    store = NoStore() if no_cache else MemoryStore() if store is None else store
    if digests is None and isinstance(store, TableStore):
        digests = Digests(spark, f"{store.path.rstrip('/')}-digests")
    graph, skipped = compiled(pipeline, profile)
    values: dict[str, Any] = {"spark": spark} | values_of(config or {}, base)
    if wrong := problems(pipeline, profile.args if profile else {}, set(values)):
        raise ProfileError("; ".join(wrong))
    if tasks is not None:
        chosen = selected(graph, tasks)
        skipped = skipped | {n for n in graph.nodes if n.kind in {"python", "sql", "map"} and n not in chosen}
    shared: dict[str, DataFrame] = {}  # kept results
    kept = results or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    results = {}
    dirty: set[Node] = set()
    same: set[Node] = set()  # of the mapped tasks, those of which no row ran
    log: list[str] = []
    before = {n: [a for a, b in graph.edges if b is n] for n in graph.nodes}
    place = snapshot.folder(spark, checkpoints, pipeline.name) if any(n.checkpoint for n in graph.nodes) and not no_cache else None
    if place and not force and not store.list_tasks(storage_key, pipeline.name):
        last = snapshot.candidate(spark, place, order(graph), lambda n, s: fingerprint(spark, n, lambda t: s.rows(spark, t, digests) if t in s.tables else None))
        if last:
            snapshot.restore(spark, last, lambda task, value: store.write_hash(storage_key, pipeline.name, task, value))
            log.append(f"[RESTORE] {last.task}")

    def arguments(n: Node) -> dict[str, Any]:
        return shared | values | (profile.args.get(n.name, {}) if profile else {})

    def numbered(out: Any, schema: str) -> DataFrame:
        """The rows of a result, with idx: in the order of a list, and in that of all columns for a relation that has none."""
        if not isinstance(out, DataFrame):
            names = spark.createDataFrame([], schema).columns
            out = [dict(zip(names, r if isinstance(r, tuple) else (r,), strict=True)) if not isinstance(r, dict) else r for r in out]
            return spark.createDataFrame([(k, *(r.get(c) for c in names)) for k, r in enumerate(out)], f"idx long, {schema}")
        return out if "idx" in out.columns else relations.indexed(out, out.columns)

    def result_of(n: Node) -> rows_of.Results:
        schema = n.result or "value string"
        return rows_of.Results(spark, f"{kept}/results/{pipeline.name}/{n.name}-{hashlib.sha256(schema.encode()).hexdigest()[:8]}", schema)

    def keep(n: Node, r: rows_of.Results) -> None:
        results[n.name] = shared[n.name] = r.values()

    def call(n: Node) -> Any:
        if n.kind == "sql":
            return n.run(spark=spark, args={k: v for k, v in arguments(n).items() if k != "spark"})
        return n.run(**given(n.run, arguments(n), results))

    def state(n: Node, name: str, forced: bool) -> tuple[bool, str | None]:
        now = fingerprint(spark, n, digests=digests) if n.outputs else None
        return bool(now and not forced and now == store.read_hash(storage_key, pipeline.name, name)), now

    def over(n: Node, forced: bool) -> None:
        """Runs a task for each item; an item's state is its own, and the first error ends the run."""
        first, *path = n.over.split(".")
        items = results.get(first)
        for p in path:
            items = items.get(p) if isinstance(items, dict) else getattr(items, p, None)
        if items is None:
            log.append(f"[WARN] {n.name} - nothing at {n.over}")
        wanted = list(inspect.signature(n.run).parameters)
        if isinstance(items, DataFrame):
            return by_rows(n, items, wanted, forced)
        items = list(items or [])
        names = [f"{n.name}[{i}]" for i in items]
        key = (storage_key, pipeline.name, n.name)
        now = fingerprint(spark, n, digests=digests) if n.outputs else None  # one for all items
        known = store.item_hashes(*key) if now and not forced else {}
        cached = [bool(now) and known.get(str(i)) == now for i in items]
        log.extend(f"[{'SKIP' if c else 'RUN'}] {name}" + (" - cached" if c else "") for name, c in zip(names, cached, strict=True))
        todo = [k for k, c in enumerate(cached) if not c]
        more = {k: v for k, v in given(n.run, arguments(n), results).items() if k in wanted[1:]}
        if "spark" in wanted:  # such tasks start jobs of their own
            done = []
            for k in todo:
                began = datetime.now(UTC)
                done.append((True, n.run(items[k], **more), None, began, datetime.now(UTC)))
        else:
            done = mapped.run_items(spark, n.run, [items[k] for k in todo], more)
        results[n.name] = [None] * len(items)
        now = fingerprint(spark, n, digests=digests) if n.outputs and todo else now
        store.write_items(key, [(str(items[k]), "SUCCESS" if ok else "FAILURE", began, ended, now, error) for k, (ok, _, error, began, ended) in zip(todo, done, strict=True)])
        for k, (ok, value, error, _, _) in zip(todo, done, strict=True):
            if not ok:
                raise RuntimeError(f"{names[k]}: {error}")
            results[n.name][k] = value

    def by_rows(n: Node, items: DataFrame, wanted: list[str], forced: bool) -> None:
        """Runs a task for each row of a kept result, whose columns, and the fields of its structs, are arguments by name."""
        items = rows_of.apart(items)
        columns = [c for c in items.columns if c != "idx" and c in wanted]
        more = {k: v for k, v in given(n.run, arguments(n), results).items() if k in wanted and k not in columns and k != "spark"}
        own = result_of(n)
        groups = rows_of.run_groups(own, items, n.run, columns, more, fingerprint(spark, n, digests=digests) or _code(n), n.bundle or rows_of.BUNDLE, n.group or rows_of.GROUP, forced, profile_for(spark, Compute.of(n.compute)))
        log.extend(f"[GROUP] {n.name} {g}" for g in groups)
        keep(n, own)
        if not groups:
            same.add(n)

    def one(n: Node) -> None:
        if n in skipped:
            return
        if n.kind == "config":
            for k, v in n.values.items():
                make, alias = v if isinstance(v, tuple) else (v, k)
                try:
                    values[alias] = make()
                except Exception as e:
                    log.append(f"[FAIL] {n.name}.{k}")
                    raise TaskError(f"{n.name}.{k}: {e}", log) from e
            return
        source = n.over.split(".")[0] if n.kind == "map" and n.over else None
        # rows of a kept result are compared one by one
        forced = force or no_cache or any(a in dirty and not (a.name == source and a.result) for a in before[n])
        if n.kind not in {"python", "sql", "map"}:
            if forced:
                dirty.add(n)
            return
        cached, now = state(n, n.name, forced) if n.kind != "map" else (False, None)
        own = result_of(n) if n.result and n.kind == "python" else None
        if own and not forced and not no_cache and (cached or not n.outputs) and own.output_hash() == _code(n):
            log.append(f"[SKIP] {n.name} - cached")
            return keep(n, own)
        if cached and own is None:
            log.append(f"[SKIP] {n.name} - cached")
            kind, _, name = n.outputs[0].partition("://")
            results[n.name] = spark.table(name) if kind == "table" else sink.read(spark, name) if kind in sink.FORMATS else None
            return
        log.append(f"[{'MAP' if n.kind == 'map' else 'RUN'}] {n.name}")
        try:
            if n.kind == "map":
                over(n, forced)
            else:
                out = call(n)
                tables = [u.removeprefix("table://") for u in n.outputs if u.startswith("table://")]
                if own:
                    own.put(numbered(out, n.result), _code(n))
                    keep(n, own)
                    out = results[n.name]
                elif isinstance(out, DataFrame) and n.kind == "python" and len(tables) == 1:
                    out.write.mode("overwrite").saveAsTable(tables[0])
                    out = spark.table(tables[0])
                elif isinstance(out, DataFrame) and n.kind == "python" and len(n.outputs) == 1 and n.outputs[0].partition("://")[0] in sink.FORMATS:
                    kind, _, name = n.outputs[0].partition("://")
                    sink.put(out, name, kind)
                    out = sink.read(spark, name)
                results[n.name] = out
        except Exception as e:
            log.append(f"[FAIL] {n.name}")
            raise TaskError(f"{n.name}: {e}", log) from e
        if (n.outputs or n.result) and n not in same:
            dirty.add(n)
        if n.outputs:
            if n.kind != "map" and (done := fingerprint(spark, n, digests=digests)) is not None:
                store.write_hash(storage_key, pipeline.name, n.name, done)
        if n.checkpoint and place:
            made = order(graph)
            made = [t for t in made[: made.index(n) + 1] if t.kind in {"python", "sql"}]
            hashes = {t.name: h for t in made if (h := store.read_hash(storage_key, pipeline.name, t.name))}
            snapshot.save(spark, place, n.name, [u.removeprefix("table://") for t in made for u in t.outputs if u.startswith("table://")], hashes, digests)
            log.append(f"[CHECKPOINT] {n.name}")

    for lane in lanes(graph):
        with store.batch(), ThreadPoolExecutor(max(1, len(lane))) as pool:
            begun = [pool.submit(one, n) for n in lane]
            done, rest = wait(begun, return_when=FIRST_EXCEPTION)
            for t in rest:  # those that have not begun
                t.cancel()
            for t in begun:
                if not t.cancelled():
                    t.result()
    results["log"] = log
    return results
