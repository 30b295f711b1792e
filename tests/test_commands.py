"""The command line, configuration of runs, and hints about resources."""

import json
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weft.__main__ import main
from weft.errors import ProfileError, TaskError
from weft.operators.state import TableStore
from weft.plans import dag
from weft.plans.profiles import Profile
from weft.plans.resources import Compute, profile, profile_for
from weft.plans.run import plan, run

MODULE = '''
from weft.plans import dag


def made(spark, rows):
    return spark.range(rows)


def told(plus=0):
    print("told", plus)


pipeline = dag.Pipeline("commands", dag.task(made, outputs=["table://commands_made"]) >> dag.task(told))
'''


@pytest.fixture
def place(tmp_path, monkeypatch, spark):
    (tmp_path / "commands_module.py").write_text(MODULE)
    (tmp_path / "shared.json").write_text(json.dumps({"rows": 4}))
    (tmp_path / "config.json").write_text(json.dumps({"include": "shared.json", "other": 1}))
    (tmp_path / "profiles.yaml").write_text("profiles:\n  dev:\n    args:\n      told: {plus: 7}\n  wrong:\n    args:\n      nobody: {x: 1}\n      told: {minus: 7}\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.syspath_prepend(str(tmp_path))
    yield tmp_path
    sys.modules.pop("commands_module", None)
    spark.sql("drop table if exists commands_made")


def test_commands(place, capsys, spark):
    every = ["commands_module:pipeline", "--config", "config.json"]
    assert main(["validate", *every]) == 0 and "all arguments fit" in capsys.readouterr().out
    assert main(["validate", "commands_module"]) == 1 and "made gets no rows" in capsys.readouterr().out
    assert main(["validate", *every, "--profile", "wrong"]) == 1 and capsys.readouterr().out.splitlines() == ["no task nobody", "told takes no minus"]
    assert main(["run", *every, "--profile", "wrong"]) == 1 and "told takes no minus" in capsys.readouterr().err
    assert main(["run", *every, "--profile", "dev", "--state", "state"]) == 0
    assert capsys.readouterr().out.splitlines() == ["told 7", "[RUN] made", "[RUN] told"] and spark.table("commands_made").count() == 4
    assert main(["plan", *every, "--state", "state"]) == 0 and capsys.readouterr().out.splitlines() == ["SKIP made", "RUN told"]
    assert main(["run", *every, "--state", "state", "--tasks", "told"]) == 0 and capsys.readouterr().out.splitlines() == ["told 0", "[RUN] told"]
    assert (place / "state").is_dir() and (place / "state-digests").is_dir()
    assert main(["run", *every, "--tasks", "nobody"]) == 1 and "no task nobody" in capsys.readouterr().err
    assert main(["run", *every, "--profile", "nobody"]) == 1


def test_configuration_reaches_tasks(spark, tmp_path):
    got = []
    p = dag.Pipeline("p", dag.task(lambda a, b, c=3: got.append((a, b, c)), name="t"))
    (tmp_path / "more.json").write_text('{"b": 2}')
    run(p, spark, config={"include": "more.json", "a": 1, "aliases": {"c": "a"}}, base=str(tmp_path))
    run(p, spark, config={"a": 1, "b": 5}, profile=Profile(args={"t": {"a": 9}}))
    assert got == [(1, 2, 1), (9, 5, 3)]
    with pytest.raises(ProfileError, match="t gets no a; t gets no b"):
        run(p, spark)


def test_arguments_refer_to_results_and_become_paths(spark, tmp_path):
    got = []

    def made():
        return {"deep": {"n": 5}}

    def used(n, where: Path, more: list[Path], all_of=None):
        got.append((n, where, more, all_of))

    p = dag.Pipeline("p", dag.task(made) >> dag.task(used))
    run(p, spark, profile=Profile(args={"used": {"n": {"ref": "made.deep.n"}, "where": "a/b", "more": ["c"], "all_of": {"ref": "made"}}}))
    assert got == [(5, Path("a/b"), [Path("c")], {"deep": {"n": 5}})]
    with pytest.raises(TaskError, match="later has no result yet"):
        run(dag.Pipeline("p", dag.task(lambda x: x, name="early") >> dag.task(made, name="later")), spark, profile=Profile(args={"early": {"x": {"ref": "later"}}}))
    with pytest.raises(TypeError, match="not a task"):
        dag.map_over("text", "made")


def test_hints_are_numbers_or_none():
    assert Compute.of({"cpu": 256, "memory": "512"}) == Compute(0.25, 512) and Compute.of({"cpu": "2"}) == Compute(2.0, None) and Compute.of({"cpu": 64}) == Compute(0.0625, None)
    assert Compute.of({"cpu": 63.5, "memory": 0.5}) == Compute(63.5, 1)
    for none in (None, {}, {"cpu": 0}, {"cpu": -1, "memory": "many"}, {"cpu": "nan"}, "2"):
        assert Compute.of(none) is None


def test_profiles_are_for_clusters_that_take_them(spark):
    own = profile(Compute(2.5, 3000), True)
    assert own.taskResources["cpus"].amount == 3 and own.executorResources["memory"].amount == 3000 and own.executorResources["cores"].amount == 3
    assert profile(Compute(0.25, 3000), False).executorResources == {}
    assert profile_for(spark, Compute(2, 1)) is None  # the session's master is local


def test_profiles_show_in_plans(spark, capsys):
    spark.range(3).mapInPandas(lambda batches: batches, "id long", profile=profile(Compute(2.5, 100), False)).explain()
    assert "amount: 3" in capsys.readouterr().out


def test_hints_do_not_stop_a_local_run(spark, tmp_path):
    listed = dag.task(lambda spark: spark.range(5).select(F.col("id").alias("idx"), F.col("id").alias("a")), name="listed", result="a long")
    p = dag.Pipeline("hints", listed >> dag.map_over(dag.task(lambda a: a + 1, name="more", result="value long", compute={"cpu": 512, "memory": 100}), "listed"))
    assert sorted(r.value for r in run(p, spark, results=str(tmp_path))["more"].collect()) == [1, 2, 3, 4, 5]


def test_plan_of_ninety_tasks_with_a_table_of_state(spark, tmp_path):
    tasks = [dag.task(lambda: None, name=f"t{i}") for i in range(90)]
    graph = dag.Graph.of(tasks[0])
    for t in tasks[1:]:
        graph = graph >> t
    p, state = dag.Pipeline("p", graph), TableStore(spark, str(tmp_path / "state"))
    with state.batch():
        for t in tasks:
            state.write_hash("", "p", t.name, "h")
    began = time.time()
    assert len(plan(p, spark, TableStore(spark, str(tmp_path / "state")))) == 90
    assert time.time() - began < 5  # reading the table included
    state = TableStore(spark, str(tmp_path / "state"))
    assert len(state.list_tasks("", "p")) == 90
    began = time.time()
    plan(p, spark, state)
    assert time.time() - began < 1
