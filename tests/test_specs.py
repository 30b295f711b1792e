import pytest
import yaml

from weft.errors import GraphError
from weft.plans import dag, specs
from weft.plans.run import run

SPEC = """
graphs:
  base:
    tasks:
      load: {call: "spec_jobs:load", args: {rows: 3, step: 1}}
      check: load
  more:
    extends: base
    tasks:
      load: {call: "spec_jobs:other"}
      sums: {file: sums.sql, deps: [load, check]}
  both:
    extends: [{graph: more, args: {load: {rows: 5}}}, base]
    tasks:
      ten: {call: "spec_jobs:ten", deps: load, map_over: load}
"""


def test_graphs_take_in_others(spark, tmp_path, monkeypatch):
    (tmp_path / "spec_jobs.py").write_text("def load(rows, step):\n    return list(range(0, rows * step, step))\n\n\ndef other():\n    raise ValueError\n\n\ndef ten(i):\n    return i * 10\n")
    (tmp_path / "sums.sql").write_text("select count(*) as n from range(4)")
    monkeypatch.syspath_prepend(str(tmp_path))
    graphs = yaml.safe_load(SPEC)["graphs"]
    flat = specs.flattened(graphs, "both")
    assert list(flat) == ["load", "check", "sums", "ten"] and flat["load"]["args"] == {"rows": 5, "step": 1} and flat["check"]["deps"] == ["load"]
    assert specs.flattened(graphs, "more")["load"]["args"]["rows"] == 3  # as the graph has it
    p, profile = specs.pipeline(graphs, "both", str(tmp_path))
    assert [n.name for n in dag.order(p)] == ["both", "load", "check", "sums", "ten"]
    spark.sparkContext.addPyFile(str(tmp_path / "spec_jobs.py"))
    done = run(p, spark, profile=profile)
    assert done["load"] == [0, 1, 2, 3, 4] and done["ten"] == [0, 10, 20, 30, 40] and done["sums"].first().n == 4


@pytest.mark.parametrize(
    ("graphs", "said"),
    [
        ({"a": {"extends": "b"}, "b": {"extends": "a"}}, "a -> b -> a"), ({"a": {"extends": "z"}}, "no graph z"), ({"a": {}}, "a has no tasks"), ({"a": {"tasks": {"x": "y"}}}, "x depends on y"),
        ({"a": {"tasks": {"x": {"colour": 1}}}}, "x: unknown colour"), ({"a": {"tasks": {"x": "y", "y": "x"}}}, "cycle"),
    ],
)
def test_what_is_wrong_is_named(graphs, said):
    with pytest.raises(GraphError, match=said):
        specs.pipeline(graphs, "a")
