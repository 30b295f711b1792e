import pytest

from weft.plans import dag
from weft.plans.profiles import Profile, ProfileError, cut, gate, prune, resolve


def t(name, **kw):
    return dag.task(lambda: name, name=name, **kw)


def names(nodes):
    return [n.name for n in nodes]


def test_order_keeps_chains_together():
    a, b, c, d = map(t, "abcd")
    g = a >> dag.parallel(b >> c, d)
    assert names(dag.order(g)) == ["a", "parallel", "b", "c", "d"]
    assert [names(x) for x in dag.lanes(g)] == [["a"], ["parallel"], ["b", "d"], ["c"]]


def test_cycle_is_named():
    a, b = t("a"), t("b")
    with pytest.raises(dag.GraphError, match="a, b"):
        dag.order(dag.Graph([a, b], [(a, b), (b, a)]))


def test_empty_and_wrong_arguments():
    with pytest.raises(ValueError):
        dag.parallel()
    with pytest.raises(ValueError):
        dag.any_of()
    with pytest.raises(TypeError):
        dag.any_of("x")
    with pytest.raises(TypeError):
        dag.config(x=1)


def test_requires_are_added_once():
    base = t("base")
    p = dag.Pipeline("p", dag.parallel(t("x", requires=[base]), t("y", requires=[base])))
    assert names(p.nodes).count("base") == 1
    assert names(dag.order(p)).index("base") < names(dag.order(p)).index("x")


def test_stage_selection_and_bypass():
    left, right, extra = t("left"), t("right"), t("extra", optional="more")
    g = dag.Graph.of(t("in")) >> dag.stage("kind", left, right >> extra) >> t("out")
    kept = prune(g, Profile(stages={"kind": ("left",)}))
    assert names(kept.nodes) == ["in", "kind", "left", "out"]
    both = prune(g, Profile())
    assert ("right", "out") in [(a.name, b.name) for a, b in both.edges]
    assert "extra" in names(prune(g, Profile(groups={"*.more": True})).nodes)
    with pytest.raises(ProfileError, match="Did you mean left"):
        prune(g, Profile(stages={"kind": ("lef",)}))
    assert [(a.name, b.name) for a, b in prune(g, Profile(stages={"kind": ()})).edges] == [("in", "kind"), ("kind", "out")]


def test_gate_and_cursors():
    a, b = t("a"), t("b")
    g = dag.Graph.of(a) >> t("c", requires=[dag.any_of(b)])
    assert names(gate(g).nodes) == ["a"]
    g = a >> b >> t("c")
    kept, skipped = cut(g, Profile(start_from="b", stop_after="b"))
    assert names(kept.nodes) == ["a", "b"] and names(skipped) == ["a"]
    with pytest.raises(ProfileError):
        cut(g, Profile(start_from="c", stop_after="a"))


def test_profiles_inherit():
    raw = {"base": {"args": {"x": {"k": 1, "m": 1}}, "more": True, "kind": ["a"], "start_from": "x"}, "dev": {"extends": "base", "args": {"x": {"k": 2}}, "kind": ["b"], "more": False}}
    p = resolve(raw, "dev")
    assert p.args == {"x": {"k": 2, "m": 1}} and p.stages == {"kind": ("a", "b")} and p.groups == {"more": False} and p.start_from is None
    with pytest.raises(ProfileError, match="a -> b -> a"):
        resolve({"a": {"extends": "b"}, "b": {"extends": "a"}}, "a")


def test_plan_of_ninety_tasks_is_fast(spark):
    import time

    from weft.plans.run import plan

    g = dag.Graph.of(t("t0"))
    for i in range(1, 90):
        g = g >> t(f"t{i}")
    began = time.time()
    assert len(plan(dag.Pipeline("p", g), spark)) == 90
    assert time.time() - began < 1
