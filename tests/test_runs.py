import random

import pytest
from pyspark.sql import functions as F

from weft.errors import GraphError, ProfileError, StateStoreError, TaskError
from weft.functions import fingerprint as fp
from weft.operators import lineage, mapped, relations
from weft.operators.state import MemoryStore, NoStore, TableStore, store
from weft.plans import config, dag
from weft.plans.profiles import Profile, cut
from weft.plans.run import run
from weft.sources import preview, scan, sql


def names(nodes):
    return [n.name for n in nodes]


def test_order_is_depth_first_and_by_declaration():
    rng = random.Random(4)

    def slow(graph):
        """Each time the node that became ready last, of those that did at once the first."""
        waits = {n: sum(b is n for _, b in graph.edges) for n in graph.nodes}
        ready, out = [n for n in graph.nodes if not waits[n]], []
        while ready:
            n = ready.pop(0)
            out.append(n)
            new = []
            for a, b in graph.edges:
                if a is n:
                    waits[b] -= 1
                    new += [b] if not waits[b] else []
            ready = new + ready
        return out

    for _ in range(200):
        nodes = [dag.Node(str(k)) for k in range(9)]
        edges = [(nodes[a], nodes[b]) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.3]
        rng.shuffle(edges)
        g = dag.Graph(nodes, edges)
        assert names(dag.order(g)) == names(slow(g))


def test_cursors_keep_groups_whole():
    t = {n: dag.task(lambda: None, name=n) for n in "abcdefg"}
    g = t["a"] >> dag.stage("s", t["b"] >> t["c"], t["d"]) >> t["e"] >> dag.parallel("p", t["f"], t["g"])
    kept, skipped = cut(g, Profile(start_from="d", stop_after="b"))
    assert set(names(kept.nodes)) == {"a", "s", "b", "c", "d"} and names(skipped) == ["a"]
    kept, _ = cut(g, Profile(stop_after="p"))
    assert len(kept.nodes) == 9
    with pytest.raises(ProfileError, match="Did you mean"):
        cut(dag.Graph.of(dag.task(lambda: None, name="report")), Profile(stop_after="reprot"))


def test_parameters_reach_sql_files(spark, tmp_path):
    path = tmp_path / "sums.sql"
    path.write_text("select sum(id) + :plus as s from range(:most)")
    p = dag.Pipeline("p", dag.config(plus=lambda: 10) >> dag.sql_task(str(path)))
    assert run(p, spark, profile=Profile(args={"sums": {"most": 4, "unused": 1}}))["sums"].first().s == 16
    (tmp_path / "near.json").write_text('{"x": 7}')
    path.write_text("select x from json.`near.json`")
    assert run(dag.Pipeline("p", dag.sql_task(str(path))), spark)["sums"].first().x == 7


def test_calls_never_cache(spark):
    ran = []
    p = dag.Pipeline("p", dag.task(lambda: ran.append(1), name="a"))
    p(spark)
    p.run(spark)
    assert len(ran) == 2
    with pytest.raises(TypeError):
        p(spark, no_cache=False)
    s = NoStore()
    s.write_hash("k", "p", "t", "h")
    assert s.read_hash("k", "p", "t") is None


def test_stores_by_kind(spark, tmp_path):
    assert isinstance(store("table", spark, str(tmp_path / "s")), TableStore) and type(store("memory")) is MemoryStore and isinstance(store("none"), NoStore)
    with pytest.raises(ValueError):
        store("other")
    with pytest.raises(StateStoreError):
        store("table", spark)


def test_failures_keep_the_log(spark):
    def bad():
        raise ValueError("no")

    with pytest.raises(TaskError, match="bad: no") as e:
        run(dag.Pipeline("p", dag.task(lambda: 1, name="good") >> bad), spark)
    assert e.value.log == ["[RUN] good", "[RUN] bad", "[FAIL] bad"]
    with pytest.raises(TaskError, match="config.x: no"):
        run(dag.Pipeline("p", dag.config(x=bad) >> dag.task(lambda x: x, name="t")), spark)


def test_checkpoints(spark, tmp_path):
    ran = []

    def first(spark):
        ran.append("first")
        return spark.range(3)

    def second(spark):
        ran.append("second")
        return spark.table("c_first").agg(F.sum("id").alias("s"))

    def third(spark):
        ran.append("third")

    def pipeline(fn=second):
        return dag.Pipeline("kept", dag.task(first, outputs=["table://c_first"]) >> dag.task(fn, name="second", outputs=["table://c_second"], checkpoint=True) >> dag.task(third))

    place = str(tmp_path / "checkpoints")
    assert "[CHECKPOINT] second" in run(pipeline(), spark, checkpoints=place)["log"]
    for t in ("c_first", "c_second"):
        spark.sql(f"drop table {t}")
    log = run(pipeline(), spark, checkpoints=place)["log"]
    assert log == ["[RESTORE] second", "[SKIP] first - cached", "[SKIP] second - cached", "[RUN] third"] and spark.table("c_second").first().s == 3
    # with state of its own, or forced, a run restores nothing
    s = MemoryStore()
    s.write_hash("", "kept", "first", "other")
    assert "[RESTORE] second" not in run(pipeline(), spark, s, checkpoints=place)["log"]
    assert "[RESTORE] second" not in run(pipeline(), spark, force=True, checkpoints=place)["log"]

    def changed(spark):
        return spark.table("c_first").agg(F.max("id").alias("s"))

    del ran[:]
    log = run(pipeline(changed), spark, checkpoints=place)["log"]  # the snapshot is out of date
    assert log[0] == "[RUN] first" and ran == ["first", "third"] and spark.table("c_second").first().s == 2
    for t in ("c_first", "c_second"):
        spark.sql(f"drop table {t}")


def test_mapped_tasks_run_on_executors_and_skip_items(spark, tmp_path):
    out = tmp_path / "out.txt"
    out.write_text("x")
    p = dag.Pipeline("p", dag.task(lambda: {"items": ["a", "b"]}, name="lister") >> dag.map_over(dag.task(lambda i, n=2: i * n, name="twice", outputs=[str(out)]), "lister.items"))
    s = MemoryStore()
    done = run(p, spark, s, profile=Profile(args={"twice": {"n": 3}}))
    assert done["twice"] == ["aaa", "bbb"] and "[RUN] twice[a]" in done["log"]
    again = run(p, spark, s)
    assert again["twice"] == [None, None] and "[SKIP] twice[b] - cached" in again["log"]
    out.write_text("y")
    assert "[RUN] twice[b]" in run(p, spark, s)["log"]

    def odd(i):
        if i % 2:
            raise ValueError("odd")

    with pytest.raises(TaskError, match=r"odd\[1\]: ValueError: odd"):
        run(dag.Pipeline("p", dag.task(lambda: [2, 1], name="lister") >> dag.map_over(dag.task(odd), "lister")), spark)
    assert "[WARN] odd - nothing at lister.x" in run(dag.Pipeline("p", dag.task(lambda: {}, name="lister") >> dag.map_over(dag.task(odd), "lister.x")), spark)["log"]


def test_combined_hash_is_by_blocks(spark):
    rows = spark.range(25).select(F.col("id").alias("idx"), F.concat(F.lit("h"), "id").alias("output_hash"))
    assert mapped.combined_hash(rows, 10) == mapped.combined_hash(rows.repartition(5), 10) != mapped.combined_hash(rows.withColumn("output_hash", F.lit("h")), 10)


def test_levels_and_bins(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert {r.node: r.level for r in relations.levels(edges).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(GraphError):
        relations.levels(edges.union(spark.createDataFrame([("c", "a")], "src string, dst string")))
    rows = spark.range(1203).select(F.col("id").alias("p"), (F.col("id") * 2).alias("v"))
    bins = relations.bin_lists(rows, "p", "v")
    assert bins.count() == 3
    assert [r.item for r in relations.unbinned(relations.with_item(bins, 700, F.lit(-5).cast("long"))).orderBy("position").collect()] == [-5 if i == 700 else 2 * i for i in range(1203)]


def test_lineage_of_tables_that_do_not_exist(spark):
    tree = lineage.Tree(spark, {"Spend": "with o as (select * from sales.Orders) select * from o join people", "report": "select * from spend where x in (select y from limits)"})
    assert tree.depends_on("report") == ["limits", "Spend"] and tree.depends_on("spend") == ["orders", "people"]
    with pytest.raises(KeyError, match="Spend, report|report"):
        tree.depends_on("gone")
    found = {(r.node, r.way, r.direct) for r in lineage.reach(tree.edges(spark), spark.createDataFrame([("Spend",)], "node string")).collect()}
    assert found == {("report", "down", True), ("orders", "up", True), ("people", "up", True)}


def test_statements_that_delete_and_previews(spark, tmp_path):
    df = sql.run_text(spark, "create or replace table d_t as select id from range(5); insert into d_t values (9); delete from d_t where id < :n; select * from d_t", {"n": 3})
    assert sorted(r.id for r in df.collect()) == [3, 4, 9]
    spark.sql("drop table d_t")
    assert preview.any_filter(spark.createDataFrame([("a;b",), ("c",)], "v string"), "v = 'a;b'").count() == 1
    with pytest.raises(ValueError):
        preview.query_preview(spark, "select 1; select 2")
    assert preview.query_preview(spark, "select 1 as x;")["rows"] == [[1]]
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.json").write_text('{"k": 2, "w": true}\n')
    assert sorted(tuple(r) for r in scan.scan_all(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")]).select("k", "v", "w").collect()) == [(1, "x", None), (2, None, True)]


def test_fingerprints_of_rows_objects_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert fp.row_fingerprint(df) == fp.row_fingerprint(df.repartition(3)) != fp.row_fingerprint(df.limit(0))
    assert fp.object_fingerprint([1]) != fp.object_fingerprint([2])
    (tmp_path / "x1.txt").write_text("1")
    (tmp_path / "x2.txt").write_text("2")
    assert len(fp.output_files(spark, f"file://{tmp_path}/x${{n}}.txt")) == 2 and len(fp.output_files(spark, f"{tmp_path}/x${{n}}.txt", {"n": 1})) == 1
    assert fp.output_fingerprint(spark, (f"file://{tmp_path}/x1.txt",)) and fp.output_fingerprint(spark, (f"file://{tmp_path}/x3.txt",)) is None


def test_configuration(tmp_path):
    (tmp_path / "more.json").write_text('{"b": {"y": 2}, "l": [2, 3]}')
    found = config.values_of({"include": "more.json", "b": {"x": 1}, "l": [1, 2], "call": {"here": "os:getcwd"}, "aliases": {"c": "b"}}, str(tmp_path))
    assert found["b"] == {"x": 1, "y": 2} == found["c"] and sorted(found["l"]) == [1, 2, 3] and found["here"]
    with pytest.raises(ProfileError, match="a.b is both 1 and 2"):
        config.merged({"a": {"b": 1}}, {"a": {"b": 2}})
    g = dag.config(x=lambda: 1) >> dag.task(lambda spark, x, y, z=1: 0, name="t")
    assert config.problems(g, {"t": {"w": 1}, "u": {}}) == ["no task u", "t takes no w", "t gets no y"]
    assert names(config.selected(g, "t, config")) == ["t", "config"]
    with pytest.raises(ValueError):
        config.selected(g, "t,u")
