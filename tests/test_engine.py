import hashlib
import importlib

import pytest
from pyspark.sql import functions as F

from weft.functions import fingerprint as fp
from weft.operators import lineage, mapped, relations
from weft.operators.state import MemoryStore, TableStore
from weft.plans import dag
from weft.plans.run import TaskError, plan, run
from weft.sources import preview, sql


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert fp.compatible_fingerprint(df.where("k > 9")) == hashlib.md5(b"empty:").hexdigest()
    digests = [hashlib.md5(b"1,2").hexdigest(), hashlib.md5(b"a").hexdigest()]
    assert fp.compatible_fingerprint(df) == hashlib.md5(f"2:{';'.join(digests)}".encode()).hexdigest()
    assert fp.table_fingerprint(df) == fp.table_fingerprint(df.repartition(3))
    assert fp.table_fingerprint(df) != fp.table_fingerprint(df.union(df))


def test_code_fingerprint_follows_functions_of_modules(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    seen = []
    for k, (clean, deep) in enumerate([("1", "1"), ("2", "1"), ("1", "2"), ("1  # same", "1")]):
        top = tmp_path / f"top{k}"
        (top / "sub").mkdir(parents=True)
        (top / "__init__.py").write_text("")
        (top / "sub/__init__.py").write_text("")
        (top / "helpers.py").write_text(f"def clean():\n    return {clean}\n")
        (top / "sub/deep.py").write_text(f"def fn():\n    return {deep}\n")
        (top / "task.py").write_text(f"import top{k}.sub.deep\nfrom . import helpers, sub\ndef load():\n    return [(lambda: helpers.clean() + sub.deep.fn())() for _ in 'a']\n")
        seen.append(fp.code_fingerprint(importlib.import_module(f"top{k}.task").load))
    assert seen[0] == seen[3] and len(set(seen)) == 3


def test_column_digests_sort_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 50)
    df = spark.range(3000).selectExpr("id as k", "case when id % 3 = 0 then 'often' when id % 7 > 0 then concat('é', id % 50) end as v", "if(id < 0, 'x', null) as `no.ne`", "if(id % 2 = 0, '', null) as e")
    rows = df.collect()
    want = {c: sorted(str(x).encode() for x in (r[c] for r in rows) if x is not None) for c in df.columns}
    assert {r.column_name: r.digest for r in fp.column_digests(df).collect()} == {c: hashlib.md5(b",".join(v)).hexdigest() if v else "null" for c, v in want.items()}
    plans = []
    monkeypatch.setattr(type(df), "toLocalIterator", lambda self, *a, **b: plans.append(self._jdf.queryExecution().executedPlan().toString()) or iter(()))
    fp.column_digests(df.select("k"))
    assert plans and all("rangepartitioning" in p and "SinglePartition" not in p for p in plans)


def test_statements_and_parameters(spark):
    parts = sql.statements("-- first; x\nselect 'a;b'; /* ; */ select \"c;\" ;\n-- end")
    assert len(parts) == 2 and parts[0].endswith("select 'a;b'")
    assert sql.parameters("select :foo, ':bar', v::text, $baz -- :no") == ["foo", "baz"]
    assert sql.run_text(spark, "select $n + 1 as x", {"n": 2, "unused": 1}).first().x == 3
    with pytest.raises(sql.SqlTaskError, match="statement 2/2"):
        sql.run_text(spark, "select 1; select from nowhere")


def test_table_may_be_made_of_itself(spark):
    sql.run_text(spark, "create or replace table self_t as select 1 as x; create or replace table self_t as select x + 1 as x from self_t")
    assert spark.table("self_t").first().x == 2
    spark.sql("drop table self_t")


def test_run_skips_what_is_cached_and_forces_what_follows(spark):
    ran = []

    def first(spark):
        ran.append("first")
        return spark.range(3)

    def second(spark):
        ran.append("second")
        return spark.table("w_first").agg(F.sum("id").alias("s"))

    a, b = dag.task(first, outputs=["table://w_first"]), dag.task(second, outputs=["table://w_second"])
    p, store = dag.Pipeline("p", a >> b), MemoryStore()
    assert run(p, spark, store)["second"].first().s == 3
    assert run(p, spark, store)["log"] == ["[SKIP] first - cached", "[SKIP] second - cached"]
    assert [x for x, _ in plan(p, spark, store)] == ["SKIP", "SKIP"]
    spark.range(5).write.mode("overwrite").saveAsTable("w_first")
    run(p, spark, store)
    assert ran == ["first", "second", "first", "second"]
    for n in ("w_first", "w_second"):
        spark.sql(f"drop table {n}")


def test_failures_name_the_task(spark):
    def bad():
        raise ValueError("no")

    with pytest.raises(TaskError, match="bad: no"):
        run(dag.Pipeline("p", bad), spark)


def test_map_over_a_result(spark):
    p = dag.Pipeline("p", dag.task(lambda: {"items": [1, 2]}, name="lister") >> dag.map_over(dag.task(lambda i: i * 10, name="ten"), "lister.items"))
    assert run(p, spark)["ten"] == [10, 20]


def test_table_store(spark, tmp_path):
    path = str(tmp_path / "state")
    s = TableStore(spark, path)
    s.write_hash("k", "p", "a", "1")
    s.write_hash("k", "p", "a", "2")
    s.write_hash("k", "p", "b", "3")
    s.delete("k", "p", "b")
    s = TableStore(spark, path)
    assert s.read_hash("k", "p", "a") == "2" and s.list_tasks("k", "p") == ["a"]
    s.compact()
    assert TableStore(spark, path).read_hash("k", "p", "a") == "2"


def test_mapped_items_keep_errors(spark):
    def half(x):
        if x % 2:
            raise ValueError("odd")
        return x // 2

    items = relations.indexed(spark.range(4).select(F.col("id").alias("x")), ["x"])
    got = {r.idx: (r.ok, r.result, r.error) for r in mapped.map_items(items, half, ["x"]).collect()}
    assert got == {0: (True, "0", None), 1: (False, None, "ValueError: odd"), 2: (True, "1", None), 3: (False, None, "ValueError: odd")}


def test_lineage_and_previews(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("src")
    found = lineage.column_sources(spark.sql("with c as (select id + 1 as a, name from src) select a, upper(name) as b from c"))
    assert found == {"a": [("src", "id")], "b": [("src", "name")]}
    p = preview.preview(spark.table("src"), 1000, "id = 1; id = 2", ["NAME", "gone"])
    assert p["rows"] == [["x", None]] and p["limit"] == 200
