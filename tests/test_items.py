"""Kept digests, logs of rows, and tasks over the rows of a kept result."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from weft.errors import TaskError
from weft.functions import digests as D
from weft.functions.fingerprint import table_fingerprint
from weft.operators import items, log
from weft.operators.state import MemoryStore, TableStore
from weft.plans import dag
from weft.plans.run import run


def test_log_takes_the_last_row_of_a_key(spark, tmp_path):
    own = log.MergeLog(spark, str(tmp_path / "log"), "k int, v string, deleted boolean", ["k"], merge_at=3)
    assert own.current().collect() == []
    for i in range(8):
        own.append(spark.createDataFrame([(i % 3, f"v{i}", False), (10 + i, "x", False)], "k int, v string, deleted boolean"))
    own.append(spark.createDataFrame([(0, None, True)], "k int, v string, deleted boolean"))
    assert {r.k: r.v for r in own.current().where("k < 10").collect()} == {1: "v7", 2: "v5"}
    assert own.current().count() == 10 and len(os.listdir(tmp_path / "log")) <= 9
    own.append(spark.createDataFrame([(0, "back", False)], "k int, v string, deleted boolean"))
    assert own.current().where("k = 0").first().v == "back"
    own.replace(spark.createDataFrame([(5, "all", False)], "k int, v string, deleted boolean"))
    assert [(r.k, r.v) for r in own.current().collect()] == [(5, "all")]


def test_batches_of_one_run_are_only_read(spark, tmp_path, capsys):
    own = log.MergeLog(spark, str(tmp_path / "log"), "k int, v string, deleted boolean", ["k"])
    assert own.empty()
    put = lambda run, *rows: own.append(spark.createDataFrame([(k, v, v is None) for k, v in rows], "k int, v string, deleted boolean"), run)
    now = lambda: sorted((r.k, r.v) for r in own.current().collect())
    put("a", (1, "x"), (2, "x"))
    put("a", (3, "x"), (4, None))
    own.current().explain()
    assert "Aggregate" not in capsys.readouterr().out and not own.empty()
    assert now() == [(1, "x"), (2, "x"), (3, "x")]
    put("b", (2, "y"))  # another run may have the same keys
    assert now() == [(1, "x"), (2, "y"), (3, "x")]
    put("", (3, None))
    own.merge()
    put("b", (1, "z"))
    assert now() == [(1, "z"), (2, "y")]


def test_a_first_run_needs_no_search_for_last_rows(spark, tmp_path, capsys):
    store = items.Results(spark, str(tmp_path / "r"), "value long")
    rows = spark.range(95).select(F.col("id").alias("idx"), F.col("id").alias("a"))
    items.run_groups(store, rows, lambda a: a, ["a"], {}, "h", bundle=10, group=2, force=True)
    store.values().explain()
    assert "Aggregate" not in capsys.readouterr().out
    fewer = rows.where("idx < 50")
    for _ in range(2):  # forced again, over rows that are there
        items.run_groups(store, fewer, lambda a: a + 1, ["a"], {}, "h", bundle=10, group=2, force=True)
        assert sorted(tuple(r) for r in store.values().collect()) == [(i, i + 1) for i in range(50)]


def test_numbers_of_structs_are_in_the_order_of_structs(spark):
    from weft.operators import relations

    some = [None, (None, None), (None, (1, None)), (None, (None, "b")), (0, None), (0, (None, None)), (0, (2, "a")), (0, (2, "b")), (-1, (9, "z"))]
    df = spark.createDataFrame([(x, k % 3) for k, x in enumerate(some * 3)], "`p.q` struct<a: int, `b c`: struct<d: int, e: string>>, n int").repartition(3)
    got = relations.indexed(df, ["p.q", "n"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(27))
    assert [r[0] for r in got] == [r[0] for r in df.orderBy("`p.q`", "n").collect()]


def test_log_reads_whole_batches_only(spark, tmp_path):
    own = log.MergeLog(spark, str(tmp_path / "log"), "k int, v string", ["k"])
    own.append(spark.createDataFrame([(1, "a")], "k int, v string"))
    reading = own.current()
    own.append(spark.createDataFrame([(1, "b")], "k int, v string"))
    own.merge()
    assert reading.first().v == "a"  # its files are there until the merge after
    part = tmp_path / "log" / "part-99999999999999999999-x"
    spark.createDataFrame([(1, "torn", 1 << 62, 0)], "k int, v string, _seq long, _nth long").write.parquet(str(part))
    (part / "_SUCCESS").unlink()
    assert own.current().first().v == "b"


@pytest.mark.parametrize("parted", [False, True])
def test_digests_of_tables_read_changed_files_only(spark, tmp_path, parted):
    name = f"digested_{int(parted)}"
    kept = D.Digests(spark, str(tmp_path / "digests"))
    writer = spark.range(600).withColumn("s", F.concat(F.lit("a b"), F.col("id") % 3)).repartition(4).write
    (writer.partitionBy("s") if parted else writer).saveAsTable(name)
    assert kept.table(name) == table_fingerprint(spark.table(name)) and kept.read.files_read == kept.read.files > 0
    before = kept.read.files_read, kept.read.bytes_read
    assert kept.table(name) == table_fingerprint(spark.table(name)) and (kept.read.files_read, kept.read.bytes_read) == before
    # a file that is as it was isn't opened: this one has lost its content
    torn = sorted(glob.glob(f"{D.location(spark, name).removeprefix('file:')}/**/*.parquet", recursive=True))[0]
    whole, times = open(torn, "rb").read(), os.stat(torn)
    open(torn, "wb").write(b"x" * len(whole))
    os.utime(torn, ns=(times.st_atime_ns, times.st_mtime_ns))
    spark.sql(f"insert into {name} select 5000, 'zz'")
    now = kept.table(name)
    assert kept.read.files_read == before[0] + 1
    open(torn, "wb").write(whole)
    spark.catalog.refreshTable(name)
    assert now == table_fingerprint(spark.table(name))
    spark.sql(f"drop table {name}")
    spark.range(2).createOrReplaceTempView("digested_view")
    assert kept.table("digested_view") == table_fingerprint(spark.table("digested_view"))


def test_digests_of_folders(spark, tmp_path):
    folder = tmp_path / "fo der"
    (folder / "in").mkdir(parents=True)
    for i in range(20):
        (folder / "in" / f"{i}.txt").write_text(f"text {i}")
    kept = D.Digests(spark, str(tmp_path / "digests"))
    first = kept.folder(str(folder))
    files = spark.createDataFrame(kept.files(str(folder)).select("path", "digest").collect())
    assert kept.read.files_read == 20 and {r.path for r in files.collect()} == {f"in/{i}.txt" for i in range(20)}
    (folder / "in" / "3.txt").write_text("other text")
    (folder / "in" / "5.txt").unlink()
    (folder / "new.txt").write_text("new")
    assert kept.folder(str(folder)) != first and kept.read.files_read == 22
    assert {tuple(r) for r in D.changed(files, kept.files(str(folder))).collect()} == {("in/3.txt", "changed"), ("in/5.txt", "removed"), ("new.txt", "added")}
    assert D.tree(files).where("level = 0").count() == 1 and D.changed(files, files).isEmpty()


def test_runs_read_no_unchanged_output(spark, tmp_path):
    p = dag.Pipeline("p", dag.task(lambda spark: spark.range(50), name="made", outputs=["table://kept_out"]))
    s, kept = MemoryStore(), D.Digests(spark, str(tmp_path / "digests"))
    run(p, spark, s, digests=kept)
    read = kept.read.bytes_read
    assert read > 0 and run(p, spark, s, digests=kept)["log"] == ["[SKIP] made - cached"] and kept.read.bytes_read == read
    assert run(p, spark, s)["log"] == ["[SKIP] made - cached"]  # the fingerprint is that of the rows
    spark.sql("drop table kept_out")


class Counting(TableStore):
    writes = 0

    def write_items(self, key, rows):
        Counting.writes += 1
        super().write_items(key, rows)


def test_ten_thousand_items_take_one_write_and_one_fingerprint(spark, tmp_path, monkeypatch):
    from weft.plans import run as module

    out = tmp_path / "out.txt"
    out.write_text("x")
    prints = []
    real = module.output_fingerprint
    monkeypatch.setattr(module, "output_fingerprint", lambda *a: prints.append(1) or real(*a))
    p = dag.Pipeline("p", dag.task(lambda: list(range(10_000)), name="lister") >> dag.map_over(dag.task(lambda i: i * 2, name="twice", outputs=[str(out)]), "lister"))
    s = Counting(spark, str(tmp_path / "state"))
    assert run(p, spark, s)["twice"][-1] == 19_998 and Counting.writes == 1 and len(prints) == 2  # before and after
    assert run(p, spark, Counting(spark, str(tmp_path / "state")))["log"].count("[RUN] twice[7]") == 0 and len(prints) == 3
    rows = s.item_rows("", "p", "twice")
    assert rows.count() == 10_000 and rows.where("status = 'SUCCESS' and started_at <= ended_at").count() == 10_000


def test_failed_items_of_a_list_are_recorded(spark, tmp_path):
    def odd(i):
        if i % 2:
            raise ValueError("odd")

    s = TableStore(spark, str(tmp_path / "state"))
    with pytest.raises(TaskError, match="odd"):
        run(dag.Pipeline("p", dag.task(lambda: [2, 1], name="lister") >> dag.map_over(dag.task(odd), "lister")), spark, s)
    assert {r["item"]: (r.status, r.error) for r in s.item_rows("", "p", "odd").collect()} == {"2": ("SUCCESS", None), "1": ("FAILURE", "ValueError: odd")}


def rows_pipeline(*first, n=95):
    def lister(spark):
        return spark.range(n).select(F.col("id").alias("idx"), F.struct(F.col("id").alias("a"), (F.col("id") * 10).alias("b")).alias("pair"))

    def add(a, b, plus):
        return a + b + plus

    def total(add):
        return add.agg(F.sum("value").alias("s"), F.count("*").alias("n"))

    made = dag.task(lister, result="pair struct<a: long, b: long>")
    graph = dag.config(plus=lambda: 1)
    for t in (*first, made):
        graph = graph >> t
    return dag.Pipeline("rows", graph >> dag.map_over(dag.task(add, result="value long"), "lister", 10, 2) >> dag.task(total, result="s long, n long"))


def test_results_are_inputs_of_later_tasks(spark, tmp_path):
    place = str(tmp_path / "results")
    done = run(rows_pipeline(), spark, results=place)
    assert tuple(done["total"].first()) == (0, sum(11 * i + 1 for i in range(95)), 95)
    assert [x for x in done["log"] if "GROUP" in x] == [f"[GROUP] add {g}" for g in range(5)]
    assert run(rows_pipeline(), spark, results=place)["log"] == ["[SKIP] lister - cached", "[MAP] add", "[SKIP] total - cached"]
    # a forced lister with the same rows leaves those mapped over it alone
    forced = run(rows_pipeline(dag.task(lambda: 1, name="first", outputs=["table://never"])), spark, results=place)["log"]
    assert "[RUN] lister" in forced and not [x for x in forced if "GROUP" in x]


def test_a_run_goes_on_at_the_first_unfinished_bundle(spark, tmp_path):
    place = str(tmp_path / "results")
    store = items.Results(spark, f"{place}/own", "value long")
    rows = spark.range(95).select(F.col("id").alias("idx"), F.col("id").alias("a"))
    ran = str(tmp_path / "ran")
    os.makedirs(ran)

    def job(a, bad, where):
        open(f"{where}/{a}-{os.getpid()}-{bad}", "w").close()
        if a == bad:
            raise ValueError("bad")
        return a * 2

    with pytest.raises(TaskError, match=r"\[33\]: ValueError: bad"):
        items.run_groups(store, rows, job, ["a"], {"bad": 33, "where": ran}, "h", bundle=10, group=2)
    called = {int(f.split("-")[0]) for f in os.listdir(ran)}
    assert called == set(range(40))  # the third group hasn't begun
    assert {r.bundle: r.status for r in store.bundles().collect()} == {0: "SUCCESS", 1: "SUCCESS", 2: "SUCCESS", 3: "INCOMPLETE"}
    for f in os.listdir(ran):
        os.unlink(f"{ran}/{f}")
    assert items.run_groups(store, rows, job, ["a"], {"bad": -1, "where": ran}, "h", bundle=10, group=2) == [1, 2, 3, 4]
    assert {int(f.split("-")[0]) for f in os.listdir(ran)} == set(range(30, 95))  # bundle 3 as a whole, and what had not run
    assert {r.idx: r.value for r in store.values().collect()} == {i: 2 * i for i in range(95)}
    assert items.run_groups(store, rows, job, ["a"], {"bad": -1, "where": ran}, "h", bundle=10, group=2) == []
    # other items, fewer of them, another fingerprint
    fewer = rows.where("idx < 50").withColumn("a", F.when(F.col("idx") == 5, 500).otherwise(F.col("a")))
    assert items.run_groups(store, fewer, job, ["a"], {"bad": -1, "where": ran}, "h", bundle=10, group=2) == [0]
    assert {r.idx: r.value for r in store.values().collect()} == {i: 1000 if i == 5 else 2 * i for i in range(50)}
    assert items.run_groups(store, fewer, job, ["a"], {"bad": -1, "where": ran}, "h2", bundle=10, group=2) == [0, 1, 2]


@pytest.mark.parametrize(("long", "slots", "jobs"), [(60, 4, 1), (-1, 4, 10), (60, 0, 10), (60, 1, 1)])
def test_small_groups_share_a_job_and_begin_one_after_the_other(spark, tmp_path, monkeypatch, long, slots, jobs):
    monkeypatch.setattr(items, "LONG", long, raising=False)
    monkeypatch.setattr(items, "_slots", lambda *_: slots, raising=False)
    store = items.Results(spark, str(tmp_path / "r"), "value long")
    rows = spark.range(395).select(F.col("id").alias("idx"), F.col("id").alias("a"))
    assert items.run_groups(store, rows, lambda a: a * 2, ["a"], {}, "h", bundle=10, group=4) == list(range(10))
    assert store.log.appends == jobs
    assert sorted(tuple(r) for r in store.values().collect()) == [(i, 2 * i) for i in range(395)]
    times = store.state().groupBy(F.floor(F.col("idx") / 40).alias("grp")).agg(F.min("started_at").alias("a"), F.max("ended_at").alias("b")).orderBy("grp").collect()
    assert len(times) == 10 and all(x.b <= y.a for x, y in zip(times, times[1:], strict=False))


def test_a_failure_in_a_shared_job_ends_it_after_its_group(spark, tmp_path):
    store = items.Results(spark, str(tmp_path / "r"), "value long")
    rows = spark.range(1000).select(F.col("id").alias("idx"), F.col("id").alias("a"))

    def job(a, bad):
        if a in bad:
            raise ValueError("bad")
        return a

    with pytest.raises(TaskError, match=r"^\[333\]: ValueError: bad; \[345\]: ValueError: bad$"):
        items.run_groups(store, rows, job, ["a"], {"bad": {333, 345, 777}}, "h", bundle=10, group=4)
    assert store.log.appends == 1 and store.state().count() == 360  # all of the ninth group, and nothing of the tenth
    assert items.run_groups(store, rows, job, ["a"], {"bad": set()}, "h", bundle=10, group=4) == list(range(8, 25))
    again = store.log.rows().groupBy("bundle", "idx").count().where("count > 1").select("bundle").distinct()
    assert {r.bundle for r in again.collect()} == {33, 34} and store.values().count() == 1000


def test_items_without_rows_and_with_nulls(spark, tmp_path):
    store = items.Results(spark, str(tmp_path / "r"), "x string, y long")
    none = spark.createDataFrame([], "idx long, a string")
    assert items.run_groups(store, none, lambda a: (a, 1), ["a"], {}, "h") == [] and store.values().collect() == []
    rows = spark.createDataFrame([(0, None), (1, "")], "idx long, a string")
    items.run_groups(store, rows, lambda a: {"x": a, "y": 1}, ["a"], {}, "h")
    assert {tuple(r) for r in store.values().collect()} == {(0, None, 1), (1, "", 1)}


def test_items_may_have_any_column_names(spark, tmp_path):
    store = items.Results(spark, str(tmp_path / "r"), "item long, status string, idx2 long")
    rows = spark.range(4).select(F.col("id").alias("idx"), F.col("id").alias("item"), F.lit("b").alias("bundle"), F.lit(1).alias("grp"), F.lit("v").alias("value"))
    items.run_groups(store, rows, lambda item, bundle, grp, value: (item + grp, bundle + value, item), ["item", "bundle", "grp", "value"], {}, "h", bundle=3, group=1)
    assert sorted(tuple(r) for r in store.values().collect()) == [(i, i + 1, "bv", i) for i in range(4)]


# order by peeling


def by_queue(order, edges):
    waits = {n: sum(b == n for _, b in edges) for n in order}
    ready, out, level = [n for n in order if not waits[n]], [], {n: 0 for n in order}
    while ready:
        n = ready.pop(0)
        out.append(n)
        for b in [b for x in order for a, b in edges if a == n and b == x]:
            waits[b] -= 1
            level[b] = max(level[b], level[n] + 1)
            if not waits[b]:
                ready.append(b)
    return [(n, level[n], k) for k, n in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_peeling_is_the_order_of_a_queue(spark, seed):
    import random

    from weft.operators import relations

    rng = random.Random(seed)
    order = rng.sample(range(100, 112), 12)
    edges = [(order[i], order[j]) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.25]
    names = order[:]
    rng.shuffle(names)
    nodes = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "node long, declared long")
    got = [tuple(r) for r in relations.peeled(spark.createDataFrame(edges, "src long, dst long"), nodes).orderBy("position").select("node", "level", "position").collect()]
    assert got == by_queue(names, edges)


def test_peeling_names_cycles_and_unknown_nodes(spark):
    from weft.errors import GraphError
    from weft.operators import relations

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    with pytest.raises(GraphError, match="cycle: b, c, d"):
        relations.peeled(edges)
    nodes = spark.createDataFrame([("a", 1)], "node string, declared int")
    with pytest.raises(GraphError, match="no node"):
        relations.peeled(edges, nodes)
    assert relations.peeled(edges.where("src = 'z'")).collect() == []
    alone = relations.peeled(edges.where("src = 'z'"), nodes).collect()
    assert [tuple(r) for r in alone] == [("a", 0, 0)]
