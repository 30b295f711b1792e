"""Snapshots that share tables."""

import os

import pytest
from pyspark.sql import functions as F

from weft.plans import dag, snapshot
from weft.plans.run import run
from weft.sources import sql


def chain(n, changed=()):
    """Tasks of which each makes a table, and is followed by a checkpoint."""

    def made(k):
        plus = 1 if k in changed else 0
        source = f"lambda spark: spark.range({k + 2}).withColumn('k', __import__('pyspark').sql.functions.lit({k + plus}))"
        return dag.task(eval(source), name=f"t{k}", outputs=[f"table://snap_{k}"], checkpoint=True)

    graph = made(0)
    for k in range(1, n):
        graph = graph >> made(k)
    return dag.Pipeline("chain", graph)


def drop(spark, n):
    for k in range(n):
        spark.sql(f"drop table if exists snap_{k}")


def test_ten_checkpoints_store_a_table_once(spark, tmp_path):
    run(chain(10), spark, checkpoints=str(tmp_path))
    place = snapshot.folder(spark, str(tmp_path), "chain")
    counts = snapshot.references(spark, place)
    assert len(counts) == 10 and sorted(counts.values()) == list(range(1, 11))
    inodes = {name: os.stat(f"{place}/objects/{name}").st_ino for name in counts}
    drop(spark, 10)
    log = run(chain(10), spark, checkpoints=str(tmp_path))["log"]
    assert log[0] == "[RESTORE] t9" and all("SKIP" in line for line in log[1:])
    where = spark.sql("describe formatted snap_3").where("col_name = 'Location'").first().data_type
    assert "/objects/" in where and spark.table("snap_3").count() == 5  # in its place, not a copy
    assert {name: os.stat(f"{place}/objects/{name}").st_ino for name in snapshot.references(spark, place)} == inodes
    drop(spark, 10)
    assert spark.read.parquet(f"{place}/objects/{max(counts, key=counts.get)}").count() == 2  # dropping a table leaves the snapshot's rows


def test_rows_that_no_manifest_names_go(spark, tmp_path):
    place = snapshot.folder(spark, str(tmp_path), "chain")
    run(chain(3), spark, checkpoints=str(tmp_path))
    before = set(snapshot.references(spark, place))
    spark.sql("drop table snap_1")
    run(chain(3, changed={1}), spark, checkpoints=str(tmp_path), force=True)
    after = snapshot.references(spark, place)
    assert len(after) == 3 and len(before & set(after)) == 2 and all(after.values())
    drop(spark, 3)


def test_statements_leave_a_snapshots_rows_alone(spark, tmp_path):
    run(chain(2), spark, checkpoints=str(tmp_path))
    drop(spark, 2)
    assert run(chain(2), spark, checkpoints=str(tmp_path))["log"][0] == "[RESTORE] t1"
    sql.run_text(spark, "insert into snap_0 select 77, 77; delete from snap_1 where id = 0")
    assert spark.table("snap_0").count() == 3 and spark.table("snap_1").count() == 2
    drop(spark, 2)
    assert run(chain(2), spark, checkpoints=str(tmp_path))["log"][0] == "[RESTORE] t1" and spark.table("snap_0").count() == 2
    # rows that were added otherwise are noticed: such a snapshot is out of date
    spark.range(1).withColumn("k", F.lit(9)).write.insertInto("snap_0")
    drop(spark, 2)
    assert run(chain(2), spark, checkpoints=str(tmp_path))["log"][0] == "[RUN] t0"
    drop(spark, 2)


@pytest.mark.parametrize("broken", ["_SUCCESS", None])
def test_torn_snapshots_are_none(spark, tmp_path, broken):
    run(chain(2), spark, checkpoints=str(tmp_path))
    place = snapshot.folder(spark, str(tmp_path), "chain")
    name = next(k for k, n in snapshot.references(spark, place).items() if n == 2)
    if broken:
        os.unlink(f"{place}/objects/{name}/{broken}")
    else:
        snapshot.delete(spark, f"{place}/objects/{name}")
    drop(spark, 2)
    assert run(chain(2), spark, checkpoints=str(tmp_path))["log"][0] == "[RUN] t0"
    drop(spark, 2)
