import pytest
from pyspark.sql import functions as F

from weft.errors import StateStoreError
from weft.operators.tasks import TaskRows


@pytest.fixture
def rows(spark, tmp_path):
    own = TaskRows(spark, str(tmp_path), "k", "p")
    own.put(spark.createDataFrame([("b", "SUCCESS", "h1"), ("a", None, "h2"), ("c", "FAILURE", "h3")], "task_name string, status string, code_hash string"))
    TaskRows(spark, str(tmp_path), "k", "other").put(spark.createDataFrame([("z", "SUCCESS")], "task_name string, status string"))
    return own


def test_tasks_are_put_read_listed_set_and_deleted(spark, rows):
    assert [r.task_name for r in rows.list().collect()] == ["a", "b", "c"] and rows.get("z") is None and rows.get("b")["code_hash"] == "h1"
    rows.set(spark.createDataFrame([("a", "SUCCESS", None), ("nobody", "SUCCESS", "x")], "task_name string, status string, code_hash string"))
    assert rows.get("a")["status"] == "SUCCESS" and rows.get("a")["code_hash"] is None and rows.get("nobody") is None and rows.get("b")["code_hash"] == "h1"
    rows.put(spark.createDataFrame([("b", "INCOMPLETE")], "task_name string, status string"))
    assert rows.get("b")["status"] == "INCOMPLETE" and rows.get("b")["code_hash"] is None
    with pytest.raises(StateStoreError, match="no column colour"):
        rows.set(spark.createDataFrame([("a", "red")], "task_name string, colour string"))
    rows.create_subtasks(spark.range(3).select(F.lit("a").alias("task_name"), F.col("id").alias("idx"), F.col("id").cast("string").alias("item")))
    assert rows.get("a")["subtask_count"] == 3
    rows.delete(spark.createDataFrame([("a",), ("c",)], "task_name string"))
    assert [r.task_name for r in rows.list().collect()] == ["b"] and rows.subtasks().count() == 0


def test_subtasks_start_and_end_where_they_are(spark, rows):
    n = 1200  # more than two bins of five hundred
    items = spark.range(n).select(F.lit("b").alias("task_name"), F.col("id").alias("idx"), F.concat(F.lit("i"), "id").alias("item"))
    rows.create_subtasks(items)
    rows.started(items.where("idx < 700 or idx = 1199"))
    rows.ended(items.where("idx < 600").withColumn("output_hash", F.concat(F.lit("h"), "idx")))
    rows.ended(spark.createDataFrame([("b", 0, None), ("b", 5000, "x")], "task_name string, idx long, output_hash string"))
    s = rows.subtasks()
    assert (s.count(), s.where("started_at is not null").count(), s.where("ended_at >= started_at").count()) == (n, 701, 600)
    assert s.where("idx = 0").first().output_hash == "h0" and s.where("output_hash = concat('h', idx)").count() == 600
    rows.started(items.where("idx = 3"))
    assert rows.subtasks().where("idx = 3 and ended_at is null and output_hash = 'h3'").count() == 1
    rows.create_subtasks(items.where("idx < 2").withColumn("item", F.lit("new")))
    assert sorted((r.idx, r["item"], r.started_at) for r in rows.subtasks().collect()) == [(0, "new", None), (1, "new", None)] and rows.get("b")["subtask_count"] == 2


def test_decisions(spark, rows):
    rows.set(spark.createDataFrame([("b", "i", "d")], "task_name string, input_hash string, data_hash string").withColumns({"ended_at": F.current_timestamp(), "subtask_count": F.lit(4)}))
    schema = "task_name string, code_hash string, input_hash string, data_hash string, ignore_cache boolean, selected boolean"
    ask = lambda *r: [tuple(x) for x in rows.decisions(spark.createDataFrame([r], schema)).collect()][0]
    assert ask("b", "h1", "i", "d", False, True) == ("b", False, None, None)
    assert ask("b", "h9", "i", "d", False, True) == ("b", True, "Code changed", 4)
    assert ask("b", "h1", "i", "d9", False, True) == ("b", True, "Data changed", 4)
    assert ask("b", "h1", "i", "d", True, True) == ("b", True, "ignore_cache", 4)
    assert ask("b", "h9", "i", "d", False, False) == ("b", False, "Task not selected", None)
    assert ask("new", "h", "i", "d", False, True) == ("new", True, "No cached state", None) and ask("c", "h3", None, None, False, True)[2] == "FAILURE"
