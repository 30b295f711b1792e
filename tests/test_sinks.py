import datetime

import pytest
from pyspark.sql import functions as F

from weft.operators.state import MemoryStore
from weft.plans import dag
from weft.plans.run import run
from weft.sources import sink

WHEN = datetime.datetime(2024, 2, 29, 23, 59, 59, 123456)
ROWS = [(1, "a,b", 1.5, True, WHEN), (2, None, None, None, None), (3, "", -0.25, False, WHEN), (4, 'quote " and\nline', 1e300, True, None), (None, " \\N ", 2.0, False, WHEN)]
SCHEMA = "k long, t string, x double, b boolean, at timestamp"


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_what_is_written_comes_back(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "out")
    sink.put(df, path, kind)
    assert sink.read(spark, path).schema == df.schema and sorted(map(repr, sink.read(spark, path).collect())) == sorted(map(repr, df.collect()))
    sink.put(df.where("false"), path, kind)
    assert sink.read(spark, path).collect() == [] and sink.read(spark, path).schema == df.schema


def test_readers_see_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sink.fingerprint(spark, path) is None
    with pytest.raises(sink.SinkError, match="nothing is published"):
        sink.read(spark, path)
    sink.put(spark.range(3), path)
    before, reading = sink.fingerprint(spark, path), sink.read(spark, path)
    name = sink.write(spark.range(5), path)  # and here the writer stops
    assert sink.read(spark, path).count() == 3 and sink.fingerprint(spark, path) == before
    sink.publish(spark, path, name)
    assert sink.read(spark, path).count() == 5 and sink.fingerprint(spark, path) != before and reading.count() == 3
    sink.put(spark.range(7), path)
    assert len(sink.versions(spark, path)) == sink.KEPT and sink.read(spark, path).count() == 7


def test_a_write_that_differs_is_not_published(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    sink.put(spark.range(3), path)
    real = sink._read
    monkeypatch.setattr(sink, "_read", lambda s, p, a: real(s, p, a).limit(1))
    with pytest.raises(sink.SinkError, match="4 rows were written, 1 are there"):
        sink.put(spark.range(4), path)
    monkeypatch.undo()
    assert sink.read(spark, path).count() == 3
    with pytest.raises(sink.SinkError, match="are not those"):  # in CSV this text is a null
        sink.put(spark.createDataFrame([("\\N", 1)], "t string, k int"), path, "csv")
    assert sink.read(spark, path).count() == 3
    with pytest.raises(ValueError, match="no format"):
        sink.put(spark.range(3), path, "xls")


def test_partitions_and_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.put(spark.range(6).withColumn("p", F.col("id") % 2), path, "csv", ("p",))
    assert sorted(map(tuple, sink.read(spark, path).collect())) == [(i, i % 2) for i in range(6)]
    ran = []

    def made(spark):
        ran.append(1)
        return spark.range(4)

    p, s = dag.Pipeline("p", dag.task(made, outputs=[f"csv://{tmp_path}/made"])), MemoryStore()
    assert run(p, spark, s)["made"].count() == 4
    again = run(p, spark, s)
    assert again["log"] == ["[SKIP] made - cached"] and again["made"].count() == 4 and len(ran) == 1
    sink.put(spark.range(1), f"{tmp_path}/made", "csv")  # by another hand
    assert run(p, spark, s)["log"] == ["[RUN] made"] and len(ran) == 2
