import pytest

from weft.errors import HashError
from weft.functions import fingerprint as fp
from weft.plans import dag, run


def test_columns_and_rows_beyond_a_bound_are_refused(spark):
    rows = spark.range(100)
    assert fp.column_digests(rows, 1000).count() == 1 and len(fp.row_fingerprint(rows, 3200)) == 32
    with pytest.raises(HashError, match="id"):
        fp.column_digests(rows, 200)
    with pytest.raises(HashError, match="100 rows"):
        fp.row_fingerprint(rows, 3199)


def test_tasks_whose_outputs_cannot_be_hashed_are_planned_to_run(spark, monkeypatch):
    def fail(*_):
        raise HashError("no")

    p = dag.Pipeline("p", dag.task(lambda: 1, name="a", outputs=["table://a"]))
    monkeypatch.setattr(run, "fingerprint", fail)
    assert run.plan(p, spark) == [("RUN", "a")]


def test_code_fingerprints_follow_classes(tmp_path, monkeypatch):
    import importlib
    import sys

    source = """
class Base:
    def far(self):
        return {far}

class Own(Base):
    '''{doc}'''
    @property
    def near(self):
        return helper() + {near}

def helper():
    return {help}

def task():
    return Own().near
"""

    def of(n, **parts):
        place = tmp_path / str(n)
        place.mkdir()
        (place / "fpkg.py").write_text(source.format(**({"far": 1, "near": 2, "help": 3, "doc": "x"} | parts)))
        sys.modules.pop("fpkg", None)
        with monkeypatch.context() as m:
            m.syspath_prepend(str(place))
            return fp.code_fingerprint(importlib.import_module("fpkg").task)

    first = of(0)
    assert of(1, doc="y") == first and len({first, of(2, far=9), of(3, near=9), of(4, help=9)}) == 4
    sys.modules.pop("fpkg")


def test_events_are_rows(spark):
    log = ["[RUN] a", "[SKIP] b - cached", "[GROUP] c 3", "[RUN] d[1]"]
    assert [tuple(r) for r in run.events(spark, log).orderBy("nth").collect()] == [(0, "RUN", "a", None), (1, "SKIP", "b", "cached"), (2, "GROUP", "c 3", None), (3, "RUN", "d[1]", None)]
