import importlib
import sys

import __spark_entry__ as e


def test_queries_without_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("weft.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "weft.llm", None)
    alone = importlib.reload(e)
    assert "pipeline" not in alone.queries() and "map_status" in alone.queries()
    monkeypatch.undo()
    importlib.reload(e)


def test_entry(spark):
    assert e.entry(spark).count() > 0
