import importlib
import sys

import __spark_entry__ as entry


def test_every_query_is_callable_and_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60 and all(map(callable, entry.queries().values()))


def test_library_stands_without_its_subpackages_for_training_data(monkeypatch):
    monkeypatch.setitem(sys.modules, "weftmill.llm", None)
    again = importlib.reload(entry)
    try:
        assert "p3_found" in again.queries() and "p1_found" not in again.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
