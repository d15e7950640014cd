import sys

import __spark_entry__
import pytest


def test_a_missing_module_is_a_failure(monkeypatch):
    monkeypatch.delitem(sys.modules, "stationweave.llm.queries", raising=False)
    monkeypatch.delattr("stationweave.llm.queries", raising=False)
    monkeypatch.setitem(sys.modules, "stationweave.llm.splitting", None)
    monkeypatch.delattr("stationweave.llm.splitting", raising=False)
    with pytest.raises(ImportError):
        __spark_entry__.queries()


def test_all_problems_have_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"p{k}_") for n in names) for k in range(1, 11))
