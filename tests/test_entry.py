import importlib
import sys
import warnings

import pytest


@pytest.mark.parametrize("gone", ["ahocorasick", "xxhash", "corpus_pipeline", "creditloom.llm"])
def test_other_queries_without_the_text_operators(monkeypatch, gone):
    """A missing library, pipeline or folder leaves out the text operators and nothing else."""
    for name in list(sys.modules):
        if name.startswith("creditloom.llm") or name in ("corpus_pipeline", "__spark_entry__", gone):
            monkeypatch.delitem(sys.modules, name)
    import creditloom

    monkeypatch.delattr(creditloom, "llm", raising=False)
    monkeypatch.setitem(sys.modules, gone, None)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        entry = importlib.import_module("__spark_entry__")
    assert any("left out" in str(w.message) for w in said)
    names = entry.queries()
    assert "rating_distribution" in names and not any(n.startswith("op") for n in names)
    assert set(entry.oracle_sql()) <= set(names)
