"""What the driver imports, with and without the optional subpackage."""

import builtins
import importlib
import sys

import pytest


@pytest.mark.parametrize("gone", [("corpusmill.llm", "corpus_pipeline"), ("ahocorasick",), ("corpus_pipeline",)])
def test_queries_without_what_cannot_be_imported(monkeypatch, gone):
    real = builtins.__import__

    def fails(name, globals=None, locals=None, fromlist=(), level=0):
        if level == 0 and name.startswith(gone):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for m in [m for m in sys.modules if m.startswith(("corpusmill.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", fails)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert len([n for n in names if n.startswith("q_")]) >= 54 and "pipeline" not in names
    if gone != ("corpus_pipeline",):
        assert not [n for n in names if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(names)
