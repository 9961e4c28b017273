"""The entry module, with and without the corpus subpackage."""

import builtins
import sys

import pytest

import __spark_entry__ as entry_module


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "tracewright.llm"])
def test_without_the_corpus_subpackage(monkeypatch, gone):
    real = builtins.__import__

    def blocked(name, globals_=None, locals_=None, fromlist=(), level=0):
        if name.startswith(gone) or f"{name}.{(fromlist or ('',))[0]}".startswith(gone):
            raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)
        return real(name, globals_, locals_, fromlist, level)

    for name in [m for m in sys.modules if m.startswith(("corpus_pipeline", "tracewright.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", blocked)
    names = entry_module.queries()
    assert "episodes" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
