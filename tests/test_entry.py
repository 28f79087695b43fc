"""The entry points without the training-data operators."""

import importlib
import sys

import __spark_entry__ as entry


def test_queries_without_a_library_that_the_operators_need(monkeypatch):
    core = set(importlib.import_module("tidewatch.queries").QUERIES)
    for gone in ("tiktoken", "tidewatch.llm", "corpus_pipeline"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("tidewatch.llm", "corpus_pipeline"))]:
                m.delitem(sys.modules, name)
            m.setattr(sys.modules["tidewatch"], "llm", None, raising=False)
            m.setitem(sys.modules, gone, None)
            assert set(entry.queries()) == core and set(entry.oracle_sql()) <= core
