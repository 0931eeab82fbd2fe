import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpusmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpusmill.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(e)
        assert "chunk_code" in bare.queries() and not any(k.startswith("op") or k == "pipeline" for k in bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)
