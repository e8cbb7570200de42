"""The package of training-data operators stands apart, and the entry point works without it."""

import importlib
import pathlib
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_package():
    for f in (ROOT / "tmloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "tmloom.llm" not in f.read_text() and "import llm" not in f.read_text(), f


def test_entry_without_the_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tmloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tmloom.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "tm_exact_lookup" in entry.queries() and not any(q.startswith("p7_") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["id", "part", "kind", "ref_id", "score", "rank"] and df.count() > 0
