"""The driver's contract, with and without the training-data subpackage."""

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_nothing_imports_training_data():
    for f in (ROOT / "millrace").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            module = getattr(node, "module", None) or ""
            assert "llm" not in module.split(".") and not any("llm" in n.split(".") for n in names), f


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "key", "score_sparse", "score_dense", "fusion", "rank"] and df.count() > 0
