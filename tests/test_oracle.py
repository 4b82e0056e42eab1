"""Every query with a SQL twin gives the twin's rows on the small tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from check import duck, rows_of  # noqa: E402
from tests_data import SMALL  # noqa: E402

from tallyglass.plans import load_all  # noqa: E402

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    c = duck(SMALL)
    assert isinstance(c, duckdb.DuckDBPyConnection)
    return c


@pytest.mark.parametrize("key", [k for k, q in REGISTRY.items() if q.sql])
def test_same_rows(key, t, con):
    df = REGISTRY[key].build(t)
    cur = con.execute(REGISTRY[key].sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry_and_contract(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_test_imports_conftest():
    """The name conftest resolves to whichever of several files pytest met last."""
    import ast
    import pathlib
    for path in pathlib.Path(__file__).parent.rglob("test_*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert "conftest" not in names, path
