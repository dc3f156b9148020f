"""Every query against its SQL, and the entry point."""

import ast
import importlib
import sys
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from arraysail import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, con, name):
    assert oracle.difference(core.QUERIES[name](spark, SF), con, core.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_rows_without_sql(spark, name):
    df = core.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "r"] and df.count() == 45
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_text_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("arraysail.llm") else real(n, *a))
    assert set(entry.queries()) == set(core.QUERIES)


def test_nothing_else_imports_the_text_subpackage():
    root = Path(core.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
    assert sys.modules


def test_results_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from arraysail.operators import windows as W

    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id")
    want = None
    for n in (1, 3, 8):
        df = W.folds(e.repartition(n, F.rand(1)), "event_id", 4, seed=1)
        df = W.global_position(df, "ts", "pos", ["event_id"])
        got = sorted(map(tuple, df.select("event_id", "fold", "pos").collect()))
        want = want or got
        assert got == want and [p for _, _, p in sorted(got, key=lambda r: r[2])] == list(range(len(got)))
