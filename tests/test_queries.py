"""Every registered query runs, and agrees with DuckDB where it has SQL."""

from __future__ import annotations

import pytest

from talkframe.plans import ORACLE_SQL, QUERIES

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_duckdb(spark, small, duck, name):
    assert_same(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    first, again = df.collect(), QUERIES[name](spark, small).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    from .conftest import ROOT

    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_runs(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
