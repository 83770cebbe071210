"""Every registered query of the library against its SQL, and the properties that SQL can't show."""

from __future__ import annotations

import pytest

from oracle import duck, duck_rows, spark_rows
from tessella import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(name, spark, sf, con):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    assert sql, f"{name} has no SQL; test it on its own"
    columns, rows = duck_rows(con, sql)
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_id", "venue_name", "city", "confidence", "rank", "start_day"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert found.returncode == 0 and int(found.stdout) >= len(NAMES), found.stderr
