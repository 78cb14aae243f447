"""Registered queries with SQL against DuckDB."""

import pytest
from oracle import compare, connect

from fleetlens.llm.queries import CASES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in CASES.items() if sql])
def test_sql(spark, name):
    query, sql = CASES[name]
    assert compare(spark, connect(FOLDER), query, sql, FOLDER) is None
