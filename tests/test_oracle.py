"""Every registered query with SQL against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from fleetlens.plans import load_cases
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
# the small scale has no rows for these
MAY_BE_EMPTY = {"f1_select_jobs"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    err = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert err is None or (err == "no rows" and name in MAY_BE_EMPTY), err


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster_id", "namespace", "job_id", "job_name", "state", "start_ts"]
    assert df.count() > 0


def test_all_queries_of_the_library_have_sql():
    assert [name for name, (_, sql) in load_cases().items() if sql is None] == []
