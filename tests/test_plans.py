"""Shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import changes, query, spread, state
from fleetlens.operators.query import JobFilter, PageRequest
from fleetlens.sources import objects

FOLDER = "/root/testdata/sf0.001"
TEXT = tuple(f"op{n}_" for n in range(1, 11))
RUNS_JOBS = ("s17", "s18", "s20_delete_in", "q1_select_page_deep", "t11", "t9", "pipeline", *TEXT)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch_queries():
    return sorted(n for n in entry.queries() if "stream" not in n and not n.startswith((*RUNS_JOBS, "t7", "t8")))


@pytest.mark.parametrize("name", batch_queries())
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, bad


@pytest.fixture
def jobs(spark, tmp_path):
    schema = "cluster_id STRING, namespace STRING, job_id STRING, job_name STRING, state STRING, start_ts BIGINT, extra STRING"
    path = str(tmp_path / "jobs")
    spark.createDataFrame([("c", "n", "j", "name", "RUNNING", 1, "x")], schema).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan_and_the_page_is_a_top_n(spark, jobs):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    flt = JobFilter(clusters=frozenset([("c", "n")]), states=frozenset(["RUNNING"]), name_contains="a", begin=0, end=9)
    text = plan(query.select_page(jobs, flt, PageRequest(3, 20, (("startTs", "desc"),)))[0])
    assert "TakeOrderedAndProject" in text and "limit=60" in text and "offset=40" in text
    for pushed in ("EqualTo(cluster_id,c)", "EqualTo(state,RUNNING)", "StringContains(job_name,a)",
                   "GreaterThanOrEqual(start_ts,0)", "LessThan(start_ts,9)"):
        assert pushed in text, pushed


def test_envelope_reads_only_filter_columns(jobs):
    text = plan(query.select_page(jobs, JobFilter(states=frozenset(["RUNNING"])), PageRequest())[1])
    assert "ReadSchema: struct<state:string>" in text


def test_latest_combines_before_the_shuffle(jobs):
    text = plan(state.latest_per_key(jobs.select("cluster_id", "job_id", "start_ts"), ["cluster_id"], ["start_ts"]))
    assert "partial_max_by" in text and text.count("Exchange") == 1


def test_changes_shuffle_the_rows_once(jobs):
    text = plan(spread.with_previous(jobs, ["cluster_id"], ["start_ts"], ["state"]))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1 and "SortMergeJoin" not in text


def test_hot_rows_are_read_once_more_at_most(spark, tmp_path):
    spark.range(100).selectExpr("id % 2 AS k", "id AS seq", "'x' AS extra").filter("k = 0 OR seq < 4").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    text = plan(spread.with_previous(df, ["k"], ["seq"], ["extra"], rows=10))
    # ordinary rows from the input, hot rows and the last rows of their slices from the written slices
    assert text.count(f"{tmp_path}/t") == 1
    assert "BroadcastExchange" not in text.replace("BroadcastHashJoin", "") or "HashedRelation" in text


def test_no_size_decides_about_the_plan():
    for name in ("SMALL_BYTES", "HOT_TOP", "PART_ROWS", "GROUP_LIMIT_ROWS", "is_small", "with_parts", "salted_join"):
        assert not hasattr(spread, name)
    assert not hasattr(query, "TOP_N_ROWS")


def test_tail_is_limited_before_the_shuffle(jobs):
    text = plan(changes.tail(jobs, ["cluster_id"], ["start_ts"], 5))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_payload_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "object STRING")
    assert plan(objects.pod_rows(df)[0]).count("from_json(") == 1
    good, _ = objects.service_rows(df)
    assert plan(objects.endpoint_table(good)).count("from_json(") == 1


def test_resets_do_not_gather_a_scope(spark):
    df = spark.createDataFrame([(1, 1, 1, "Added")], "s INT, k INT, seq INT, op STRING")
    text = plan(state.materialize_changelog(df, ["s"], ["k"]))
    # only the pre-aggregated resets and the reduced rows are gathered by scope, in a join that can be split
    assert "SortMergeJoin" in text or "BroadcastHashJoin" in text
    assert "partial_max" in text and "Window" not in text
