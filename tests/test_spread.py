"""Splitting of hot groups against plain brute force; small limits make every key hot."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.operators import changes, joins, query, spread, state, watch
from fleetlens.operators.aggregates import key_counts, keys_by_cluster
from fleetlens.operators.query import PageRequest

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
EVENTS = st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, 3, None]), st.integers(0, 3)), min_size=1, max_size=60)


def frame(spark, data, shuffle=True):
    table = [(k, i, v) for i, (k, v) in enumerate(data)]
    if shuffle:
        random.Random(0).shuffle(table)
    return spark.createDataFrame(table, "k INT, seq BIGINT, v INT")


def brute_changes(data):
    last, out = {}, set()
    for i, (k, v) in enumerate(data):
        if k not in last or last[k] != v:
            out.add((k, i, v))
        last[k] = v
    return out


@FEW
@given(EVENTS)
@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_only_changes(spark, rows, data):
    got = changes.only_changes(frame(spark, data), ["k"], ["seq"], ["v"], rows=rows)
    assert {tuple(r) for r in got.collect()} == brute_changes(data)


def test_only_changes_with_gaps_nulls_and_times(spark):
    table = [("a", 0, None), ("a", 1, None), ("a", 900, 1), ("a", 901, 1), ("a", 100_000, None), ("b", 5, 2)]
    df = spark.createDataFrame(table, "k STRING, sec BIGINT, v INT").withColumn("at", F.timestamp_seconds("sec"))
    got = changes.only_changes(df, ["k"], ["at", "sec"], ["v"], rows=2)
    assert {(r.k, r.sec) for r in got.collect()} == {("a", 0), ("a", 900), ("a", 100_000), ("b", 5)}


def cut(df, keys, order, rows):
    return spread.cut(df, keys, order, rows, spread.hot_keys(df, keys, rows))


@pytest.mark.parametrize("far", [[], [0], [0, 10**12]])
def test_slices_stay_small_with_far_off_values(spark, far):
    data = [(1, v) for v in far] + [(1, 10**9 + i) for i in range(4000)] + [(2, i) for i in range(5)]
    df = spark.createDataFrame(data, "k INT, seq BIGINT")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    rows = cut(df, ["k"], ["seq"], 200).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r._slice] += 1
    assert len(rows) == len(data) - 5 and len(sizes) >= 15 and max(sizes.values()) <= 600
    ordered = [r._slice for r in sorted(rows, key=lambda r: r.seq)]
    assert ordered == sorted(ordered)


def test_rows_that_tie_in_the_first_order_column_are_split(spark):
    df = spark.range(3000).selectExpr("1 AS k", "7 AS seq", "id AS then", "id % 3 AS v")
    assert len({r._slice for r in cut(df, ["k"], ["seq"], 100).collect()}) > 1
    got = changes.only_changes(df, ["k"], ["seq", "then"], ["v"], rows=100)
    assert got.count() == 3000
    same = changes.only_changes(df.withColumn("v", F.lit(1)), ["k"], ["seq", "then"], ["v"], rows=100)
    assert [r.then for r in same.collect()] == [0]


def test_many_rows_of_one_key_in_a_small_file_are_split(spark, tmp_path):
    spark.range(20_000).selectExpr("1 AS k", "id AS seq").write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    hot = spread.hot_keys(df, ["k"], 10_000).collect()
    assert [(r._hot_k, r._rows) for r in hot] == [(1, 20_000)]
    assert "_slice" in plan(spread.with_previous(df, ["k"], ["seq"], ["seq"], rows=10_000))
    assert "_slice" not in plan(spread.with_previous(df, ["k"], ["seq"], ["seq"], rows=30_000))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_operators_on_far_off_values(spark):
    rnd = random.Random(4)
    seqs = sorted([0, 5, 10**12, *rnd.sample(range(10**9, 10**9 + 10**6), 1500)])
    data = [(1, seq, rnd.randint(0, 2)) for seq in seqs] + [(2, 1, 1), (2, 2, 1)]
    df = spark.createDataFrame(data, "k INT, seq BIGINT, v INT").repartition(5)
    by_key = {k: [r for r in data if r[0] == k] for k in (1, 2)}
    want = {r for rows in by_key.values() for i, r in enumerate(rows) if i == 0 or rows[i - 1][2] != r[2]}
    got = changes.only_changes(df, ["k"], ["seq"], ["v"], rows=100)
    assert {tuple(r) for r in got.select("k", "seq", "v").collect()} == want
    got = changes.tail(df, ["k"], ["seq"], 150, rows=100)
    assert {r.seq for r in got.filter("k = 1").collect()} == set(seqs[-150:])
    got = spread.with_rank(df, ["k"], ["seq"], "n", rows=100)
    assert [r.n for r in got.filter("k = 1").orderBy("seq").collect()] == list(range(1, len(seqs) + 1))


@pytest.mark.parametrize("rows", [2, None])
def test_text_order_columns(spark, rows):
    table = [("a", f"{i:03}", i // 3) for i in range(30)] + [("b", None, 1), ("b", "x", 1)]
    df = spark.createDataFrame(table, "k STRING, at STRING, v INT").repartition(3)
    got = changes.only_changes(df, ["k"], ["at"], ["v"], rows=rows)
    assert {(r.k, r["at"]) for r in got.collect()} == {("a", f"{i:03}") for i in range(0, 30, 3)} | {("b", None)}


@FEW
@given(EVENTS)
@pytest.mark.parametrize("rows", [3, None])
def test_rank(spark, rows, data):
    count, want = defaultdict(int), set()
    for i, (k, _) in enumerate(data):
        count[k] += 1
        want.add((k, i, count[k]))
    got = spread.with_rank(frame(spark, data), ["k"], ["seq"], "n", rows=rows)
    assert {(r.k, r.seq, r.n) for r in got.collect()} == want


@FEW
@given(EVENTS, st.integers(1, 5))
@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_tail(spark, rows, data, n):
    by_key = defaultdict(list)
    for i, (k, v) in enumerate(data):
        by_key[k].append((k, i, v))
    want = {r for all_rows in by_key.values() for r in all_rows[-n:]}
    got = changes.tail(frame(spark, data), ["k"], ["seq"], n, rows=rows)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    big = frame(spark, [(random.Random(i).choice([1, 1, 1, 2, 3, None]), i) for i in range(200)])
    small = spark.createDataFrame([(1, "x"), (3, "y"), (4, "z"), (None, "n")], "k INT, name STRING")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    want = sorted(map(key, big.join(small, "k", how).collect()))
    columns = big.join(small, "k", how).columns
    for rows in (10, 50, None):
        got = spread.spread_join(big, small, ["k"], ["seq"], how, rows=rows)
        assert sorted(map(key, got.select(*columns).collect())) == want


def test_keys_and_counts_are_rows(spark):
    data = [("big", i % 50) for i in range(100)] + [("small", 1), (None, 3), ("none", None)]
    df = spark.createDataFrame(data, "cluster_id STRING, job_id INT").withColumn("namespace", F.lit("n"))
    got = [(r.cluster_id, r.job_id) for r in keys_by_cluster(df).collect()]
    assert len(got) == len(set(got)) and set(got) == set(data)
    assert {r.cluster_id: r["keys"] for r in key_counts(df).collect()} == {"big": 50, "small": 1, None: 1, "none": 0}


def test_snapshot_rows(spark):
    data = [("c", "pod", f"p{i}") for i in range(30)] + [("c", "service", "s"), ("d", "other", "x"), ("e", "config_map", "m")]
    df = spark.createDataFrame(data, "cluster_id STRING, kind STRING, name STRING")
    got = {tuple(r) for r in joins.assemble_snapshot(df, ["cluster_id"]).collect()}
    assert got == {r for r in data if r[1] != "other"}
    assert {tuple(r) for r in joins.snapshot_counts(df, ["cluster_id"]).collect()} == {("c", 0, 1, 30, 0), ("e", 0, 0, 0, 1)}
    pods = df.filter("kind = 'pod'").select("cluster_id", "name", F.lit(1).alias("ready"))
    full = joins.full_snapshot({"pod": pods, "service": pods.limit(1).select("cluster_id", "name")}, ["cluster_id"])
    assert {(r.kind, r.detail) for r in full.collect()} == {("pod", '{"ready":1}'), ("service", "{}")}


@pytest.mark.parametrize("number,size", [(1, 7), (4, 10), (7, 10), (8, 10), (3, 30)])
def test_deep_page_equals_page(spark, number, size):
    data = [(f"c{i % 3}", "n", i, f"job-{i % 5}", "RUNNING", i % 4) for i in range(70)]
    df = spark.createDataFrame(
        data, "cluster_id STRING, namespace STRING, job_id INT, job_name STRING, state STRING, start_ts INT")
    orders = query.order_columns((("startTs", "desc"), ("jobName", "asc")))
    req = PageRequest(number, size)
    want = [r.job_id for r in query.page(df, req, orders).collect()]
    assert [r.job_id for r in query.page(df, req, orders, top_n=0).collect()] == want


def test_pages_with_null_and_repeated_keys_are_slices_of_one_order(spark):
    data = [(f"c{i % 3}", None if i % 2 else "n", i % 40, "job", "RUNNING", i % 4, i) for i in range(400)]
    df = spark.createDataFrame(
        data, "cluster_id STRING, namespace STRING, job_id INT, job_name STRING, state STRING, start_ts INT, row INT")
    orders = query.order_columns((("startTs", "desc"), ("jobName", "asc")))
    places = {r.row: r.place for r in query.with_place(df, orders).collect()}
    assert sorted(places.values()) == list(range(1, 401))
    for number in (1, 9, 10, 11, 16, 17):
        for top_n in (0, 250, 1000):
            got = query.page(df, PageRequest(number, 25), orders, top_n=top_n).collect()
            first = (number - 1) * 25
            assert [places[r.row] for r in got] == list(range(first + 1, min(first + 25, 400) + 1))
            size = query.page_envelope(df, PageRequest(number, 25)).first()["size"]
            assert len(got) == size


def test_watch_with_hot_operations(spark):
    data = [("a", 0, "start"), ("a", 5, "done"), ("a", 3, "done"), ("b", 10, "start"), ("b", 200, "done"),
            ("c", 180, "start"), ("d", 1, "done"), ("a", -1, "done")]
    df = spark.createDataFrame(data, "k STRING, at BIGINT, kind STRING")
    for rows in (1, 100):
        got = watch.watch_until_complete(
            df, ["k"], "at", F.col("kind") == "start", F.col("kind") == "done", 50, rows=rows)
        assert {(r.k, r.completed_ts, r.status) for r in got.collect()} == {
            ("a", 3, "COMPLETED"), ("b", None, "WATCH_TIMEOUT"), ("c", None, "IN_PROGRESS")}


OPS = st.lists(st.tuples(st.sampled_from(["s", "t"]), st.integers(1, 3),
                         st.sampled_from(["Added", "Modified", "Deleted", "Reseted"])), min_size=1, max_size=40)


def brute_changelog(ops):
    live = {}
    for seq, (scope, k, op) in enumerate(ops):
        if op == "Reseted":
            live = {key: v for key, v in live.items() if key[0] != scope}
        elif op == "Deleted":
            live.pop((scope, k), None)
        else:
            live[scope, k] = seq
    return {(*key, seq) for key, seq in live.items()}


@FEW
@given(OPS)
def test_changelog(spark, ops):
    table = [(s, k, i, op) for i, (s, k, op) in enumerate(ops)]
    random.Random(1).shuffle(table)
    df = spark.createDataFrame(table, "scope STRING, k INT, seq BIGINT, op STRING")
    got = state.materialize_changelog(df, ["scope"], ["k"])
    assert {(r.scope, r.k, r.seq) for r in got.collect()} == brute_changelog(ops)
    # reducing any prefix first changes nothing
    cut = len(ops) // 2
    early = state.reduce_changelog(df.filter(F.col("seq") < cut), ["scope"], ["k"])
    both = early.unionByName(state.reduce_changelog(df.filter(F.col("seq") >= cut), ["scope"], ["k"]))
    again = state.materialize_changelog(both, ["scope"], ["k"])
    assert {(r.scope, r.k, r.seq) for r in again.collect()} == brute_changelog(ops)


def brute_reconcile(polls):
    """Poll by poll: prune keys that are not listed, then put the records."""
    held = {}
    for seq, listed, records in polls:
        held = {k: v for k, v in held.items() if k in listed}
        held.update(dict.fromkeys(records & listed, seq))
    return held


@FEW
@given(st.lists(st.tuples(st.sets(st.integers(1, 4)), st.sets(st.integers(1, 4))), min_size=1, max_size=8))
def test_reconcile_and_upsert(spark, polls):
    polls = [(i, listed, records & listed) for i, (listed, records) in enumerate(polls)]
    listings = [("s", k, i) for i, listed, _ in polls for k in (listed or {None})]
    records = [("s", k, i) for i, _, recs in polls for k in recs]
    make = lambda data: spark.createDataFrame(data, "scope STRING, k INT, seq BIGINT")
    for rows in (2, None):
        got = state.reconcile_and_upsert(make(listings), make(records), ["scope"], ["k"], rows=rows)
        assert {r.k: r.seq for r in got.collect()} == brute_reconcile(polls)
