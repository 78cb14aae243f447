"""Edge cases of state, queries, joins and payloads."""

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import aggregates, changes, joins, query, state, usage
from fleetlens.operators.query import JobFilter, PageRequest
from fleetlens.sources import objects, payloads, storage_check, tables


def test_add_wins_a_tie(rows):
    ops = rows("k INT, seq INT, op STRING", (1, 1, "add"), (1, 1, "remove"), (2, 1, "add"), (2, 2, "remove"), (3, 5, "add"))
    assert {r.k for r in state.live_members(ops, ["k"], ["seq"]).collect()} == {1, 3}
    cleared = ops.unionByName(rows("k INT, seq INT, op STRING", (None, 4, "clear")))
    assert {r.k for r in state.live_members(cleared, ["k"], ["seq"]).collect()} == {3}


def test_set_sequence(rows):
    ops = [("add", 1), ("add", 2), ("add", 3), ("remove", 1)]
    df = rows("op STRING, k INT, seq INT", *[(op, k, i) for i, (op, k) in enumerate(ops)])
    members = state.live_members(df, ["k"], ["seq"])
    assert state.size(members, ["k"]).first()[0] == 2
    wanted = rows("k INT", (1,), (2,))
    assert {(r.k, r.contained) for r in state.contains(members, wanted, ["k"]).collect()} == {(1, False), (2, True)}


def test_latest_per_key_with_null_key(rows):
    df = rows("k INT, ts INT, seq INT, v STRING", (None, 1, 1, "a"), (None, 1, 2, "b"), (1, 2, 1, "c"), (1, 1, 9, "d"))
    assert {(r.k, r.v) for r in state.latest_per_key(df, ["k"], ["ts", "seq"]).collect()} == {(None, "b"), (1, "c")}


def test_update_and_upsert(rows):
    held = rows("k INT, v INT", (1, 10), (2, None))
    new = rows("k INT, v INT", (2, 5), (3, 7))
    got = state.update_existing(held, new, ["k"], {"v": F.col("new.v")})
    assert {tuple(r) for r in got.collect()} == {(1, 10), (2, 5)}
    got = state.upsert(held, new, ["k"], {"v": F.lit(0)}, {"v": F.coalesce("v", F.lit(0)) + F.col("new.v")})
    assert {tuple(r) for r in got.collect()} == {(1, 10), (2, 5), (3, 0)}
    with pytest.raises(ValueError):
        state.state_update(held, ["k"], {"k": F.lit(1)})


def test_snapshot_diff_nulls(rows):
    old = rows("k INT, v INT, ts INT", (1, None, 1), (2, 2, 1), (3, 3, 1))
    new = rows("k INT, v INT, ts INT", (1, None, 2), (2, None, 2), (4, 4, 2))
    got = {(r.k, r.change) for r in state.snapshot_diff(old, new, ["k"], ["v"]).collect()}
    assert got == {(1, "same"), (2, "changed"), (3, "removed"), (4, "added")}


def test_remove_where_keeps_null(rows):
    df = rows("v INT", (1,), (2,), (None,))
    assert {r.v for r in query.remove_where(df, F.col("v") == 1).collect()} == {2, None}


def test_gate_restart(rows):
    tracking = rows("c INT, seq INT, op STRING", (1, 0, "Start"), (1, 5, "Stop"), (1, 8, "Start"), (1, 9, "Start"), (2, 0, "Start"),
                    (2, 7, "Stop"), (3, 3, "Start"))
    data = rows("c INT, seq INT", (1, 2), (1, 6), (1, 8), (1, 20), (2, 3), (2, 9), (3, 1), (3, 4), (4, 1))
    got = state.gate_by_tracking(data, tracking, ["c"], "seq")
    assert {tuple(r) for r in got.collect()} == {(1, 8), (1, 20), (3, 4)}


def test_usage_of_recreated_pod(rows):
    pods = rows("s INT, k INT, seq INT, op STRING", (1, 1, 0, "Added"), (1, 1, 5, "Deleted"), (1, 1, 7, "Added"), (1, 2, 1, "Added"),
                (2, 3, 1, "Added"), (2, None, 4, "Reseted"), (2, 3, 6, "Modified"))
    used = rows("s INT, k INT, seq INT, cpu INT", (1, 1, 4, 1), (1, 2, 2, 2), (2, 3, 3, 3))
    got = usage.usage_by_live_pods(pods, used, ["s"], ["k"])
    assert {r.k for r in got.collect()} == {2}
    later = used.unionByName(rows("s INT, k INT, seq INT, cpu INT", (1, 1, 8, 9), (2, 3, 7, 9)))
    assert {r.k for r in usage.usage_by_live_pods(pods, later, ["s"], ["k"]).collect()} == {1, 2, 3}


def test_fingerprint_is_order_free_and_ignores_copies(rows):
    df = rows("g INT, v STRING", (1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a"))
    got = {r.g: (r.hash1, r.hash2, r.members) for r in changes.set_fingerprint(df, ["g"], ["v"]).collect()}
    assert got[1] == got[2] != got[3]


def test_first_errors_ignore_successes(rows):
    df = rows("k INT, seq INT, err STRING", (1, 1, "x"), (1, 2, None), (1, 3, "x"), (1, 4, "y"), (1, 5, "x"))
    got = changes.first_of_error_runs(df, ["k"], ["seq"], F.col("err").isNotNull(), "err")
    assert {r.seq for r in got.collect()} == {1, 4, 5}


JOBS = "cluster_id STRING, namespace STRING, job_id STRING, job_name STRING, state STRING, start_ts BIGINT"


def sample(rows):
    return rows(JOBS, ("c1", "n", "a", "my_job", "RUNNING", 1), ("c1", "n", "b", "my%job", "FAILED", 2), ("c2", "n", "c", "myjob", "INITIALIZING", 2),
                ("c2", "m", "d", "other", "odd", None))


def ids(df):
    return [r.job_id for r in df.collect()]


def test_empty_filter_set_means_no_filter(rows):
    df = sample(rows)
    assert len(ids(query.select_jobs(df, JobFilter(clusters=frozenset(), states=frozenset())))) == 4
    assert query.in_set(["job_id"], set()) is not None and df.filter(query.in_set(["job_id"], set())).count() == 4


def test_filters(rows):
    df = sample(rows)
    assert ids(query.select_jobs(df, JobFilter(name_contains="y_j"))) == ["a"]
    assert ids(query.select_jobs(df, JobFilter(name_contains="%"))) == ["b"]
    assert ids(query.select_jobs(df, JobFilter(clusters=frozenset([("c2", "m"), ("c1", "m")])))) == ["d"]
    assert ids(query.select_jobs(df, JobFilter(begin=1, end=2))) == ["a"]
    assert ids(query.select_jobs(df, JobFilter(end=3, job_ids=frozenset(["b", "c", "d"])))) == ["b", "c"]


def test_sorting(rows):
    df = sample(rows)
    assert ids(query.sort_by(df, (("jobState", "asc"),))) == ["d", "c", "a", "b"]
    assert ids(query.sort_by(df, (("startTs", "desc"), ("jobName", "asc")))) == ["b", "c", "a", "d"]
    assert ids(query.list_all(df)) == ["a", "b", "d", "c"]
    with pytest.raises(ValueError):
        query.sort_by(df, (("startTs", "down"),))


def test_pages(rows):
    df = sample(rows)
    page = lambda n, size: query.select_page(df, JobFilter(), PageRequest(n, size))
    assert ids(page(2, 3)[0]) == ["c"] and ids(page(9, 3)[0]) == []
    assert tuple(page(2, 3)[1].first()) == (4, 2, 1, 2, 3, False, True)
    assert tuple(page(0, 0)[1].first()) == (4, 1, 4, 1, 10, False, False)
    assert tuple(page(9, 3)[1].first()) == (4, 2, 0, 9, 3, False, True)
    assert PageRequest(1, 5).is_head and PageRequest(3, 5).offset == 10


def test_quarantine(rows):
    df = rows("a INT, b INT", (1, 1), (None, 1), (None, None))
    good, bad = query.quarantine(df, {"a": F.col("a").isNotNull(), "b": F.col("b") > 0})
    assert good.count() == 1
    assert sorted(tuple(r.broken_rules) for r in bad.collect()) == [("a",), ("a", "b")]


def test_lookup(rows):
    wanted, cache, source = rows("k INT", (1,), (2,), (3,)), rows("k INT, v STRING", (1, "c1")), rows("k INT, v STRING", (1, "s1"), (2, "s2"))
    got = joins.lookup_with_fallback(wanted, cache, source, ["k"], ["v"])
    assert {(r.k, r.v, r.found_in) for r in got.collect()} == {(1, "c1", "cache"), (2, "s2", "source"), (3, None, None)}
    direct = joins.lookup_with_fallback(wanted, cache, source, ["k"], ["v"], directly=True)
    assert {(r.k, r.v) for r in direct.collect()} == {(1, "s1"), (2, "s2"), (3, None)}
    with pytest.raises(Exception, match="not found"):
        joins.require_found(got).collect()


def test_duplicate_spec_last_wins(rows):
    status = rows("pod INT, container STRING", (1, "a"), (1, "b"))
    spec = rows("pod INT, container STRING, position INT, cpu_limit STRING", (1, "a", 0, "1"), (1, "a", 1, "2"))
    got = joins.with_container_resources(status, spec, cols=("cpu_limit",))
    assert {(r.container, r.cpu_limit) for r in got.collect()} == {("a", "2"), ("b", None)}


def test_random_member_is_repeatable(rows):
    df = rows("g INT, k INT", *[(i % 3, i) for i in range(30)])
    pick = lambda seed: {tuple(r) for r in aggregates.random_member(df, ["g"], "k", seed).collect()}
    assert pick(1) == pick(1) and len({frozenset(pick(s)) for s in range(8)}) > 1
    assert all(k % 3 == g for g, k in pick(5))
    assert aggregates.random_member(df.limit(0), ["g"], "k", 1).count() == 0


def test_payload_edges(rows):
    df = rows("cluster_id STRING, namespace STRING, payload STRING, ts INT", ("a", "n", '{"jobs":[]}', 1), ("b", "n", "{bad", 1), ("c", "n", None, 1),
              ("d", "n", '{"jobs":[{"jid":"1","name":"x","start-time":5,"tasks":{"running":2}}]}', 1))
    got = payloads.payload_job_overview(df).collect()
    assert [(r.cluster_id, r.job_id, r.state, r.start_ts, r.tasks.running, r.tasks.failed) for r in got] == [("d", "1", None, 5, 2, None)]
    assert [r.cluster_id for r in payloads.unreadable(df, schemas.JOB_OVERVIEW).collect()] == ["b"]


def test_metric_payload_edges(rows):
    df = rows("k INT, payload STRING, ts INT", (1, '[{"id":"a","value":"1"},{"id":"a","value":"2"},{"id":"b"}]', 0), (2, "[]", 0))
    got = {r.k: r.metrics for r in payloads.payload_metrics(df, ["k"]).collect()}
    assert got == {1: {"a": "2", "b": None}, 2: {}}


def test_op_status_edges(rows):
    df = rows("k INT, payload STRING", (1, '{"status":{"id":"COMPLETED"},"operation":{}}'), (2, '{"status":{"id":"IN_PROGRESS"}}'),
              (3, '{"status":{"id":"COMPLETED"},"operation":{"failure-cause":{"stack-trace":"boom"}}}'), (4, '{"status":{"id":"odd"}}'))
    got = {r.k: (r.state, r.failure_cause) for r in payloads.payload_op_status(df, ["k"]).collect()}
    assert got == {1: ("COMPLETED", None), 2: ("IN_PROGRESS", None), 3: ("COMPLETED", "boom"), 4: (None, None)}
    with pytest.raises(Exception, match="unknown name: odd"):
        payloads.payload_op_status(df, ["k"], on_miss="error").collect()


def test_snapshot_with_map_column(rows):
    df = rows("s INT, batch_seq INT, m MAP<STRING,STRING>", (1, 1, {"a": "1"}), (1, 2, {"b": "2"}), (1, 2, None), (2, 1, {}))
    got = state.replace_snapshot(df, ["s"])
    assert sorted((r.s, r.batch_seq, str(r.m)) for r in got.collect()) == [(1, 2, "None"), (1, 2, "{'b': '2'}"), (2, 1, "{}")]


def test_service_with_text_port_is_rejected(rows):
    base = '{"metadata":{"name":"a-rest","namespace":"n","creationTimestamp":"2024-01-01T00:00:00Z"},"spec":{"clusterIP":"ip",' \
           '"selector":{"app":"c","component":"x"},"ports":[%s]}}'
    good_port = '{"name":"rest","protocol":"TCP","port":8081,"targetPort":8081}'
    df = rows("object STRING", (base % good_port,), (base % '{"name":"rest","protocol":"TCP","port":1,"targetPort":"http"}',),
              (base % f'{{"name":"x","port":1}},{good_port},{good_port}',), ("{}",))
    good, bad = objects.service_rows(df)
    assert [[tuple(p) for p in r.ports] for r in good.collect()] == [[("rest", "TCP", 8081, 8081)]] * 2
    assert sorted(len(r.broken_rules) for r in bad.collect()) == [1, 5]
    assert objects.endpoint_table(good).first().url == "http://a-rest.n:8081"
    assert objects.endpoint_urls(objects.endpoint_from_service(good), "cluster_ip").first().url == "http://ip:8081"


def test_check_paths_wants_exact_names(spark, rows, tmp_path):
    (tmp_path / "a" / "b" / "a").mkdir(parents=True)
    (tmp_path / "a" / "x.jar").write_text("1")
    (tmp_path / "a" / "b" / "a" / "y.jar").write_text("1")
    files = storage_check.list_files(spark, str(tmp_path))
    assert {r.object for r in files.collect()} == {"a/x.jar", "a/b/a/y.jar"}
    below = storage_check.list_files(spark, f"file://{tmp_path}/a/")
    assert {r.object for r in below.collect()} == {"x.jar", "b/a/y.jar"}
    refs = rows("path STRING", ("/a/x.jar",), ("a/x",), ("a",), ("A/x.jar",))
    assert {r.path for r in storage_check.check_paths(refs, files).filter("exists").collect()} == {"/a/x.jar"}


def test_deletes_in_current_table(spark, rows, tmp_path):
    table = tables.BatchTable(spark, str(tmp_path), "k INT, v STRING, ts BIGINT, deleted BOOLEAN")
    put = lambda batch, *data: tables.write_current(rows("k INT, v STRING, ts BIGINT", *data), table, batch, ["k"])
    put(0, (1, "a", 1), (2, "b", 1))
    tables.write_deletes(rows("k INT, ts BIGINT", (1, 2), (9, 2)), table, 1, ["k"])
    read = lambda: {(r.k, r.v) for r in tables.read_current(table, ["k"]).collect()}
    assert read() == {(2, "b")}
    put(2, (1, "late", 1), (2, "c", 3))
    assert read() == {(2, "c")}
    tables.compact_current(table, 1, ["k"])
    assert read() == {(2, "c")}
    put(3, (1, "again", 5))
    assert read() == {(1, "again"), (2, "c")}
    assert table.read(before=1).count() == 2


def test_uncommitted_batches_are_not_read(spark, rows, tmp_path):
    table = tables.BatchTable(spark, str(tmp_path), "k INT")
    assert table.read().count() == 0
    table.write(rows("k INT", (1,)), 0)
    table.write(rows("k INT", (2,)), 1)
    (tmp_path / "delta" / f"{tables.BATCH}=1" / "_SUCCESS").unlink()
    assert [r.k for r in table.read().collect()] == [1]


def test_a_column_named_batch_is_kept(spark, rows, tmp_path):
    table = tables.BatchTable(spark, str(tmp_path), "batch INT, day STRING")
    table.write(rows("batch INT, day STRING", (7, "x")), 0)
    table.write(rows("batch INT, day STRING", (8, "y")), 1)
    assert sorted(tuple(r) for r in table.read().collect()) == [(7, "x"), (8, "y")]


def test_log_of_the_main_container(rows):
    from fleetlens.sources.logs import read_log_lines

    lines = rows("pod STRING, container STRING, line INT", ("p", "flink-main-container", 1), ("p", "side", 2),
                 ("p", "flink-main-container", 3), ("p", None, 4), ("q", "side", 1))
    got = lambda **options: sorted((r.pod, r.line) for r in read_log_lines(lines, tail=1, **options).collect())
    assert got() == [("p", 3)]
    assert got(container="side") == [("p", 2), ("q", 1)]
    assert got(container=None) == [("p", 4), ("q", 1)]
    assert read_log_lines(lines.drop("container"), tail=2).count() == 3
