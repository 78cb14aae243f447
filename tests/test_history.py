"""History tables that are merged as they grow, and routing of workload objects."""

import json

from pyspark.sql import functions as F

from fleetlens.sources import objects, tables

JOBS = "cluster_id STRING, namespace STRING, job_id STRING, state STRING, ts BIGINT"


def _history(spark, path):
    return tables.history_table(spark, str(path), JOBS)


def _jobs(spark, poll, n=40):
    return spark.range(n).select(
        F.lit("c").alias("cluster_id"), F.lit("ns").alias("namespace"), F.format_string("j%05d", F.col("id") * 2).alias("job_id"),
        F.lit(f"S{poll}").alias("state"), F.lit(poll * 50_000_000).cast("bigint").alias("ts"))


def _deltas(path, kind):
    return sorted(int(p.name.split("=")[1]) for p in (path / kind).glob(f"{tables.BATCH}=*"))


def test_folds_keep_every_row_and_write_older_rows_once(spark, tmp_path):
    table = _history(spark, tmp_path)
    for poll in range(8):
        tables.write_history(_jobs(spark, poll), table, poll)
        if poll in (2, 5):
            tables.fold_history(table, poll)
    assert table.read().count() == 8 * 40
    assert _deltas(tmp_path, "fold1") == [2, 5]
    # what the first fold merged went with the second one
    assert _deltas(tmp_path, "delta") == [3, 4, 5, 6, 7]
    tables.fold_history(table, 5)
    tables.write_history(_jobs(spark, 5), table, 5)  # a repeated batch
    assert table.read().count() == 8 * 40
    tables.fold_history(table, 5, level=2)
    tables.fold_history(table, 7)
    assert _deltas(tmp_path, "fold2") == [5] and _deltas(tmp_path, "fold1") == [2, 5, 7]
    assert table.read().count() == 8 * 40
    tables.fold_history(table, 7, level=2)
    assert _deltas(tmp_path, "fold1") == [7]
    assert table.read().count() == 8 * 40
    last = tables.history_of(table.read(), "c", "ns", "j00004").collect()
    assert [r.state for r in last] == [f"S{p}" for p in range(7, -1, -1)]


def test_fold_of_repeated_and_missing_batches(spark, tmp_path):
    table = _history(spark, tmp_path)
    tables.fold_history(table, 3)
    assert table.read().count() == 0
    tables.write_history(_jobs(spark, 1).unionByName(_jobs(spark, 1)), table, 1)
    tables.write_history(_jobs(spark, 1), table, 4)
    tables.fold_history(table, 9)
    assert table.read().count() == 40
    assert _deltas(tmp_path, "fold1") == [4]


def test_search_for_a_job_skips_row_groups(spark, tmp_path):
    table = _history(spark, tmp_path)
    tables.write_history(_jobs(spark, 0, 20_000), table, 0)

    def scanned(job):
        rows = table._scan("delta", [0]).filter((F.col("job_id") == job) & (F.col("cluster_id") == "c"))
        assert "EqualTo(job_id," in rows._jdf.queryExecution().executedPlan().toString()
        plan = rows._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert scanned("j00004") == 20_000
    # between two jobs that are there, so that minima and maxima alone tell nothing
    assert scanned("j00005") == 0


def _object(kind, i, spec, status=None, name=True, labels=None):
    meta = {"namespace": "n", "creationTimestamp": "2024-01-01T00:00:10Z", "labels": labels or {}}
    body = {"metadata": meta | ({"name": f"{kind}{i}"} if name else {}), "spec": spec} | ({"status": status} if status else {})
    return (kind, i, json.dumps(body))


def test_all_kinds_in_one_pass_equal_their_own_readers(spark, rows, tmp_path):
    labels = {"app": "a", "component": "jobmanager"}
    port = {"name": "rest", "protocol": "TCP", "port": 8081, "targetPort": "8081"}
    status = {"phase": "Running", "containerStatuses": [{"name": "m", "ready": True, "state": {"running": {}}}]}
    spec = {"containers": [{"name": "m", "resources": {"limits": {"cpu": "2"}}}]}
    data = [
        _object("service", 1, {"selector": labels, "ports": [port]}),
        _object("service", 2, {"selector": {}, "ports": [port]}),
        _object("deployment", 3, {"selector": {"matchLabels": labels}}, {"replicas": 2}),
        _object("deployment", 4, {"selector": {"matchLabels": labels}}),
        _object("pod", 5, spec, status, labels=labels),
        _object("pod", 6, spec, status, labels=labels, name=False),
        ("pod", 7, "no json"), ("pod", 8, None), ("configmap", 9, "{}"), (None, 10, "{}"),
    ]
    held = rows("kind STRING, seq INT, object STRING", *data)
    held.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    text = objects.route_workloads(table)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
    assert text.count("from_json") == 3
    readers = {"deployment": objects.deployment_rows, "service": objects.service_rows, "pod": objects.pod_rows}
    got = objects.workload_rows(table, str(tmp_path / "out"))
    assert set(got) == set(readers)
    for kind, read in readers.items():
        for mine, own in zip(got[kind], read(held.filter(F.col("kind") == kind))):
            assert sorted(mine.columns) == sorted(own.columns)
            show = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
            assert show(mine) == show(own)
            assert f"{tmp_path}/in" not in mine._jdf.queryExecution().executedPlan().toString()
    assert [got[k][1].count() for k in ("deployment", "service", "pod")] == [1, 1, 3]
    empty = objects.workload_rows(table.limit(0), str(tmp_path / "none"))
    assert all(side.count() == 0 for pair in empty.values() for side in pair)


def test_polls_with_the_same_jobs_are_left_out(spark, rows, tmp_path):
    from fleetlens.streaming import runs

    jobs = lambda *ids: json.dumps({"jobs": [{"jid": i, "name": "n", "state": "RUNNING"} for i in ids]})
    schema = "cluster_id STRING, namespace STRING, payload STRING, ts BIGINT, extra INT"
    batches = [
        [("c", "n", jobs("a", "b"), 1, 0), ("c", "n", jobs("b", "a"), 2, 0), ("c", "n", jobs("a"), 5, 0)],
        [("c", "n", jobs("a"), 3, 0), ("c", "n", "{broken", 4, 0), ("c", "n", None, 6, 0), (None, "n", jobs("x"), 1, 0)],
        [("c", "n", jobs(), 7, 0), ("c", "n", jobs("a"), 8, 0), ("c", "n", jobs("a"), 8, 0), ("d", "n", "{}", 1, 0)],
    ]
    for batch in batches:
        rows(schema, *batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _, view, _ = runs.ingest_changed_overviews(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    # the late poll 3 takes the place of poll 5, and after poll 7 without jobs poll 8 is a change
    assert sorted((r.ts, r.job_id) for r in view().collect()) == [(1, "a"), (1, "b"), (3, "a"), (8, "a")]
