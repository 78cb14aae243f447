"""Metric keys by versions, the long form, and objects that are asked for one by one."""

import pytest

from fleetlens.operators import metrics as M
from fleetlens.sources import storage_check
from fleetlens.streaming import metric_registry, runs

ROWS = "k INT, metrics MAP<STRING,STRING>"


def test_long_form_of_any_keys(rows):
    df = rows(ROWS, (1, {"a": "5", "b.c": "2.5"}), (2, {"a": "x", "d": None}), (3, {}), (4, None))
    got = {(r.k, r.raw_key): (r.field_name, r.field_type, r.long_value, r.double_value) for r in M.type_metrics(df).collect()}
    assert got == {(1, "a"): ("a", "bigint", 5, None), (1, "b.c"): ("bc", "double", None, 2.5), (2, "a"): ("a", "bigint", None, None),
                   (2, "d"): ("d", "bigint", None, None)}
    typed = M.type_metrics_long(M.long_metrics(df), rows("raw_key STRING, field_type STRING", ("a", "double")))
    assert {r.k: r.double_value for r in typed.collect() if r.raw_key == "a"} == {1: 5.0, 2: None}


def test_versions_of_a_registry(spark, rows):
    empty = spark.createDataFrame([], M.REGISTRY)
    first = M.new_metric_keys(rows("raw_key STRING, value STRING", ("a", "1"), ("b", "1.5"), ("a", "2"), (None, "1"), ("n", None)), empty, 0)
    show = lambda df: sorted((r.raw_key, r.field_type, r.version) for r in df.collect())
    assert show(first) == [("a", "bigint", 0), ("b", "double", 0), ("n", "bigint", 0)]
    more = M.new_metric_keys(rows("raw_key STRING, value STRING", ("a", "1.0"), ("b", "7"), ("c.d", "1"), ("n", "3")), first, 1)
    assert show(more) == [("a", "double", 1), ("c.d", "bigint", 1)]
    both = first.unionByName(more)
    assert M.new_metric_keys(rows("raw_key STRING, value STRING", ("a", "1"), ("a", "2.5")), both, 2).count() == 0
    assert M.registered_spec(both, 0) == [("a", "a", "bigint"), ("b", "b", "double"), ("n", "n", "bigint")]
    assert M.registered_spec(both) == [("a", "a", "double"), ("b", "b", "double"), ("c.d", "cd", "bigint"), ("n", "n", "bigint")]
    clash = both.unionByName(rows(M.REGISTRY, ("c_d", "cd", "bigint", 2)))
    with pytest.raises(ValueError, match="cd"):
        M.registered_spec(clash)
    assert len(M.registered_spec(clash, 1)) == 4


@pytest.mark.parametrize("every", [1, 50])
def test_stream_of_metrics(spark, rows, tmp_path, monkeypatch, every):
    monkeypatch.setattr(runs, "COMPACT_EVERY", every)  # with 1, each batch but the first is merged on both levels
    landed = str(tmp_path / "landed")
    for batch in ([(1, {"a": "1", "b": "1"})], [(2, {"a": "2.5"}), (3, None)], [(4, {"c": "x"})]):
        rows(ROWS, *batch).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(landed)
    _, view, registry = metric_registry.stream_metrics(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    got = {(r.k, r.raw_key): (r.long_value, r.double_value) for r in view().collect()}
    assert got == {(1, "a"): (None, 1.0), (1, "b"): (1, None), (2, "a"): (None, 2.5), (4, "c"): (None, None)}
    assert {(r.k, r.raw_key): r.long_value for r in view(0).collect()}[(1, "a")] == 1
    assert registry().count() == 4
    wide = M.type_metrics(spark.read.schema(ROWS).parquet(landed), M.registered_spec(registry()))
    assert wide.columns == ["k", "a", "b", "c"]
    assert sorted(tuple(r) for r in wide.collect())[0] == (1, 1.0, 1, None)


def test_catalogue_columns_are_told_apart():
    for spec, n in ((M.JOB_METRICS, 20), (M.COORDINATOR_METRICS, 30), (M.WORKER_METRICS, 35)):
        assert len({name for _, name, _ in spec}) == n
    names = {raw: name for raw, name, _ in M.WORKER_METRICS}
    assert names["Status.JVM.GarbageCollector.G1_Old_Generation.Count"] == "jvmGarbageCollectorG1OldGenerationCount"
    assert names["Status.JVM.CPU.Load"] == "jvmCpuLoad"
    assert names["Status.Network.TotalMemorySegments"] == "NetworkTotalMemorySegments"


def test_objects_are_asked_for_one_by_one(rows, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.jar").write_text("1")
    (tmp_path / "a" / "b" / "ä y.jar").write_text("1")
    paths = ["/a/x.jar", "a/x.jar", "a/b/ä y.jar", "a/x", "a", "A/x.jar", "a/b/../x.jar", "a//x.jar", "./a/x.jar", "a/x.jar/", "", None]
    refs = rows("path STRING, exists_ INT", *[(p, i) for i, p in enumerate(paths)] * 2)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = storage_check.check_objects(refs, root, tasks=2).collect()
        assert len(found) == 2 * len(paths)
        assert {r.path for r in found if r.exists} == {"/a/x.jar", "a/x.jar", "a/b/ä y.jar"}
    assert storage_check.check_objects(refs.limit(0), str(tmp_path)).count() == 0
    assert storage_check._uri("s3a://lake/x") == "s3://lake/x" and storage_check._uri("hdfs://h/x") == "hdfs://h/x"
