"""Column rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.functions import config as G
from fleetlens.functions import keys as K
from fleetlens.functions import paths as P
from fleetlens.functions import quantity as Q
from fleetlens.operators import metrics as M


def apply(rows, col, values, dtype="STRING"):
    """Values of a column rule for each input value, in order."""
    df = rows(f"i INT, x {dtype}", *[(i, v) for i, v in enumerate(values)])
    return [r.y for r in df.select("i", col(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_quantity(rows):
    got = apply(rows, Q.parse_quantity, ["100m", "233Ki", "233Gi", "233", " 5 M", "1.5", "x", "", None])
    plain = [None if q is None else (q["value"], q["unit"]) for q in got]
    assert plain == [(100, "m"), (233, "Ki"), (233, "Gi"), (233, "k"), (5, "M"), (1.5, "k"), (None, "k"), (None, "k"), None]


CONVERSIONS = [
    (1000.0, "m", "u", 1000 * 1000), (1000.0, "u", "m", 1), (1.0, "Gi", "Ki", 1024 * 1024), (1024.0, "Ki", "Mi", 1),
    (1024.0 * 1024, "Ki", "Gi", 1), (1000.0, "k", "k", 1000), (1000.0, "Ki", "Ki", 1000), (1.024, "Ki", "k", 1),
    (1.024, "Gi", "G", 1), (1.024, "Mi", "M", 1), (1.024, "Ki", "m", 1000), (1.024, "Gi", "k", 1000 * 1000),
    (1.0, "k", "Ki", 1.024), (1.0, "G", "Gi", 1.024), (1.0, "M", "Mi", 1.024), (1.5, "k", "Mi", 1536),
]


def test_convert_quantity(rows):
    df = rows("v DOUBLE, u STRING, t STRING, want DOUBLE", *[(a, b, c, float(d)) for a, b, c, d in CONVERSIONS])
    q = F.struct(F.col("v").alias("value"), F.col("u").alias("unit"))
    for r in df.select("*", Q.convert_quantity(q, F.col("t")).alias("got")).collect():
        assert r.got == pytest.approx(r.want, rel=1e-12), r


def test_convert_quantity_exact(rows):
    df = rows("v DOUBLE, u STRING, t STRING", (1.0, "Ki", "k"), (1.0, "k", "m"), (1.0, "Gi", "M"), (1.0, "E", "Ei"))
    q = F.struct(F.col("v").alias("value"), F.col("u").alias("unit"))
    got = [r.x for r in df.select(Q.convert_quantity(q, F.col("t"), "exact").alias("x")).collect()]
    assert got == pytest.approx([1.024, 1e6, 1073.741824, 1e18 / 2**60])
    with pytest.raises(ValueError):
        Q.convert_quantity(q, "k", "other")


def test_show_quantity(rows):
    assert apply(rows, lambda c: Q.show_quantity(Q.parse_quantity(c)), ["1.5Gi", "2"]) == ["1.5Gi", "2.0k"]


def test_pure_path(rows):
    values = ["s3://bucket/xx/xx.jar", "s3:///bucket/xx/xx.jar", "/bucket/xx/xx.jar", "", "s3://", None]
    assert apply(rows, P.pure_path, values) == ["bucket/xx/xx.jar"] * 3 + ["", "s3", None]


def test_strip_leading_slash(rows):
    assert apply(rows, P.strip_leading_slash, ["/xx/xx.jar", "xx/xx.jar", "", "//a"]) == ["xx/xx.jar", "xx/xx.jar", "", "/a"]


def test_file_name(rows):
    assert apply(rows, P.file_name, ["x/y.jar", "x/y/", "y", "", "s3://b/c//"]) == ["y.jar", "y", "y", "", "c"]


def test_is_object_store_path(rows):
    values = ["s3://bucket/xx.jar", "s3:///bucket/xx.jar", "s3a://b/x", "s3n://b/x", "s3p://b/x", "hdfs://xx/xx.jar",
              "/xx/xx.jar", "file:///xx/xx.jar", "", " s3 ://x", "s3"]
    assert apply(rows, P.is_object_store_path, values) == [True] * 5 + [False] * 4 + [True, True]


def test_rewrite_scheme(rows):
    values = ["s3://b1/file", "s3p://b1/file", "s3a://b1/file", "file:///b1/file", "/b1/file", "s3://", "s3://a://b"]
    want = ["s3p://b1/file"] * 3 + ["file:///b1/file", "/b1/file", "s3://", "s3p://a"]
    assert apply(rows, P.rewrite_scheme, values) == want


def test_revise_bucket(rows):
    values = ["s3://b1/test/file", "s3://test/file", "plain", "s3://b1"]
    path = apply(rows, lambda c: P.revise_bucket(c, "b1"), values)
    assert path == ["s3://b1/test/file", "s3://b1/test/file", "plain", "s3://b1"]
    host = apply(rows, lambda c: P.revise_bucket(c, "b1", P.VIRTUAL_HOSTED_STYLE), values)
    assert host == ["s3://test/file", "s3://test/file", "plain", "s3://"]
    with pytest.raises(ValueError):
        P.revise_bucket(F.col("x"), "b1", "other")


def test_object_name(rows):
    values = ["s3://b1/a/b", "s3://c/a", "b1"]
    assert apply(rows, lambda c: P.object_name(c, "b1"), values) == ["a/b", "c/a", ""]
    assert apply(rows, lambda c: P.object_name(c, "b1", P.VIRTUAL_HOSTED_STYLE), values) == ["b1/a/b", "c/a", "b1"]


def test_clamps(rows):
    assert apply(rows, lambda c: C.clamp_min(c, 10), [5, 10, 15, None], "INT") == [10, 10, 15, None]
    for low, want in ((5, 10), (10, 0), (15, 0)):
        assert apply(rows, lambda c, low=low: C.or_default(c, lambda v: v > low, 0), [10], "INT") == [want]
    assert apply(rows, lambda c: C.or_default(c, lambda v: v > 5.0, 0.0), [10.0, None], "DOUBLE") == [10.0, None]


def test_enums(rows):
    names = ["A", "B", "C"]
    assert apply(rows, lambda c: C.enum_ordinal(c, names), ["A", "C", "x", None], "STRING") == [0, 2, None, None]
    assert apply(rows, lambda c: C.decode_enum(c, names), ["A", "a", None]) == ["A", None, None]
    assert apply(rows, lambda c: C.decode_enum(c, names, "default", "Z"), ["A", "a", None]) == ["A", "Z", "Z"]
    assert apply(rows, lambda c: C.decode_enum(c, names, "error"), ["A", None]) == ["A", None]
    with pytest.raises(Exception, match="unknown name: a"):
        apply(rows, lambda c: C.decode_enum(c, names, "error"), ["a"])


def test_text_rules(rows):
    assert apply(rows, C.safe_trim, [" a ", None, ""]) == ["a", "", ""]
    got = apply(rows, C.drop_blank, [[" a", "", None, "  ", "b "], [], None], "ARRAY<STRING>")
    assert got == [["a", "b"], [], None]


def test_durations(rows):
    df = rows("start_ts BIGINT, end_ts BIGINT", (10, -1), (10, 15))
    assert [r.duration for r in C.job_durations(df, 100).collect()] == [90, 90]
    assert [r.duration for r in C.job_durations(df, 100, stop_at_end=True).collect()] == [90, 5]


def test_min_severity(rows):
    df = rows("level STRING", ("TRACE",), ("WARNING",), ("FATAL",), ("odd",), (None,))
    assert {r.level for r in C.min_severity(df, "INFO").collect()} == {"WARNING", "FATAL"}
    with pytest.raises(ValueError):
        C.min_severity(df, "LOUD")


def test_keys(rows):
    df = rows("cluster_id STRING, namespace STRING", ("c1", "n1"), ("c1", None))
    got = K.key_rows(df, "jobOv").orderBy("namespace").collect()
    assert [(r.key, r.cluster_id_part, r.namespace_part) for r in got] == [(None, None, None), ("jobOv@c1@n1", "c1", "n1")]
    assert K.under_cluster(df, "c1", "n1").count() == 1


def test_exec_mode(rows):
    configs = [{"exec.mode": "kubernetes-application", "execution.target": "remote"}, {"execution.target": "embedded"},
               {"execution.target": "remote"}, {"execution.target": "kubernetes-session"}, {"exec.mode": "bad"}, {}, None]
    want = ["kubernetes-application", "kubernetes-application", "kubernetes-session", "kubernetes-session", "Unknown",
            "Unknown", "Unknown"]
    assert apply(rows, G.infer_exec_mode, configs, "MAP<STRING,STRING>") == want
    managed = apply(rows, lambda c: G.is_managed(c, "a", "b"), [{"a": "b"}, {"a": "c"}, {}, None], "MAP<STRING,STRING>")
    assert managed == [True, False, False, False]


def test_versions(rows):
    assert apply(rows, G.major_version, ["1.15.2", "1.16", "2", "1.", ""]) == ["1.15", "1.16", "2", "1.", ""]
    assert apply(rows, lambda c: G.full_version(c, "2.12"), ["1.15.2"]) == ["1.15.2-scala_2.12"]


def test_config_maps(rows):
    forbid = lambda c: G.remove_forbidden(c)
    got = apply(rows, forbid, [{" a ": " 1 ", "a": "2", "pipeline.jars": "x", " ": "y", "b": " "}], "MAP<STRING,STRING>")
    assert got[0] in ({"a": "1"}, {"a": "2"})
    df = rows("a MAP<STRING,STRING>, b MAP<STRING,STRING>", ({"x": "1", "y": "2"}, {"y": "3", "z": None}), (None, None))
    merged = [r.m for r in df.select(G.merge_config(F.col("a"), F.col("b")).alias("m")).collect()]
    assert merged == [{"x": "1", "y": "3", "z": None}, {}]
    shown = apply(rows, G.redact, [{"s3.secret-key": "x", "a": "1", "s3.secret-keys": "2"}], "MAP<STRING,STRING>")
    assert [(e["key"], e["value"]) for e in shown[0]] == [("a", "1"), ("s3.secret-key", "***"), ("s3.secret-keys", "2")]


def test_last_entry_wins(rows):
    df = rows("e ARRAY<STRUCT<key: STRING, value: STRING>>", ([("a", "1"), ("b", "2"), ("a", "3")],), ([],), (None,))
    assert [r.m for r in df.select(G.last_entries_map(F.col("e")).alias("m")).collect()] == [{"a": "3", "b": "2"}, {}, None]


def test_config_entries_of_a_bare_definition(rows):
    df = rows("cluster_id STRING, namespace STRING", ("c1", "n1"))
    got = {r.key: r.value for r in G.config_entries(df).collect()}
    assert got == {"kubernetes.cluster-id": "c1", "kubernetes.namespace": "n1", "blob.server.port": "6124",
                   "kubernetes.jobmanager.service-account": "default", "taskmanager.rpc.port": "6122"}


def test_object_store_of_definitions(rows):
    df = rows("cluster_id STRING, deps ARRAY<STRING>, job_jar STRING", ("a", ["/x", "s3://b/x"], None),
              ("b", [], "hdfs://x"), ("c", None, "s3p://b/j.jar"), ("d", None, None))
    got = {r.cluster_id: r.needs_object_store for r in G.needs_object_store(df).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_metric_names():
    assert len(M.JOB_METRICS) == 20 and len(M.COORDINATOR_METRICS) == 30 and len(M.WORKER_METRICS) == 35
    names = {raw: name for raw, name, _ in M.WORKER_METRICS}
    assert names["Status.JVM.GarbageCollector.G1_Old_Generation.Count"] == "jvmGarbageCollectorG1OldGenerationCount"
    assert names["Status.JVM.CPU.Load"] == "jvmCpuLoad"
    assert names["Status.Flink.Memory.Managed.Total"] == "FlinkMemoryManagedTotal"
    assert [t for _, _, t in M.COORDINATOR_METRICS].count("double") == 2
    assert [t for _, _, t in M.WORKER_METRICS].count("double") == 1


def test_metric_name_columns_agree(rows):
    keys = [raw for raw, _, _ in M.COORDINATOR_METRICS + M.WORKER_METRICS + M.JOB_METRICS]
    assert apply(rows, M.field_name, keys) == [M.field_name(k) for k in keys]


def test_metrics_strict_and_bad(rows):
    df = rows("metrics MAP<STRING,STRING>", ({"uptime": "5"},), ({"uptime": "x"},), ({"uptime": None},), ({},))
    spec = [s for s in M.JOB_METRICS if s[0] == "uptime"]
    assert [r.uptime for r in M.project_metrics(df, spec).collect()] == [5, None, None, None]
    assert df.filter(M.bad_metric_values(df, spec)).count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        M.project_metrics(df, spec, strict=True).collect()


def test_infer_metric_schema(rows):
    df = rows("id STRING, value STRING", ("a.b_c", "1"), ("a.b_c", "1.5"), ("Status.JVM.CPU.Time", "3"), ("n", None))
    got = [(r.raw_key, r.field_name, r.field_type) for r in M.infer_metric_schema(df).collect()]
    assert got == [("a.b_c", "abc", "double"), ("Status.JVM.CPU.Time", "jvmCpuTime", "bigint"), ("n", "n", "bigint")]
