"""Streams over several micro-batches give what the batch operators give over all rows."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import aggregates, changes, state, watch
from fleetlens.operators.usage import usage_by_live_pods
from fleetlens.sources import logs, objects, payloads, tables
from fleetlens.streaming import runs

SCHEMA = "scope INT, k INT, seq BIGINT, op STRING, v INT"


def events(n=120, seed=3):
    rnd = random.Random(seed)
    ops = ["Added", "Modified", "Modified", "Deleted"]
    rows = []
    for i in range(n):
        k = rnd.choice([1, 1, 1, 2, 3, 4, 5])
        reset = rnd.random() < 0.05
        rows.append((k % 2, None if reset else k, i, "Reseted" if reset else rnd.choice(ops), rnd.randint(0, 2)))
    return rows


class Source:
    """A folder that gets one JSON file per micro-batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0
        folder.mkdir()

    def add(self, *batches, schema=SCHEMA):
        for rows in batches:
            lines = [r[0] for r in self.spark.createDataFrame(rows, schema).select(F.to_json(F.struct("*"))).collect()]
            (self.folder / f"{self.files:05d}.json").write_text("\n".join(lines) + "\n")
            self.files += 1

    def stream(self, schema=SCHEMA):
        return payloads.read_payloads(
            self.spark, str(self.folder), schema, stream=True, maxFilesPerTrigger=1, latestFirst="false")


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path / "in")


@pytest.fixture
def dirs(tmp_path):
    return str(tmp_path / "table"), str(tmp_path / "checkpoint")


def cut(rows, n=4):
    size = -(-len(rows) // n)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def same(a, b):
    norm = lambda df: sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert norm(a) == norm(b) and norm(a)


def test_changelog_with_restart(spark, source, dirs):
    rows = events()
    first, *rest = cut(rows)
    source.add(first)
    runs.stream_changelog(source.stream(), *dirs, ["scope"], ["k"])
    source.add(*rest)
    _, view = runs.stream_changelog(source.stream(), *dirs, ["scope"], ["k"])
    same(view(), state.materialize_changelog(spark.createDataFrame(rows, SCHEMA), ["scope"], ["k"]))


def test_changelog_with_late_rows(spark, source, dirs):
    rows = events()
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    source.add(*cut(shuffled))
    _, view = runs.stream_changelog(source.stream(), *dirs, ["scope"], ["k"])
    same(view(), state.materialize_changelog(spark.createDataFrame(rows, SCHEMA), ["scope"], ["k"]))


def test_latest_and_repeated_batch(spark, source, dirs):
    rows = [r for r in events() if r[1] is not None]
    source.add(*cut(rows))
    _, view = runs.stream_latest(source.stream(), *dirs, ["k"], ["seq"])
    want = state.latest_per_key(spark.createDataFrame(rows, SCHEMA), ["k"], ["seq"])
    same(view(), want)
    # the last micro-batch runs once more, as after a crash before its commit
    table = tables.BatchTable(spark, dirs[0], SCHEMA)
    table.write(state.latest_per_key(spark.createDataFrame(cut(rows)[-1], SCHEMA), ["k"], ["seq"]), 3)
    same(view(), want)
    table.compact(2, lambda df: state.latest_per_key(df, ["k"], ["seq"]))
    same(view(), want)


@pytest.mark.parametrize("scope", [(), ("scope",)])
def test_members(spark, source, dirs, scope):
    names = {"Added": "add", "Modified": "add", "Deleted": "remove", "Reseted": "clear"}
    rows = [(s, k, seq, names[op], v) for s, k, seq, op, v in events()]
    source.add(*cut(rows))
    keys = [*scope, "k"]
    _, view = runs.stream_members(source.stream(), *dirs, keys, ["seq"], scope=scope)
    same(view(), state.live_members(spark.createDataFrame(rows, SCHEMA), keys, ["seq"], scope=scope))


def test_snapshots(spark, source, dirs):
    rows = [(s, k, seq // 30, op, v) for s, k, seq, op, v in events() if k]
    source.add(*cut(rows, 5))
    _, view = runs.stream_snapshots(source.stream(), *dirs, ["scope"], "seq")
    same(view(), state.replace_snapshot(spark.createDataFrame(rows, SCHEMA), ["scope"], "seq"))


@pytest.mark.parametrize("rows_per_slice,shuffled", [(4, False), (1_000_000, False), (4, True), (1_000_000, True)])
def test_changes(spark, source, tmp_path, rows_per_slice, shuffled, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 2)
    rows = [r for r in events() if r[1] is not None]
    batches = rows[:]
    if shuffled:
        random.Random(4).shuffle(batches)
    source.add(*cut(batches, 5))
    _, view, log, late = runs.stream_changes(
        source.stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["seq"], ["v"], rows=rows_per_slice)
    same(view(), changes.only_changes(spark.createDataFrame(rows, SCHEMA), ["k"], ["seq"], ["v"]))
    assert (tmp_path / "t" / "seen" / "base").exists() and late().count() == 0
    assert {r.weight for r in log().collect()} == {1}  # the compaction has summed it up


def test_a_late_row_corrects_its_successor(spark, source, tmp_path):
    dirs = str(tmp_path / "t"), str(tmp_path / "c")
    source.add([(0, 1, 10, "x", 1), (0, 1, 20, "x", 1), (0, 1, 30, "x", 2)])
    _, view, _, _ = runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    assert {r.seq for r in view().collect()} == {10, 30}
    source.add([(0, 1, 25, "x", 2), (0, 1, 5, "x", 1)])
    _, view, log, _ = runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    assert {r.seq for r in view().collect()} == {5, 25}
    assert sorted((r.seq, r.weight) for r in log().collect()) == [(5, 1), (10, -1), (10, 1), (25, 1), (30, -1), (30, 1)]
    # a row that comes once more is no change
    source.add([(0, 1, 25, "x", 2)])
    _, view, _, _ = runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    assert {r.seq for r in view().collect()} == {5, 25}


def test_changes_compare_rows_without_their_payloads(spark, source, tmp_path, monkeypatch):
    # seven micro-batches of which two are compacted; rows come twice and have null orders, `op` isn't compared
    monkeypatch.setattr(runs, "COMPACT_EVERY", 2)
    seen, only_changes = [], changes.only_changes
    monkeypatch.setattr(changes, "only_changes", lambda df, *a, **b: seen.append(df.columns) or only_changes(df, *a, **b))
    rows = [r if i % 9 else (*r[:2], None, *r[3:]) for i, r in enumerate(events()) if r[1] is not None]
    rows += rows[::5]
    random.Random(6).shuffle(rows)
    source.add(*cut(rows, 7))
    dirs = str(tmp_path / "t"), str(tmp_path / "c")
    _, view, _, _ = runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    assert seen and all(set(c) == {"k", "seq", "v", "_hash", "_compared"} for c in seen)
    want = spark.createDataFrame(rows, SCHEMA).withColumn("_hash", F.xxhash64("scope", "k", "seq", "op", "v"))
    same(view(), only_changes(want, ["k"], ["seq", "_hash"], ["v"]).drop("_hash"))


def test_changes_go_on_with_rows_kept_without_hash(spark, source, tmp_path):
    dirs = str(tmp_path / "t"), str(tmp_path / "c")
    source.add([(0, 1, 10, "x", 1), (0, 1, 20, "y", 1), (0, 1, 30, "x", 2)])
    runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    kept = tables.BatchTable(spark, f"{dirs[0]}/seen", SCHEMA)
    kept.write(spark.createDataFrame(kept.read().collect(), SCHEMA), 0)
    source.add([(0, 1, 15, "z", 3)])
    _, view, _, _ = runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    assert {(r.seq, r.op) for r in view().collect()} == {(10, "x"), (15, "z"), (20, "y"), (30, "x")}


def test_changes_keep_payloads_in_small_row_groups(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "ROW_GROUP", 64 << 10)
    rnd = random.Random(9)
    source.add([(0, i % 7, i, "".join(rnd.choices("abcdefghijklmnop", k=2000)), i) for i in range(400)])
    dirs = str(tmp_path / "t"), str(tmp_path / "c")
    runs.stream_changes(source.stream(), *dirs, ["k"], ["seq"], ["v"])
    for name in ("seen", "out"):
        files = [pq.ParquetFile(f).metadata for f in (tmp_path / "t" / name).rglob("*.parquet")]
        groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
        assert sum(groups) == 400 and max(groups) <= 200


def test_jobs_fingerprint_parses_jobs_once(rows):
    whole = '{"jobs":[{"jid":"1"},{"jid":"2"}]}'
    texts = [None, "", " ", "null", "5", "{", whole[:20], "{}", '{"jobs":null}', '{"jobs":[]}', '{"other":1}', whole,
             '{"jobs":[{"jid":"2"},{"jid":"1"}]}', '{"jobs":[{"jid":"1"}]}', '{"jobs":[null]}', '{"jobs":[{"jid":"1","start-time":"x"}]}']
    df = rows("i INT, payload STRING", *enumerate(texts))
    p = F.from_json("payload", f"{schemas.JOB_OVERVIEW}, _corrupt_record STRING")
    jobs = F.coalesce(F.array_sort(F.transform(p["jobs"], lambda j: F.xxhash64(j))), F.array().cast("array<bigint>"))
    want = F.when(p.isNotNull() & p["_corrupt_record"].isNull(), F.xxhash64(F.size(jobs), jobs))
    got = df.select("i", runs.jobs_fingerprint(F.col("payload")).alias("x"), want.alias("y"))
    prints = {texts[r.i]: r.x for r in got.collect()}
    assert all(r.x == r.y for r in got.collect())
    assert [prints[t] for t in texts[:7]] == [None] * 7 and len({prints[t] for t in texts[7:11]}) == 1
    assert prints[whole] == prints[texts[12]] != prints[texts[13]]
    parsed = lambda col: df.select(col)._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    assert parsed(runs.jobs_fingerprint(F.col("payload"))) < parsed(want)


def test_rows_beyond_the_lateness_are_set_aside(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 1)
    row = lambda seq, v: (0, 1, seq, "x", v)
    source.add([row(s, 0) for s in range(10)], [row(100, 1)], [row(95, 2), row(3, 7)], [row(101, 1)])
    _, view, _, late = runs.stream_changes(
        source.stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["seq"], ["v"], lateness=20)
    assert {r.seq for r in view().collect()} == {0, 95, 100} and [r.seq for r in late().collect()] == [3]
    kept = tables.BatchTable(spark, f"{tmp_path}/t/seen", SCHEMA).read()
    assert {r.seq for r in kept.collect()} == {9, 95, 100, 101}


@pytest.mark.parametrize("key", [None, ("k", "op")])
def test_multiset_changes(spark, source, tmp_path, key, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 2)
    rows = [(s, k, seq // 20, op, v) for s, k, seq, op, v in events() if k]
    rows += [(s, k, 9, op, v) for s, k, seq, op, v in rows if seq == 5] + [(s, k, 10, op, v) for s, k, seq, op, v in rows if seq == 5]
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    source.add(*(cut(shuffled, 5) if key is None else [rows]))
    _, view = runs.stream_multiset_changes(
        source.stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["scope"], ["seq"], ["k", "v"], key)
    sets, found = {}, {(r.scope, r.seq): r.members for r in view().collect()}
    for s, k, seq, op, v in {(r[0], r[1], r[2], r[3]): r for r in rows[::-1]}.values() if key else rows:
        sets.setdefault((s, seq), []).append((k, v))
    want, before = {}, {}
    for (s, seq), members in sorted(sets.items()):
        if before.get(s) != sorted(members):
            want[s, seq] = len(members)
        before[s] = sorted(members)
    if key is None:
        assert found == want and (0, 10) not in found and len(found) > 4
        table = tables.BatchTable(spark, str(tmp_path / "t"), "scope INT, seq BIGINT, hash1 DECIMAL(20,0), hash2 DECIMAL(20,0), members BIGINT")
        table.compact(4, lambda df: changes.merge_fingerprints(df, ["scope", "seq"]))
        assert table.read().count() == len(sets)
    else:
        assert all(want.get(k, n) == n for k, n in found.items())


def test_first_errors(spark, source, tmp_path):
    rows = [r for r in events() if r[1] is not None]
    source.add(*cut(rows, 3))
    bad = F.col("op") == "Deleted"
    _, view = runs.stream_first_errors(
        source.stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["seq"], bad, "v")
    same(view(), changes.first_of_error_runs(spark.createDataFrame(rows, SCHEMA), ["k"], ["seq"], bad, "v"))


def test_watch(spark, source, dirs):
    rows = [r for r in events() if r[1] is not None]
    source.add(*cut(rows, 4))
    start, done = F.col("op") == "Added", F.col("op") == "Deleted"
    _, view = runs.stream_watch(source.stream(), *dirs, ["k"], "seq", start, done, 20)
    same(view(), watch.watch_until_complete(spark.createDataFrame(rows, SCHEMA), ["k"], "seq", start, done, 20))


def test_reconciled(spark, source, tmp_path):
    rnd = random.Random(5)
    polls = [({k for k in range(6) if rnd.random() < 0.8}, {k for k in range(6) if rnd.random() < 0.4}) for _ in range(6)]
    schema = "scope INT, k INT, seq BIGINT"
    listings = [[(0, k, i) for k in listed or {None}] for i, (listed, _) in enumerate(polls)]
    records = [[(0, k, i) for k in listed & recs] for i, (listed, recs) in enumerate(polls)]
    source.add(*listings, schema=schema)
    other = Source(spark, tmp_path / "records")
    other.add(*[r for r in records if r], schema=schema)
    _, view = runs.stream_reconciled(
        source.stream(schema), other.stream(schema), str(tmp_path / "t"), str(tmp_path / "c"), ["scope"], ["k"])
    flat = lambda parts: spark.createDataFrame([r for p in parts for r in p], schema)
    same(view(), state.reconcile_and_upsert(flat(listings), flat(records), ["scope"], ["k"]))


def test_gated_by_changing_table(spark, source, dirs):
    track = lambda *rows: lambda: spark.createDataFrame(rows, "k INT, seq BIGINT, op STRING")
    source.add([(0, 1, 1, "x", 0), (0, 2, 2, "x", 0)])
    runs.stream_gated(source.stream(), track((1, 0, "Start")), *dirs, ["k"], "seq")
    source.add([(0, 1, 5, "x", 0), (0, 2, 6, "x", 0)])
    both = track((1, 0, "Start"), (2, 3, "Start"))
    _, view = runs.stream_gated(source.stream(), both, *dirs, ["k"], "seq")
    assert {(r.k, r.seq) for r in view().collect()} == {(1, 1), (1, 5), (2, 6)}
    stopped = track((1, 0, "Start"), (2, 3, "Start"), (1, 7, "Stop"))
    _, view = runs.stream_gated(source.stream(), stopped, *dirs, ["k"], "seq")
    assert {(r.k, r.seq) for r in view().collect()} == {(2, 6)}


def test_endpoints(spark, source, dirs):
    schema = ("cluster_id STRING, namespace STRING, name STRING, cluster_ip STRING, ports ARRAY<STRUCT<name: STRING, port: INT>>, "
              "seq BIGINT, op STRING")
    port = lambda n: [("rest", n)]
    source.add(
        [("a", "n", "x-rest", "ip", port(1), 0, "Added"), ("b", "n", "y-rest", "ip", port(2), 1, "Added"),
         ("c", "n", "z", "ip", port(3), 2, "Added"), ("d", "n", "w-rest", None, port(4), 3, "Added")],
        [("a", "n", "x-rest", "ip", port(9), 4, "Modified"), ("b", "n", "y-rest", "ip", port(2), 5, "Deleted")],
        schema=schema)
    view = runs.stream_endpoints(source.stream(schema), *dirs)[1]
    assert [(r.cluster_id, r.url) for r in view().collect()] == [("a", "http://x-rest.n:9")]
    source.add([("a", "n", None, None, None, 6, "Reseted")], schema=schema)
    view = runs.stream_endpoints(source.stream(schema), *dirs)[1]
    assert view().count() == 0


def test_both_tables(spark, source, tmp_path):
    schema = "cluster_id STRING, namespace STRING, job_id STRING, job_name STRING, state STRING, start_ts BIGINT, end_ts BIGINT, " \
             "tasks STRUCT<" + ", ".join(f"{s}: INT" for s in tables.TASK_STATES) + ">, ts BIGINT"
    row = lambda job, st, ts: ("c", "n", job, "name", st, 0, -1, tuple(range(11)), ts)
    source.add([row("a", "R", 1), row("b", "R", 1)], [row("a", "F", 90_000_000), row("a", "F", 90_000_000)], schema=schema)
    paths = [str(tmp_path / p) for p in ("cur", "hist", "check")]
    _, current, history = runs.stream_both(source.stream(schema), *paths)
    assert {(r.job_id, r.state, r.task_running) for r in current().collect()} == {("a", "F", 4), ("b", "R", 4)}
    assert history().count() == 3
    assert [r.ts for r in tables.history_of(history(), "c", "n", "a").collect()] == [90_000_000, 1]
    days = {p.name for p in (tmp_path / "hist").glob("delta/*/day=*")}
    assert days == {"day=1970-01-01", "day=1970-01-02"}


def test_set_changes(spark, source, tmp_path):
    rows = [(s, k, seq // 20, op, v) for s, k, seq, op, v in events() if k]
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r[2], []).append(r)
    source.add(*by_seq.values())
    _, view = runs.stream_set_changes(
        source.stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["scope"], ["seq"], ["k", "v"])
    same(view(), changes.only_set_changes(spark.createDataFrame(rows, SCHEMA), ["scope"], ["seq"], ["k", "v"]))


@pytest.mark.parametrize("insert", [True, False])
def test_upserts(spark, source, dirs, monkeypatch, insert):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 2)
    rows = [r for r in events() if r[1] is not None]
    source.add(*cut(rows))
    combine, add = [F.sum("v").alias("v")], {"v": F.col("v") + F.col("new.v")}
    put = {"v": F.col("new.v")}
    _, view = runs.stream_upserts(source.stream(), *dirs, "k INT, v BIGINT", ["k"], combine, put, add, insert)
    want = {}
    for r in rows if insert else []:
        want[r[1]] = want.get(r[1], 0) + r[4]
    assert {r.k: r.v for r in view().collect()} == want


def test_usage(spark, source, tmp_path):
    rows = events(seed=8)
    source.add(*cut(rows))
    other = Source(spark, tmp_path / "usage")
    used = [(k % 2, k, seq, v) for _, k, seq, _, v in events(seed=11) if k]
    schema = "scope INT, k INT, seq BIGINT, cpu INT"
    other.add(*cut(used, 3), schema=schema)
    _, view = runs.stream_usage(
        source.stream(), other.stream(schema), str(tmp_path / "t"), str(tmp_path / "c"), ["scope"], ["k"])
    same(view(), usage_by_live_pods(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(used, schema), ["scope"], ["k"]))


def test_change_events_as_stream(spark, source, dirs):
    body = '{"metadata":{"name":"%s","labels":{"app":"%s","type":"%s"}}}'
    native = "flink-native-kubernetes"
    source.add(
        [("Added", "pod", "s", 1, body % ("p1", "c", native)), ("Added", "pod", "s", 2, body % ("p2", "d", native)),
         ("Added", "pod", "s", 3, body % ("p3", "c", "other"))],
        [("Added", "pod", "s", 4, body % ("p4", "c", native)), ("Deleted", "pod", "s", 5, body % ("p1", "c", native)),
         ("Added", "secret", "s", 6, body % ("x", "c", native))],
        schema=schemas.CHANGE_EVENT)
    rows = objects.read_changelog(source.stream(schemas.CHANGE_EVENT), "c").drop("object")
    _, view = runs.stream_changelog(rows, *dirs, ["kind", "scope"], ["name"])
    assert [(r.kind, r.name) for r in view().collect()] == [("pod", "p4")]


def test_counts_and_filters_run_on_streams(spark, source, tmp_path):
    rows = [r for r in events() if r[1] is not None]
    source.add(*cut(rows))
    counts = aggregates.state_counts(source.stream(), ["scope"], "op", ("Added", "Deleted"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("op_counts").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    same(spark.table("op_counts"), aggregates.state_counts(
        spark.createDataFrame(rows, SCHEMA), ["scope"], "op", ("Added", "Deleted")))


def test_follow_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pod-1.log").write_text("one\n\ntwo\n")
    stream = logs.follow_log(spark, str(tmp_path / "in"))
    table = tables.BatchTable(spark, str(tmp_path / "out"), stream.schema)
    runs.run(stream, str(tmp_path / "c"), lambda b, i: table.write(b, i))
    (tmp_path / "in" / "pod-2.log").write_text("three")
    stream = logs.follow_log(spark, str(tmp_path / "in"))
    runs.run(stream, str(tmp_path / "c"), lambda b, i: table.write(b, i))
    assert sorted((r.text, r.file.split("/")[-1]) for r in table.read().collect()) == [
        ("", "pod-1.log"), ("one", "pod-1.log"), ("three", "pod-2.log"), ("two", "pod-1.log")]


def test_payload_decoders_run_on_streams(spark, source):
    schema = "cluster_id STRING, namespace STRING, payload STRING, ts BIGINT"
    source.add([("a", "n", '{"jobs":[{"jid":"1"}]}', 1)], schema=schema)
    rows = payloads.payload_job_overview(source.stream(schema))
    assert rows.isStreaming and "job_id" in rows.columns
