"""Streams with bounded tables give what the batch operators give over all rows."""

import random

import pytest
from pyspark.sql import functions as F
from test_streams import SCHEMA, Source, cut, events, same

from fleetlens.operators import state, watch
from fleetlens.sources import tables
from fleetlens.streaming import bounded, runs

POLLS = "scope INT, k INT, seq BIGINT"


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path / "in")


def polled(seed, n=14):
    """(listings, records) of two scopes; some polls list nothing."""
    rnd = random.Random(seed)
    listings, records = [], []
    for scope in (0, 1):
        for seq in range(n):
            keys = {k for k in range(8) if rnd.random() < (0.0 if rnd.random() < 0.08 else 0.85)}
            listings += [(scope, k, seq) for k in keys or {None}]
            records += [(scope, k, seq) for k in keys if rnd.random() < 0.3]
    return listings, records


def nearly_sorted(rows, jitter, seed=1):
    rnd = random.Random(seed)
    return sorted(rows, key=lambda r: r[2] + rnd.random() * jitter)


@pytest.mark.parametrize("seed,delay,every", [(1, None, 2), (2, 4, 1), (5, 3, 1)])
def test_reconciled(spark, source, tmp_path, monkeypatch, seed, delay, every):
    monkeypatch.setattr(runs, "COMPACT_EVERY", every)
    listings, records = polled(seed)
    order = listings[:] if delay else random.Random(seed).sample(listings, len(listings))
    source.add(*cut(nearly_sorted(order, delay * 0.9) if delay else order, 6), schema=POLLS)
    other = Source(spark, tmp_path / "records")
    other.add(*cut(random.Random(seed).sample(records, len(records)), 4), schema=POLLS)
    _, view, late = bounded.stream_reconciled(
        source.stream(POLLS), other.stream(POLLS), str(tmp_path / "t"), str(tmp_path / "c"), ["scope"], ["k"], delay=delay)
    frame = lambda rows: spark.createDataFrame(rows, POLLS)
    same(view(), state.reconcile_and_upsert(frame(listings), frame(records), ["scope"], ["k"]))
    assert late().count() == 0
    if delay:
        table = tables.BatchTable(spark, f"{tmp_path}/t/polls", f"{POLLS}, kind STRING, upto BIGINT")
        table.compact(9, lambda df: bounded.fold_polls(df, ["scope"], ["k"], "seq", 0))
        assert table.read().filter("kind = 'poll'").count() == 0 and table.read().count() <= 2 * 9
        same(bounded.reconcile_folded(table.read(), frame(records), ["scope"], ["k"]),
             state.reconcile_and_upsert(frame(listings), frame(records), ["scope"], ["k"]))


def test_polls_that_are_too_late_are_set_aside(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 1)
    source.add([(0, 1, 0)], [(0, 1, 50)], [(0, 2, 3), (0, 1, 51)], schema=POLLS)
    other = Source(spark, tmp_path / "records")
    other.add([(0, 1, 0)], schema=POLLS)
    _, view, late = bounded.stream_reconciled(
        source.stream(POLLS), other.stream(POLLS), str(tmp_path / "t"), str(tmp_path / "c"), ["scope"], ["k"], delay=5)
    assert [tuple(r) for r in late().collect()] == [(0, 2, 3)] and [tuple(r) for r in view().collect()] == [(0, 1, 0)]


def tracked(seed):
    rnd = random.Random(seed)
    rows = [(0, rnd.randint(1, 6), i, "x", i) for i in range(200) if rnd.random() < 0.8]
    marks = [(rnd.randint(1, 5), i, rnd.choice(["Start", "Start", "Stop"])) for i in range(200) if rnd.random() < 0.15]
    return rows, marks


@pytest.mark.parametrize("seed,delay", [(1, None), (3, 20)])
def test_gated(spark, source, tmp_path, monkeypatch, seed, delay):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 1)
    rows, marks = tracked(seed)
    schema = "k INT, seq BIGINT, op STRING"
    moved = random.Random(seed).sample(rows, len(rows))
    other = Source(spark, tmp_path / "marks")
    rnd = random.Random(seed)
    near = sorted(marks, key=lambda r: r[1] + rnd.random() * (delay or 999) * 0.9)
    paths = str(tmp_path / "t"), str(tmp_path / "c")
    for part, some in zip(cut(moved, 4), cut(near, 4), strict=True):  # rows and marks come in turns
        source.add(part)
        other.add(some, schema=schema)
        _, view, late = bounded.stream_gated(source.stream(), other.stream(schema), *paths, ["k"], delay=delay)
    same(view(), state.gate_by_tracking(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, schema), ["k"], "seq"))
    assert late().count() == 0
    kept = tables.BatchTable(spark, f"{paths[0]}/rows", SCHEMA).read()
    if delay:  # only rows of the result and those near the end are left
        known = tables.BatchTable(spark, f"{paths[0]}/tracking", schema).read()
        upto = tables.BatchTable(spark, f"{paths[0]}/bounds", "upto BIGINT").read().agg(F.max("upto")).first()[0]
        left = bounded.release_untracked(kept, known, ["k"], upto=upto)
        result = {r.seq for r in view().collect()}
        assert {r.seq for r in left.collect() if r.seq <= upto} == {s for s in result if s <= upto}
        assert known.filter(F.col("seq") <= upto).groupBy("k", "op").count().filter("count > 1").count() == 0


def test_watch_by_event_time(spark, source, tmp_path):
    rows = [(0, r[1], r[2], r[3], r[4]) for r in events(200) if r[1] is not None]
    source.add(*cut(rows, 4))
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("seq") * 1000)
    stream = source.stream().withColumn("at", at)
    start, done = F.col("op") == "Added", (F.col("op") == "Deleted") & (F.col("v") == 2)
    _, view = bounded.stream_watch(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "at", start, done, "9 seconds", "5 seconds")
    batch = spark.createDataFrame(rows, SCHEMA)
    newest = batch.agg(F.max("seq")).first()[0] - 5
    want = watch.watch_until_complete(batch, ["k"], "seq", start, done, 9, now=newest)
    seconds = lambda c: (F.unix_millis(c) / 1000 - 1_700_000_000).cast("bigint")
    got = view().select("k", seconds(F.col("start_ts")).alias("start_ts"), seconds(F.col("completed_ts")).alias("completed_ts"), "status")
    same(got, want)
    assert len({r.status for r in got.collect()}) >= 2


def test_metric_keys(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 1)
    schema = "job STRING, payload STRING, ts TIMESTAMP"
    rows = lambda *x: [(j, p, __import__("datetime").datetime(2024, 1, 1, h)) for j, p, h in x]
    good = '[{"id":"a","value":"1"},{"id":"b","value":"2"}]'
    source.add(rows(("x", good, 1), ("x", '[{"id":"a"', 1), ("y", "[]", 1)), rows(("x", good, 1), ("y", '[{"id":"a","value":"3"}]', 2)),
               rows(("x", good, 9), ("z", None, 9)), rows(("x", "{", 9)), schema=schema)
    _, view, rejected = bounded.stream_metric_keys(
        source.stream(schema), str(tmp_path / "t"), str(tmp_path / "c"), ["job"])
    assert sorted(tuple(r) for r in view().collect()) == [("x", "a"), ("x", "b"), ("y", "a")]
    assert sorted(r.bad_payload for r in rejected().collect()) == ['[{"id":"a"', "{"]
