"""As-of joins against brute force."""

import random

import pytest

from fleetlens.operators import joins
from fleetlens.operators.asof import asof_join

LEFT, RIGHT = "k INT, at INT, v INT", "k INT, at INT, seq INT, m MAP<STRING, INT>, v INT"


def tables(seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    when = lambda: rnd.choice([*range(30), None])
    left = [(key(), when(), i) for i in range(300)]
    right = [(rnd.choice([1, 1, 1, 4, None, 3]), when(), i, {"x": i}, i) for i in range(120)]
    return left, right


def brute(left, right):
    out = []
    for k, at, v in left:
        fits = [(r[1], r[2], r[4]) for r in right if None not in (k, at, r[0], r[1]) and r[0] == k and r[1] <= at]
        out.append((k, at, v, max(fits)[2] if fits else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,hot", [(1, None), (2, 7), (3, 40), (4, 1)])
def test_matches_brute_force(rows, seed, hot):
    left, right = tables(seed)
    got = asof_join(rows(LEFT, *left), rows(RIGHT, *right), ["k"], ["at"], ["m", "v"], ["seq"], rows=hot)
    assert got.columns == ["k", "at", "v", "asof"]
    assert sorted(((r.k, r.at, r.v, r.asof and r.asof.v) for r in got.collect()), key=str) == brute(left, right)
    assert all(r.asof.m == {"x": r.asof.v} for r in got.collect() if r.asof)


def test_a_slice_without_right_rows_knows_the_ones_before(rows):
    left = [(1, i, i) for i in range(200)]
    got = asof_join(rows(LEFT, *left), rows(RIGHT, (1, 3, 0, {}, 7)), ["k"], ["at"], ["v"], rows=10)
    assert all((r.asof and r.asof.v) == (7 if r.at >= 3 else None) for r in got.collect()) and got.count() == 200


def test_a_second_config_does_not_multiply_polls(rows):
    polls = rows("cluster_id STRING, namespace STRING, ts INT, slots INT", ("a", "n", 1, 5), ("a", "n", 4, 5), ("a", "n", 9, 6), ("b", "n", 2, 1))
    configs = rows("cluster_id STRING, namespace STRING, ts INT, config MAP<STRING, STRING>",
                   ("a", "n", 2, {"exec.mode": "kubernetes-session"}), ("a", "n", 9, {"exec.mode": "kubernetes-application", "deploy.source": "fleet"}))
    got = sorted(tuple(r)[2:] for r in joins.cluster_overview(polls, configs).collect())
    assert got == [(4, 5, "kubernetes-session", False), (9, 6, "kubernetes-application", True)]
    kept = joins.cluster_overview(polls, configs, keep_unconfigured=True)
    assert sorted((r.cluster_id, r.ts, r.exec_mode) for r in kept.collect() if r.ts < 4) == [("a", 1, "Unknown"), ("b", 2, "Unknown")]
    static = configs.drop("ts")
    assert joins.cluster_overview(polls, static).count() == 3


def test_empty_tables(rows):
    left, right = rows(LEFT, (1, 2, 3)), rows(RIGHT)
    assert [r.asof for r in asof_join(left, right, ["k"], ["at"], ["v"]).collect()] == [None]
    assert asof_join(rows(LEFT), rows(RIGHT, (1, 1, 1, {}, 1)), ["k"], ["at"], ["v"]).count() == 0
