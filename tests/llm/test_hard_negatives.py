import math
import random

import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives as op
from fleetlens.llm.hard_negatives import Best, mine_hard_negatives, products
from fleetlens.llm.queries import CASES

SCHEMA = "vec_id long, embedding array<float>, label int, score int, uid string"


def table(seed=2, n=260, dim=6, digits=1):
    """Vectors with ties, repeated rows and ids, and rows that take no part."""
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0.3, 0.5), digits) for _ in range(dim)], rng.randint(0, 3), 1, "k") for i in range(n)]
    rows += [(7, None, 1, 1, "k"), (20, [0.5] * dim, None, 1, None), (30, [float("nan")] + [0.1] * (dim - 1), 1, 1, "k"),
             (31, [float("-inf")] + [0.1] * (dim - 1), 2, 1, "k"), (32, [None] + [0.1] * (dim - 1), 2, 1, "k"), (33, [], 1, 1, "k"),
             (40, [0.7, 0.2], 2, 1, "k"), (None, [0.4] * dim, 1, 1, "k"), (None, [0.4] * dim, 2, 1, "k"), rows[5], rows[6], rows[10]]
    return rows


def brute(rows, every, k=5, negatives=10, low=30, high=90, scale=256):
    own = []
    for at, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((at, i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for at, i, label, v in own:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, n, other) for n, j, other, w in own if n != at]
        for place, (ps, pid, _, _) in enumerate(sorted((x for x in scored if x[3] == label), key=key)[:k], 1):
            hard = sorted((x for x in scored if x[3] != label and low * ps <= 100 * x[0] <= high * ps), key=key)
            out += [(i, pid, r, x[1], ps, x[0], place) for r, x in enumerate(hard[:negatives], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,digits,settings", [
    (2, 1, {}), (3, 0, {}), (4, 3, {"positives": 3, "negatives": 2, "low": 10, "high": 120}), (5, 2, {"positives": 1}),
])
def test_matches_brute_force(spark, seed, digits, settings):
    rows = table(seed, digits=digits)
    # one partition keeps the order of the rows, which is that of equal rows
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **settings)
    want = {"k": settings.get("positives", 5), "negatives": settings.get("negatives", 10), "low": settings.get("low", 30), "high": settings.get("high", 90)}
    assert collected(got) == brute(rows, 10, **want) and got.count()


def test_blocks_and_tasks_change_nothing(spark, monkeypatch):
    rows = [r for r in table(6, 200, digits=3) if r[0] is not None][:200]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 10)
    monkeypatch.setattr(op, "_TILE_ANCHORS", 3)
    for parts, settings in ((7, {"block_bytes": 8 * 6 * 3}), (3, {"task_rows": 10, "block_bytes": 1})):
        assert collected(mine_hard_negatives(frame.repartition(parts), F.col("vec_id") % 10 == 0, **settings)) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine_hard_negatives(empty, F.lit(True)).collect() == []
    alone = spark.createDataFrame([(0, [0.5], 1, 1, "k"), (1, [0.5], 2, 1, "k"), (2, None, 2, 1, "k")], SCHEMA)
    assert mine_hard_negatives(alone, F.lit(True)).collect() == []  # no anchor has a positive
    with pytest.raises(ValueError):
        mine_hard_negatives(empty, F.lit(True), positives=0)


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [-0.5, 0.0], 2)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    got = mine_hard_negatives(frame, F.col("vec_id") == 0)
    # 30 to 90 percent of a negative score is no window, of zero it is zero alone
    assert collected(got) == [(0, 2, 1, 3, 0, 0, 1)]


def test_best_keeps_the_first_of_each_group(monkeypatch):
    monkeypatch.setattr(op, "_PENDING", 20)
    rng = np.random.default_rng(1)
    group, score, ids = rng.integers(0, 5, 3000), rng.integers(-9, 9, 3000), rng.permutation(3000)
    best = Best(5, 4)
    for at in range(0, 3000, 7):
        some = slice(at, at + 7)
        best.add(group[some], score[some], ids[some], ids[some])
    want = [x for g in range(5) for x in sorted((g, -s, i) for g_, s, i in zip(group, score, ids, strict=True) if g_ == g)[:4]]
    g, s, i, _ = best.rows()
    assert list(zip(g.tolist(), (-s).tolist(), i.tolist(), strict=True)) == want


def test_products_are_exact():
    rng = random.Random(3)
    for size in (10, 2**24, 2**30):
        a, b = ([[float(rng.randint(-size, size)) for _ in range(8)] for _ in range(4)] for _ in "ab")
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert products(np.array(a), np.array(b)).tolist() == want
    assert products(np.array([[1e30, 1.0]]), np.array([[1e30, 1.0], [-1e30, 1.0]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_query_relabels_every_seventh_row(spark, tmp_path):
    rows = [r for r in table(8, 300, 4) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (c + 1) % 10 if c is not None and i % 7 == 0 else c) for i, v, c, *_ in rows]
    assert collected(CASES["op11_hard_negatives"][0](spark, str(tmp_path)).drop("positive_rank")) == [
        x[:6] for x in brute(moved, 100)]
