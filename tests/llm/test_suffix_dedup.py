import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import collected

from fleetlens.llm import suffix_dedup
from fleetlens.llm.suffix_dedup import anchors, dedup_substrings, multikey_groups


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    data, count = [(t or "").encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(bool(gone.size) and bool(gone[0]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed, n=40):
    """Texts with shared passages of around the limit, near copies, runs of one letter and copies."""
    rng = random.Random(seed)
    letters = lambda k, a="abcdefghij ": "".join(rng.choice(a) for _ in range(k))
    passages = [letters(k) for k in (30, 39, 40, 41, 60, 90)] + ["é" * 30, "x" * 70]
    texts = []
    for _ in range(n):
        parts = [letters(rng.randint(0, 60), rng.choice(["abcdefghij ", "ab", "é x"])) for _ in range(rng.randint(1, 4))]
        texts.append("".join(p + (rng.choice(passages) if rng.random() < 0.7 else "") for p in parts))
    return texts + [texts[0], texts[1], "", None, texts[2][:-1], "q" * 39, "q" * 40]


def test_every_window_has_its_anchor():
    rng = random.Random(3)
    for k in (200, 201, 1000, 300_000):
        data = bytes(rng.choices(b"abc ", k=k))
        place, first, last, own = anchors(data)
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        assert (place >= last).all() and (place + 40 <= first + 200).all() and (np.diff(place) > 0).all()
    assert anchors(b"x" * 199)[0].size == 0
    piece = bytes(rng.choices(b"abcdefgh", k=500))
    where = [set((anchors(b"z" * n + piece)[0] - n)[2:]) for n in (0, 57)]
    assert where[0] <= where[1]


def test_multikey_sort_finds_equal_strings():
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=400)), np.uint8)
    starts, groups = np.arange(380), np.arange(380) % 2
    for length in (8, 13, 20):
        seen = {}
        for s, g in zip(starts, groups, strict=True):
            seen.setdefault((g, data[s : s + length].tobytes()), []).append(s)
        expected = sorted(s for own in seen.values() if len(own) > 1 for s in own)
        assert multikey_groups(data, starts, groups, length).tolist() == expected


@pytest.mark.parametrize("bucket_runs", [4096, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed, bucket_runs):
    texts = planted(seed)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, key1 int")
    got = {r["doc_id"]: tuple(r)[1:] for r in
           dedup_substrings(docs.repartition(4), length=40, anchor=12, bucket_runs=bucket_runs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_neighbours_across_boundaries_count(spark, monkeypatch):
    """With as many partitions as rows, most comparisons go across a boundary."""
    texts = planted(7, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in dedup_substrings(docs, length=40, anchor=12).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_edge_cases(docs, doc_rows, no_docs):
    expected = brute([r[1] for r in doc_rows], 200)
    got = collected(dedup_substrings(docs))
    assert got == sorted(((r[0], *e) for r, e in zip(doc_rows, expected, strict=True)), key=repr)
    assert dedup_substrings(no_docs).collect() == []
    kept = dedup_substrings(docs, with_bytes=True).select("kept", "kept_sha256").collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)


def test_limits():
    assert suffix_dedup.LENGTH - suffix_dedup.ANCHOR <= 255


def python_peak(run):
    """Most bytes that Python and NumPy hold at once while `run` works."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_anchors_of_many_short_texts_come_in_bounded_batches():
    rng = random.Random(11)
    texts = [bytes(rng.choices(b"abcdefgh ", k=2000)).decode() for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "text": texts})
    sizes = [b.num_rows for b in suffix_dedup._anchor_rows([batch], 200, 40)]
    assert sum(sizes) > 70_000 and max(sizes) < 66_000


def ranged(n_rows, per_row):
    """Texts with ranges (null for the first one) as `_cut` gets them."""
    ranges = [None] + [[{"first": 300 * i, "last": 300 * i + 40} for i in range(per_row)]] * (n_rows - 1)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    texts = ["x" * 300 * per_row] * n_rows
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n_rows)), pa.array(texts), pa.array(ranges, kind)], names=["doc_id", "text", "ranges"]
    )


def test_many_ranges_take_little_memory():
    batch, out = ranged(500, 200), []
    peak = python_peak(lambda: out.extend(suffix_dedup._cut([batch], 200, False)))
    assert peak < 5 << 20  # 100,000 ranges; objects for all of them at once took 35 MB
    got = pa.Table.from_batches(out).to_pydict()
    assert got["n_removed"] == [0] + [240 * 200] * 499 and got["n_spans"] == [0] + [200] * 499
    assert set(got["kept_sha256"][1:]) == {hashlib.sha256(b"x" * 60 * 200).hexdigest()}
    # a part of a larger batch
    assert pa.Table.from_batches(suffix_dedup._cut([batch.slice(1, 3)], 200, False)).to_pydict()["doc_id"] == [1, 2, 3]


def test_multikey_sort_takes_little_memory():
    data = np.random.default_rng(2).integers(97, 99, 300_000, dtype=np.uint8)
    starts = np.arange(data.size - 199)
    peak = python_peak(lambda: multikey_groups(data, starts, starts % 160, 200))
    assert peak < 72 * starts.size


def test_spans_are_maximal():
    spans = lambda *ranges: [x.tolist() for x in suffix_dedup.removed_spans(*np.array(ranges, np.int64).reshape(-1, 2).T, 10)]
    assert spans() == [[], []]
    assert spans((30, 31), (0, 5), (2, 3), (15, 15)) == [[0, 30], [25, 41]]
    assert spans((0, 0), (10, 20), (31, 31)) == [[0, 31], [30, 41]]


def test_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 800) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches)
    before = spark.conf.get(name)
    with suffix_dedup._small_batches(spark):
        most = max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect())
    assert most < 5 << 20  # 30 MB in all
    assert spark.conf.get(name) == before
    result = dedup_substrings(docs.limit(5))
    assert spark.conf.get(name) == before
    # no text goes to Python later, when the setting has its value back
    assert "MapInArrow" not in result._jdf.queryExecution().toString()
    assert {tuple(r)[1:4] for r in result.collect()} == {(51_200, 51_200, 1)}
