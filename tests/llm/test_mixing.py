import numpy as np
import pytest
from helpers import collected, plain_words

from fleetlens.llm.mixing import count_words, mix_sources, mix_slots, mixed_spans, permute, source_targets
from fleetlens.llm.common import written


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and target[s] >= most * sizes[s]}
        if not above:
            return target
        capped |= above


def source_sizes(doc_rows):
    out = {}
    for row in doc_rows:
        out[row[3]] = out.get(row[3], 0) + len(plain_words(row[1]))
    return out


def test_word_counts():
    for text in ("", " ", "a", " a  b\tc\nd ", "é\xa0b \x1c c", "x" * 3_000_000, "ab " * 900_000):
        assert count_words(text.encode()) == len(plain_words(text))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    got = permute(np.arange(size), size, (1, 2))
    assert sorted(got) == list(range(size))
    assert list(permute(np.arange(size), size, (1, 2))) == list(got)
    assert size < 100 or list(permute(np.arange(size), size, (1, 3))) != list(got)


@pytest.mark.parametrize("block_words", [1, 7, 64])
def test_mix_meets_its_targets(docs, doc_rows, block_words):
    sizes = source_sizes(doc_rows)
    targets = brute_targets(sizes)
    rows = mix_sources(docs, block_words=block_words).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in rows), key=repr) == sorted(
        ((r[0], r[3], len(plain_words(r[1]))) for r in doc_rows), key=repr)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= block_words + 1


def test_reruns_agree_and_spans_add_up(docs):
    first = collected(mix_sources(docs))
    assert collected(mix_sources(docs.repartition(5))) == first
    spans = mixed_spans(docs, shard_slots=16)
    taken = {}
    for r in spans.collect():
        assert r["first_word"] >= 0 and r["n_words"] > 0 and r["slot"] < 16
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["n_words"]
    expected = {}
    for doc_id, _, _, _, _, n in first:
        expected[doc_id] = expected.get(doc_id, 0) + n
    assert taken == {k: v for k, v in expected.items() if v}


def test_shards_are_full_and_mixed(spark):
    sizes = spark.createDataFrame([(1, "a", 6400), (2, "b", 6400), (3, "c", 6400)], "doc_id long, source string, size long")
    targets = written(source_targets(sizes), "targets")
    slots = mix_slots(targets, block_words=10, shard_slots=200).collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    by_shard = {}
    for r in slots:
        by_shard.setdefault(r["shard"], []).append(r["number"])
    assert sorted(map(len, by_shard.values()))[1:] == [200] * (len(by_shard) - 1)
    share = sum(r["number"] == 0 for r in slots) / len(slots)
    assert all(abs(sum(n == 0 for n in own) / len(own) - share) < 0.15 for own in by_shard.values() if len(own) == 200)


def test_tiny_and_no_documents(spark, no_docs):
    assert mix_sources(no_docs).collect() == []
    one = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert sorted(tuple(r)[2:] for r in mix_sources(one).collect()) == [(0, 0, 0.0, 0), (0, 0, 0.0, 0)]
