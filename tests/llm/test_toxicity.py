import random

import numpy as np
import pytest

from fleetlens.llm.toxicity import CATEGORIES, fit_chain, toxicity, word_buckets


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, labels = [], []
    for i in range(1200):
        words, bad, poor = [word() for _ in range(rng.randint(5, 60))], rng.random() < 0.15, rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Nasty!", "vile", "odious" + word()])
        if poor:
            words += ["buy", "now"]
        rows.append((i, " ".join(words), bad))
        if i % 2:
            labels.append((i, int(not poor), int(bad if rng.random() > 0.02 else not bad)))
    rows += [(5000, None, False), (5001, "", False), (None, "vile vile", True), rows[1]]
    labels += [(7, None, None), (None, 1, 1), (999_999, 1, 1)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, truth boolean, p_toxic double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    truth = [(r["doc_id"], r["truth"]) for r in docs.collect()]
    found = toxicity(docs, labels)
    assert found.columns == ["doc_id", "p_quality", "p_toxic", "toxic"]
    rows = found.collect()
    assert len(rows) == len(truth) and all(0 <= r["p_toxic"] <= 1 and 0 <= r["p_quality"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["toxic"] for r in rows}
    unseen = [(i, t) for i, t in truth if i is None or i % 2 == 0]
    caught = [by_id[i] for i, t in unseen if t]
    assert sum(caught) >= 0.9 * len(caught)
    clean = [by_id[i] for i, t in unseen if not t]
    assert sum(clean) <= 0.02 * len(clean)
    assert sorted(map(tuple, toxicity(docs.repartition(5), labels).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_no_labels_and_no_documents(tables, no_docs):
    docs, labels = tables
    rows = toxicity(docs, labels.limit(0)).collect()
    assert {(r["p_quality"], r["p_toxic"], r["toxic"]) for r in rows} == {(0.5, 0.5, False)}
    assert toxicity(no_docs, labels).collect() == []


def test_later_models_use_out_of_fold_probabilities():
    """A second category that equals the first is learned from its probability alone."""
    rng = np.random.default_rng(3)
    n = 400
    first = rng.integers(0, 2, n).astype(float)
    columns = np.array([c for y in first for c in (int(y), 10 + rng.integers(0, 5))])
    models = fit_chain(columns, np.full(n, 2), np.column_stack([first, first]), np.arange(n) % 4)
    assert models[0].extra.size == 0 and models[1].extra.size == 1 and models[1].extra[0] > 0.5
    assert len(CATEGORIES) == 2


def test_word_buckets():
    assert word_buckets(b"").size == 0
    assert np.array_equal(word_buckets(b"A b, a"), word_buckets(b"b a"))
    assert not np.array_equal(word_buckets(b"abcdefgh"), word_buckets(b"abcdefgi"))
