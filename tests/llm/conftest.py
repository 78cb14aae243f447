import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit string, row long, key1 string"


def make_docs(seed=1, n=60):
    """Small documents with nulls, empty and long texts, ties, near copies, repeated rows and columns of clashing names."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "the", "of", "licht", "über", "niño", "été", "x1", "42"]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [sentence(rng.randint(1, 80)) for _ in range(n)]
    base = sentence(120)
    texts += [base, base.upper(), base + " end", base.replace("alpha", "omega", 1)]
    texts += [None, "", "  ", "!!! ---", "a", "word " * 3000, sentence(5000), "\n".join([base, sentence(40), base])]
    texts += ["Apache License, version 2.0", "under the MIT license and CC-BY 4.0"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None, "h", 7, "k")
            for i, t in enumerate(texts)]
    rows.append((None, base, "en", "s1", 1, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    rows += [rows[3], rows[n], rows[n]]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
