import random

import numpy as np
import pytest
import xxhash
from helpers import ascii_lower, collected, components, plain_words

from fleetlens.llm.common import components as spark_components
from fleetlens.llm.simhash import GrayIndex, fingerprint, gray_rank, links, simhash_groups


def brute_fingerprint(text):
    words = plain_words(ascii_lower(text))
    if not words:
        return 0
    parts = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_values(seed, n):
    """Fingerprints in clusters of a few bits, chains included."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            out.add(value)
            for _ in range(rng.randint(1, 4)):
                value ^= 1 << rng.randrange(64)
    return sorted(out)


def test_fingerprints(doc_rows):
    for row in doc_rows:
        assert fingerprint((row[1] or "").encode()) == brute_fingerprint(row[1])
    long = " ".join(random.Random(1).choices(["a", "bc", "Def", "ü"], k=700_000))
    assert fingerprint(long.encode()) == brute_fingerprint(long)


def test_gray_order_changes_one_bit_at_a_time():
    by_rank = np.argsort(gray_rank(np.arange(256, dtype=np.uint64)))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(by_rank[:-1], by_rank[1:], strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_components(seed):
    values = near_values(seed, 400)
    groups = np.array([i % 3 for i in range(len(values))])
    index = GrayIndex(groups, np.array(values, np.uint64))
    label = index.components()
    found = [int(x) for x in index.values]
    own = index.groups
    expected = components(len(found), lambda a, b: own[a] == own[b] and (found[a] ^ found[b]).bit_count() <= 3)
    assert list(label) == expected


@pytest.mark.parametrize("group_rows", [32_768, 8])
def test_links_lose_no_component(spark, group_rows):
    values = near_values(9, 500)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in spark_components(links(table, group_rows=group_rows), "t").collect()}
    expected = components(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)
    least = {}
    for v, c in zip(signed, expected, strict=True):
        least[c] = min(least.get(c, v), v)
    assert [roots.get(v, v) for v in signed] == [least[c] for c in expected]


def test_groups_match_brute_force(docs, doc_rows):
    prints = [brute_fingerprint(r[1]) for r in doc_rows]
    comp = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for row, c in zip(doc_rows, comp, strict=True):
        if row[0] is not None:
            least[c] = min(least.get(c, row[0]), row[0])
    expected = [(r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(doc_rows, prints, comp, strict=True)]
    assert collected(simhash_groups(docs)) == sorted(expected, key=repr)


def test_no_documents_and_long_chains(spark, no_docs):
    assert simhash_groups(no_docs).collect() == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7)], "a long, b long")
    assert {r["root"] for r in spark_components(chain, "t").collect()} == {0}
