import hashlib

import pytest
from helpers import ascii_lower, collected
from pyspark.sql import functions as F

from fleetlens.llm.block_naming import block_identities, exact_dedup


@pytest.mark.parametrize("block_bytes", [64, 8192])
def test_groups_match_brute_force(docs, doc_rows, block_bytes):
    groups = {}
    for row in doc_rows:
        groups.setdefault(ascii_lower(row[1]), []).append(row[0])
    expected, kept = [], set()
    for row in doc_rows:
        text = ascii_lower(row[1])
        ids = groups[text]
        keep = max((i for i in ids if i is not None), default=None)
        stays = row[0] == keep and text not in kept
        kept |= {text} if stays else set()
        expected.append((row[0], keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    assert collected(exact_dedup(docs, block_bytes=block_bytes)) == sorted(expected, key=repr)


def test_shared_hashes_are_told_apart_by_their_bytes(docs):
    weak = lambda c: (F.octet_length(c) % 3).cast("long")
    plain = block_identities(docs, block_bytes=64).select("sha256", "blocks", "name").distinct()
    forced = block_identities(docs, block_bytes=64, hash_of=weak).select("sha256", "blocks", "name").distinct()
    for found in (plain, forced):
        assert found.count() == found.select("sha256").distinct().count() == found.select("blocks", "name").distinct().count()


def test_no_documents(no_docs):
    assert exact_dedup(no_docs).collect() == []
