"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints that differ in 3 bits or fewer agree in at least one of four bands of 16 bits, so each distinct fingerprint
goes to four groups. A group that is too large is dealt out again by four bands of the remaining bits, which keeps the
promise. Within a group, fingerprints are sorted by Gray rank; a node of the index has the bits that all its fingerprints
share, as mask and value, and a search adds up the differences on the way down and drops a node with more than 3.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, components, numbered, pieces, signed, text_bytes, written
from fleetlens.llm.paragraphs import near_documents

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
# fingerprints in one group of the index; larger groups are dealt out again
GROUP_ROWS = 32_768

_LEVELS = (16, 12, 9)  # bits of a band at each level: a quarter of the bits that are not yet equal, or less
_NODE = 8
_PAIRS = 2_000_000


def fingerprint(data, words_per_shingle=SHINGLE_WORDS):
    """SimHash of a text in UTF-8 as an unsigned number; a text without words has 0."""
    ones, n, carry, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for words in pieces(data, LOWER):
        words = carry + words
        if len(words) >= words_per_shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[: len(words) - words_per_shingle] + 1).tolist()
            ends = ends[words_per_shingle - 1 :].tolist()
            hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
            ones += _bit_counts(hashes)
            n += hashes.size
            carry = words[len(words) - words_per_shingle + 1 :]
        else:
            carry = words
    if not n:
        if not carry:
            return 0
        ones, n = _bit_counts(np.array([digest(b" ".join(carry), HASH_SEED)], np.uint64)), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _bit_counts(hashes):
    total = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprints(docs, id_col="doc_id", text_col="text", words_per_shingle=SHINGLE_WORDS):
    """doc_id and the fingerprint as a signed long. Null texts have no words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def hashed(batches):
        for batch in batches:
            values = [fingerprint(x, words_per_shingle) if x else 0 for x in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed(values), pa.int64())], names=["doc_id", "fingerprint"]
            )

    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def gray_rank(values):
    """Place of each value (uint64) in the Gray order."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Index over the fingerprints of many groups; `groups` are numbers, equal for the rows of a group."""

    def __init__(self, groups, values):
        order = np.lexsort((gray_rank(values), groups))
        self.groups, self.values = groups[order], values[order]
        self.order = order
        # levels of nodes from the leaves up: first row or child, number of them, mask and value of the shared bits
        self.levels = []
        owner, size = self.groups, self.values.size
        both, either = self.values, self.values
        while True:
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if size else np.zeros(0, np.int64)
            length = np.diff(np.append(cut, size))
            per = -(-length // _NODE)
            first = np.repeat(cut, per) + _NODE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            if not first.size:
                break
            both, either = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first)
            owner_next = owner[first]
            last = np.append(first[1:], size)
            self.levels.append((first, last - first, ~(both ^ either), both))
            owner, size = owner_next, first.size
            if (per == 1).all():
                break
        self.owner = owner

    def components(self, max_bits=MAX_BITS):
        """Smallest row of the component of each row, in index order."""
        n = self.values.size
        label = np.arange(n)
        if not n:
            return label
        ends = np.searchsorted(self.owner, self.groups)
        sizes = np.bincount(ends)[ends]
        load = np.cumsum(sizes)
        at = 0
        while at < n:
            # so many queries that their pairs fit into memory even if nothing is pruned
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + _PAIRS, "right")))
            a, b = self._links(np.arange(at, to), ends[at:to], label, max_bits)
            _join(label, a, b)
            at = to
        return label

    def _links(self, queries, nodes, label, max_bits):
        """Pairs of rows within `max_bits`. Nodes of which all rows are in the component of the query are passed over."""
        low, high = label, label
        span = []
        for first, _, _, _ in self.levels:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            span.append((low, high))
        for (first, count, mask, value), (low, high) in zip(reversed(self.levels), reversed(span), strict=True):
            differ = np.bitwise_count((self.values[queries] ^ value[nodes]) & mask[nodes])
            own = label[queries]
            open_ = (differ <= max_bits) & ~((low[nodes] == own) & (high[nodes] == own))
            queries, nodes = queries[open_], nodes[open_]
            count = count[nodes]
            queries = np.repeat(queries, count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            nodes = np.repeat(first[nodes], count) + inner
        near = np.bitwise_count(self.values[queries] ^ self.values[nodes]) <= max_bits
        return queries[near], nodes[near]


def _join(label, a, b):
    """Put the components of linked rows together; every label is the smallest row of its component."""
    while a.size:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        apart = x != y
        if not apart.any():
            return
        a, b, x, y, low = a[apart], b[apart], x[apart], y[apart], low[apart]
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label[:] = jump


def _searched(batches, max_bits):
    """Links (row, smallest row of its local component) of the groups that stand one after another in the batches."""
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        values = np.concatenate([values, batch.column("fingerprint").to_numpy()])
        if not keys.size:
            continue
        done = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if done:
            yield _group_links(keys[:done], values[:done], max_bits)
            keys, values = keys[done:], values[done:]
    yield _group_links(keys, values, max_bits)


def _group_links(keys, values, max_bits):
    index = GrayIndex(keys, values.view(np.uint64))
    label = index.components(max_bits)
    found = np.flatnonzero(label != np.arange(label.size))
    a, b = index.values[found].view(np.int64), index.values[label[found]].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _dealt(rows, level):
    """Four rows per fingerprint: `key` tells the group, `used` the bits in which its rows agree."""
    bits = _LEVELS[level]
    used = "used" in rows.columns

    def deal(batches):
        for batch in batches:
            value = batch.column("fingerprint").to_numpy().view(np.uint64)
            before = batch.column("used").to_numpy().view(np.uint64) if used else np.zeros(value.size, np.uint64)
            key = batch.column("key").to_numpy().view(np.uint64) if used else np.zeros(value.size, np.uint64)
            keys, masks = [], []
            for band in range(4):
                mask = _band(before, band, bits)
                mixed = (key ^ mask) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29)) ^ (value & mask)) * np.uint64(0xBF58476D1CE4E5B9)
                keys.append(mixed ^ (mixed >> np.uint64(32)))
                masks.append(before | mask)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(value.view(np.int64), 4)),
                 pa.array(np.concatenate(masks).view(np.int64))],
                names=["key", "fingerprint", "used"],
            )

    return rows.mapInArrow(deal, "key long, fingerprint long, used long")


def _band(before, band, bits):
    """Mask of the `band`-th run of `bits` bits that are not in `before`, by row."""
    out, taken = np.zeros(before.size, np.uint64), np.zeros(before.size, np.int64)
    for bit in range(64):
        one = np.uint64(1) << np.uint64(bit)
        free = (before & one) == 0
        here = free & (taken // bits == band)
        out[here] |= one
        taken += free
    return out


def links(values, max_bits=MAX_BITS, group_rows=GROUP_ROWS):
    """Links a, b between distinct fingerprints, enough for the same components as all pairs within `max_bits` (up to 3).

    Two groups with the same key by chance are searched as one, which costs time but gives the same links.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("four bands find pairs of up to 3 bits")
    rows, found = values, None
    for level in range(len(_LEVELS)):
        dealt = _dealt(rows, level)
        hot = None
        if level + 1 < len(_LEVELS):
            dealt = written(dealt, "simhash-bands")
            hot = written(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "simhash-hot")
            hot = None if hot.isEmpty() else hot
        small = dealt if hot is None else dealt.join(hot, "key", "left_anti")
        small = small.select("key", "fingerprint").repartition("key").sortWithinPartitions("key")
        part = small.mapInArrow(lambda batches: _searched(batches, max_bits), "a long, b long")
        found = part if found is None else found.union(part)
        if hot is None:
            break
        rows = dealt.join(hot, "key", "left_semi")
    return found


def simhash_groups(docs, id_col="doc_id", text_col="text", max_bits=MAX_BITS, words_per_shingle=SHINGLE_WORDS,
                   group_rows=GROUP_ROWS):
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Texts are compared after lower-casing A-Z; null and empty texts have fingerprint 0 and are linked like others. A null
    id is passed over for component_id, unless there is no other. Repeated rows give repeated rows; other columns are
    not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    smallest = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    roots = components(links(smallest.select("fingerprint"), max_bits, group_rows), "simhash")
    named = smallest.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")
    )
    named = written(named, "simhash-roots")
    least = written(named.groupBy("root").agg(F.min("smallest").alias("component_id")), "simhash-components")
    named = written(named.join(least, "root").select("fingerprint", "component_id"), "simhash-named")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_groups(docs, id_col="doc_id", text_col="text", similarity=0.8):
    """id and component (the smallest id that links reach) of each document, by fingerprints and by verified similarity.

    Fingerprints of 64 bits link texts within 3 bits, which a few changed words exceed. So texts whose five-word shingles
    have a Jaccard coefficient of `similarity` or more are linked too: MinHash bands propose the pairs and the shingles
    decide. Ids must be unique and not null; null and empty texts are linked by their fingerprint, as in simhash_groups.
    """
    prints = simhash_groups(docs, id_col, text_col)
    near = near_documents(docs, id_col, text_col, similarity)
    first = written(near.groupBy("class_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "near-first")
    near = near.join(first, "class_id").select("doc_id", "first")
    links = prints.select("doc_id", F.col("component_id").alias("first")).union(near).where("doc_id <> first")
    # the components run over numbers of the linked ids
    ids = links.select("doc_id").union(links.select("first")).distinct()
    ids = written(numbered(ids, ["doc_id"], "near-ids"), "near-numbers")
    side = lambda name, n: ids.select(F.col("doc_id").alias(name), F.col("number").alias(n))
    links = links.join(side("doc_id", "a"), "doc_id").join(side("first", "b"), "first").select("a", "b")
    roots = components(links, "near").join(side("_id", "node"), "node").join(side("component_id", "root"), "root")
    rows = docs.select(F.col(id_col).alias("doc_id"))
    return rows.join(roots.select(F.col("_id").alias("doc_id"), "component_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
