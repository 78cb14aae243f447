"""Mixing sources to target weights.

The words of a source form one stream (documents in hashed order) that is cut into blocks of fixed length. The mix is a
row of slots in output shards. Each source has as many slots as its target needs; a pseudorandom permutation deals the
slots of all sources over the shards, so that the counts of a shard are a multinomial draw, conditioned on the totals of
the sources. Within a source, slots run through pseudorandom permutations of the block numbers, one for each pass, and
are joined to the blocks by number.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.llm.common import numbered, text_bytes, written

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
SEED = 7

_COUNT_BYTES = 1 << 20
_SLOT_CHUNK = 1 << 16
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def count_words(data):
    """Number of runs of bytes other than blank and tab to carriage return, in pieces of bounded size."""
    n, before = 0, True
    for at in range(0, len(data), _COUNT_BYTES):
        blank = _BLANK[np.frombuffer(data, np.uint8, min(_COUNT_BYTES, len(data) - at), at)]
        n += int(np.count_nonzero(blank[:-1] & ~blank[1:])) + int(before and not blank[0])
        before = bool(blank[-1])
    return n


def document_sizes(docs, id_col="doc_id", text_col="text", source_col="source"):
    """doc_id, source, size (words; null text: 0)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))

    def counted(batches):
        for batch in batches:
            sizes = [count_words(x) if x else 0 for x in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())],
                names=["doc_id", "source", "size"],
            )

    schema = rows.schema.fields
    return rows.mapInArrow(counted, f"doc_id {schema[0].dataType.simpleString()}, source string, size long")


def _starts(df, by, bucket, order, value, name):
    """Sum of `value` over the rows before, along (bucket, order) within `by`; no task gets more than one bucket."""
    earlier = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_total"))
    totals = totals.select(*by, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(earlier), F.lit(0))).join(totals, [*by, bucket])
    return df.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_before", "_within")


def source_targets(sizes, weights=WEIGHTS, share=SHARE, max_passes=MAX_PASSES):
    """One row per source: source, number (by code point, null last), source_size, target.

    The weights repeat along the numbers. A target stops at `max_passes` times the size of its source; what is over goes
    to the other sources by weight. Each round fixes the sources that are over, and only three sums reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("most", max_passes * F.col("source_size")), "sources")
    rate, capped = 0.0, None
    while True:
        full = rate * F.col("weight") >= F.col("most") if rate else F.col("most") == 0
        at = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if at["open"] is None or at["capped"] == capped:
            break
        capped, rate = at["capped"], (share * at["all"] - (at["full"] or 0)) / at["open"]
    target = F.least(F.col("most").cast("double"), F.lit(rate) * F.col("weight")) if at["open"] else F.col("most")
    return sources.select("source", "number", "source_size", target.cast("double").alias("target"))


def permute(values, size, key):
    """Pseudorandom permutation of 0..size-1: Feistel rounds on the next even number of bits, repeated while outside."""
    half = np.uint64(max(1, (int(size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rng = np.random.default_rng([*key])
    keys = rng.integers(1, 1 << 63, 4, dtype=np.uint64)

    def rounds(x):
        left, right = x >> half, x & mask
        for k in keys:
            z = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(29))) & mask)
        return (left << half) | right

    out = rounds(np.asarray(values, np.uint64))
    outside = np.flatnonzero(out >= np.uint64(size))
    while outside.size:
        out[outside] = rounds(out[outside])
        outside = outside[out[outside] >= np.uint64(size)]
    return out.astype(np.int64)


def _slots(batches, block_words, shard_slots, seed):
    for batch in batches:
        for row in batch.to_pylist():
            n, number = row["blocks"], row["number"]
            slot = np.arange(row["low"], row["high"], dtype=np.int64)
            block = np.empty_like(slot)
            for turn in range(int(slot[0] // n), int(slot[-1] // n) + 1):
                here = slot // n == turn
                block[here] = permute(slot[here] - turn * n, n, (seed, number, turn))
            words = np.where(slot == row["slots"] - 1, row["last_words"], block_words)
            place = permute(row["start"] + slot, row["all_slots"], (seed,))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(slot.size, number)), pa.array(block), pa.array(words.astype(np.int64)),
                 pa.array(place // shard_slots), pa.array(place % shard_slots)],
                names=["number", "block", "words", "shard", "slot"],
            )


def mix_slots(targets, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED):
    """The mix as rows number, block, words, shard, slot: the first `words` words of a block stand in a slot of a shard.

    A source has whole passes over its blocks and then so many slots as the rest of its target fills; the last slot is
    cut to what is left. So the words of a source miss its target by less than a block (its last block may be short).
    """
    size, target = F.col("source_size"), F.round("target").cast("long")
    rows = targets.where("source_size > 0").withColumn("turns", F.floor(target / size))
    rows = rows.withColumn("rest", target - F.col("turns") * size)
    rows = rows.withColumn("blocks", F.ceil(size / block_words)).withColumn("more", F.ceil(F.col("rest") / block_words))
    rows = rows.withColumn("slots", F.col("turns") * F.col("blocks") + F.col("more")).withColumn(
        "last_words",
        F.when(F.col("more") > 0, F.col("rest") - (F.col("more") - 1) * block_words).otherwise(F.lit(block_words)),
    )
    rows = rows.where("slots > 0").withColumn("bucket", F.shiftright("number", 12)).withColumn("one", F.lit(0))
    rows = written(_starts(rows, ["one"], "bucket", ["number"], "slots", "start"), "slots")
    total = rows.agg(F.sum("slots")).first()[0] or 0
    chunks = rows.select(
        "number", "blocks", "last_words", "slots", "start", F.lit(total).cast("long").alias("all_slots"),
        F.explode(F.expr(f"sequence(0L, slots - 1, {_SLOT_CHUNK}L)")).alias("low"),
    ).withColumn("high", F.least("slots", F.col("low") + _SLOT_CHUNK))
    chunks = chunks.repartition("number", "low")
    return chunks.mapInArrow(
        lambda batches: _slots(batches, block_words, shard_slots, seed),
        "number long, block long, words long, shard long, slot long",
    )


def packed_documents(sizes, targets):
    """sizes with number, source_size, target and `start`, the place of the document in the word stream of its source."""
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    n = sizes.count()
    # buckets of some thousands of documents, and not too many of them per source either
    buckets = max(1, n // max(2000, int(n**0.5)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    return _starts(rows, ["number"], "bucket", ["doc_id", "size"], "size", "start").drop("bucket")


def _document_blocks(packed, block_words):
    """doc parts by block: `low` and `high` are places within the block."""
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
    return packed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block")).select(
        "*", F.greatest(F.lit(0), F.col("start") - F.col("block") * block_words).alias("low"),
        F.least(F.lit(block_words), end - F.col("block") * block_words).alias("high"),
    )


def mixed_spans(docs, id_col="doc_id", text_col="text", source_col="source", block_words=BLOCK_WORDS,
                shard_slots=SHARD_SLOTS, weights=WEIGHTS, share=SHARE, max_passes=MAX_PASSES, seed=SEED):
    """The mix itself: shard, slot, doc_id, first_word, n_words; the parts of a slot stand in the order of `start`."""
    sizes = written(document_sizes(docs, id_col, text_col, source_col), "sizes")
    targets = written(source_targets(sizes, weights, share, max_passes), "targets")
    parts = _document_blocks(packed_documents(sizes, targets), block_words)
    slots = mix_slots(targets, block_words, shard_slots, seed)
    high = F.least("high", "words")
    return parts.join(slots, ["number", "block"]).where(high > F.col("low")).select(
        "shard", "slot", "start", "doc_id",
        (F.col("block") * block_words + F.col("low") - F.col("start")).alias("first_word"),
        (high - F.col("low")).alias("n_words"),
    )


def mix_sources(docs, id_col="doc_id", text_col="text", source_col="source", block_words=BLOCK_WORDS,
                shard_slots=SHARD_SLOTS, weights=WEIGHTS, share=SHARE, max_passes=MAX_PASSES, seed=SEED):
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, with repeats).

    Null texts have no words; a null source is a source of its own, the last one; an empty table gives an empty result.
    Repeated rows count as documents of their own. Reruns give the same rows. Other columns are not read.
    """
    sizes = written(document_sizes(docs, id_col, text_col, source_col), "sizes")
    targets = written(source_targets(sizes, weights, share, max_passes), "targets")
    packed = written(packed_documents(sizes, targets), "packed")
    # of each block, how often it is taken whole, and the words of the slot that is cut
    takes = mix_slots(targets, block_words, shard_slots, seed).groupBy("number", "block").agg(
        F.count(F.when(F.col("words") == block_words, 1)).alias("whole"),
        F.max(F.when(F.col("words") < block_words, F.col("words"))).alias("cut"),
    )
    takes = written(takes, "takes")
    parts = _document_blocks(packed, block_words).select("number", "block", "start", "low", "high")
    cut = F.greatest(F.lit(0), F.least("high", F.coalesce("cut", F.lit(0))) - F.col("low"))
    taken = parts.join(takes, ["number", "block"]).groupBy("number", "start").agg(
        F.sum(F.col("whole") * (F.col("high") - F.col("low")) + cut).alias("taken")
    )
    # a place in the stream belongs to one document with words, and maybe to others without
    rows = packed.join(taken, ["number", "start"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
