"""Exact dedup by deterministic block naming. DataFrame functions only.

The normalised text is cut into blocks of fixed size. Equal blocks get the same integer name, different ones different
names. Then the names of adjacent pairs get names in the same way, until one name per document is left. Two documents
are equal if and only if they have the same number of blocks and the same last name.
"""

from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, written

BLOCK_BYTES = 8192


def _names(df, keys, name):
    """Integer names of the distinct keys: dealt out by their hash, sorted, numbered in that order, and written at once."""
    names = df.select(*keys).distinct().sortWithinPartitions(*keys)
    return written(names.withColumn("name", F.monotonically_increasing_id()), name)


def _block_names(blocks, rows, key):
    """Names of the blocks, joined to `rows` (`key` and the hash of the block, not the block).

    Every distinct block is compared by its bytes when the names are made. Where a hash has one block only, the hash
    finds its name; where blocks share a hash, the bytes do.
    """
    names = blocks.select("hash", "block").distinct().sortWithinPartitions("hash", "block")
    names = names.withColumn("name", F.monotonically_increasing_id())
    names = written(
        names.groupBy("hash").agg(F.min("name").alias("name"), F.count("*").alias("contents")), "block-names"
    )
    found = rows.join(names.where("contents = 1").select("hash", "name"), "hash").drop("hash")
    shared = names.where("contents > 1").select("hash")
    if shared.isEmpty():
        return found
    twice = written(blocks.join(shared, "hash", "left_semi").distinct(), "shared-hashes")
    other = _names(twice, ["hash", "block"], "block-names").withColumn("name", -1 - F.col("name"))
    other = twice.join(other, ["hash", "block"]).select([F.col(c).alias(f"_{c}") for c in [*key, "hash"]] + ["name"])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "hash"]]
    return found.unionByName(rows.join(other, same).select(*found.columns))


def block_identities(docs, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES, hash_of=F.xxhash64):
    """One row per distinct (id, text): `id`, `sha256` of the normalised text, `copies`, and the identity `blocks`, `name`.

    Null texts count as empty; an empty text is one empty block. Rows that repeat id and text are counted in `copies`.
    """
    text = ascii_lower(F.col(text_col)).cast("binary")
    cut = docs.select(F.col(id_col).alias("id"), text.alias("bytes"))
    size = F.octet_length("bytes")
    count = F.greatest(F.lit(1), F.ceil(size / block_bytes).cast("int"))
    cut = cut.select("id", "bytes", count.alias("blocks"), F.sha2("bytes", 256).alias("sha256"))
    block = F.expr(f"substring(bytes, pos * {block_bytes} + 1, {block_bytes})")
    blocks = (
        cut.select("id", "sha256", "blocks", "bytes", F.explode(F.expr("sequence(0, blocks - 1)")).alias("pos"))
        .select("id", "sha256", "blocks", "pos", block.alias("block"))
        .withColumn("hash", hash_of("block"))
    )
    place = ["id", "sha256", "blocks", "pos"]
    rows = written(blocks.groupBy(*place, "hash").agg(F.count("*").alias("copies")), "block-rows")
    level = written(_block_names(blocks, rows, place), "block-level")

    done, depth = [], 0
    key = ["id", "sha256", "blocks", "copies"]
    while True:
        # documents of `most` blocks or fewer are down to one name
        most = 1 << depth
        done.append(level.where((F.col("blocks") <= most) & (F.col("blocks") > most // 2)).select(*key, "name"))
        rest = level.where(F.col("blocks") > most)
        if rest.isEmpty():
            break
        pairs = rest.groupBy(*key, F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        # an odd last name stays alone; no name is this low
        pairs = written(pairs.withColumn("right", F.coalesce("right", F.lit(-(1 << 62)))), "block-pairs")
        names = _names(pairs, ["left", "right"], "pair-names")
        level = written(pairs.join(names, ["left", "right"]).drop("left", "right"), "block-level")
        depth += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES):
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null is the empty text. Of equal texts the largest
    id stays; a null id is smaller than any other. If rows repeat the id that stays, the first of them is kept. Other
    columns are not read. An empty table gives an empty result.
    """
    found = written(block_identities(docs, id_col, text_col, block_bytes), "identities")
    groups = written(
        found.groupBy("blocks", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")),
        "identity-groups",
    )
    rows = found.join(groups, ["blocks", "name"])
    # rows that repeat id and text come back one by one
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
