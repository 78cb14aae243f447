"""Corpus pipeline: language, exact copies, near copies, test items, mixing. Each stage works on what the last one kept."""

from pyspark.sql import functions as F

from fleetlens.llm import block_naming, decontaminate, language_id, mixing, simhash
from fleetlens.llm.common import free_name, read_table, with_places, written

#: no SQL says the same as stages 1, 3 and 5; tests/llm compares all of them with brute force
ORACLE_SQL = None


def language_stage(spark, docs, sf_dir):
    """Documents without a letter, or whose text fits no language profile, go. Profiles are learned from `docs`.

    Null and empty texts go. Where no text has a language, all texts with a letter stay. Repeated rows go or stay together;
    an empty table stays empty.
    """
    return language_id.keep_identified(docs)


def _numbered_rows(docs, name):
    """(the stage's input, its column with a number of its own for each row), as ids may be null or repeat.

    A table is read again, with its places as numbers; only other frames are copied to have numbers that stay.
    """
    row = free_name(docs, "row")
    rows = with_places(docs, row)
    if rows is None:
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), name)
    return rows, row


def _rows_left(rows, kept, row):
    return rows.join(kept.withColumnRenamed("kept_row", row), row, "left_semi").drop(row)


def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts (A-Z lower-cased) one row stays, the one with the largest id; a null id is smaller than any other.

    Null and empty texts are equal to each other. An empty table stays empty; columns of any name are passed on.
    """
    rows, row = _numbered_rows(docs, "exact-rows")
    keyed = rows.select(F.struct(F.col("doc_id"), F.col(row).alias("row")).alias("key"), "text")
    kept = block_naming.exact_dedup(keyed, id_col="key").where("kept").select(F.col("doc_id.row").alias("kept_row"))
    return _rows_left(rows, kept, row)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each group of near copies one row stays, the one with the smallest id; a null id comes after all others.

    Near are texts whose fingerprints differ in 3 bits or fewer, and texts whose five-word shingles have a Jaccard
    coefficient of 0.8 or more. Texts without words share a fingerprint. An empty table stays empty.
    """
    rows, row = _numbered_rows(docs, "near-rows")
    key = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id"), F.col(row).alias("row"))
    groups = simhash.near_groups(rows.select(key.alias("key"), "text"), id_col="key")
    kept = groups.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias("kept_row"))
    return _rows_left(rows, kept, row)


def decontamination_stage(spark, docs, sf_dir):
    """Passages of test items are cut out; documents that consist of them for the most part go.

    Null texts and texts without a hit stay as they are, all texts if there are no items. Repeated rows are cut alike.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """How many words of each document the mix of the sources takes.

    Texts without words (null ones too) have size 0 and nothing is taken; null sources are one source. Rows that share an
    id are documents of their own; an empty table stays empty.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark, sf_dir):
    """All stages over `documents`, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
