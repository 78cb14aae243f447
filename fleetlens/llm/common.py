"""Helpers of the text operators: written tables, row numbers, words in bounded pieces, components of links."""

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetlens.session import run_dir

# bytes of one text that are turned into words or symbols at a time
PIECE_BYTES = 1 << 20

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table: A-Z become a-z; ASCII bytes that are neither letters nor digits become blanks
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: bytes.translate table: A-Z become a-z, nothing else changes (bytes.split cuts at blanks and tab to carriage return)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df, name):
    """The rows as a table in the shared folder. Cuts lineage in a way that a lost executor does not hurt."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_places(df, name):
    """The frame with a hash of each row's file and place in it as column `name`, or None where there are no such places.

    They are had where the frame reads Parquet files and does nothing else, so that each read gives the same rows and places
    (a limit or sample might not), and no two rows share a hash (as they do where a file is read twice).
    """
    if not df._jdf.queryExecution().analyzed().children().isEmpty():
        return None
    try:
        place = df.metadataColumn("_metadata")
        rows = df.withColumn(name, F.xxhash64(place["file_path"], place["row_index"]))
    except AnalysisException:  # not a table of files, or not in Parquet
        return None
    twice = rows.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return rows if twice.isEmpty() else None


def free_name(df, name):
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(spark, path):
    """Delete a folder below the shared one that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def ascii_lower(text):
    """Lower-case A-Z only. The fast way of `lower` is taken where all characters are ASCII, as both are equal there."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())
    )


def numbered(df, order, name, number="number"):
    """Number the rows 0, 1, ... along `order`, by a range sort and the row counts of its partitions (no single task)."""
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ids = written(ids, name).withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["n"]) for r in ids.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    # one row per partition of the sort
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    ids = ids.join(starts, "_part")
    return ids.withColumn(number, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at")


def pieces(data, table, size=PIECE_BYTES):
    """Lists of the words of `data` (bytes), translated by `table`, for about `size` bytes at a time.

    A word longer than a piece stays whole.
    """
    if len(data) <= size:
        yield data.translate(table).split()
        return
    rest, at = b"", 0
    while at < len(data):
        part = data[at : at + size].translate(table)
        at += size
        words = (rest + part if rest else part).split()
        rest = b""
        if at < len(data) and words and not part[-1:].isspace():
            rest = words.pop()
        yield words
    if rest:
        yield [rest]


def text_bytes(column):
    """The texts of an Arrow column, one at a time, as UTF-8 bytes; None for null."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py()


def signed(values):
    """Unsigned 64-bit numbers as the signed ones of Spark's long."""
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def components(links, name, a="a", b="b"):
    """Smallest reachable node of every node of the links (two long columns).

    Each round takes the smallest label among the neighbours and then the label of that label, which halves the
    remaining distance, so that the number of rounds grows with the logarithm of the longest path. Labels are written
    after each round; only the number of changed labels reaches the driver.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = written(edges.union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = (
            edges.join(labels.select(F.col("a").alias("b"), "label"), "b")
            .groupBy("a").agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        step = written(step, f"{name}-step")
        jump = step.select(F.col("a").alias("next"), F.col("next").alias("far"))
        new = written(
            step.join(jump, "next").select("a", F.col("label").alias("old"), F.least("next", "far").alias("label")),
            f"{name}-labels",
        )
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("a", "label")
        if not changed:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("root"))
