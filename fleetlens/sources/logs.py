"""Log lines of pods."""

from pyspark.sql import functions as F

from fleetlens.operators.changes import tail as last_lines
from fleetlens.schemas import MAIN_CONTAINER


def read_log_lines(lines, now=None, since_sec=None, tail=None, keys=("pod",), order=("line",), ts="ts",
                   container=MAIN_CONTAINER, container_col="container"):
    """Lines since so many seconds and / or the last n lines per pod.

    Lines with a container column are those of the main container, unless `container` names another one or is None (all).
    """
    out = lines
    if container is not None and container_col in lines.columns:
        out = out.filter(F.col(container_col) == container)
    if since_sec is not None:
        out = out.filter(F.col(ts) >= F.lit(now) - F.expr(f"interval {int(since_sec)} seconds"))
    return last_lines(out, list(keys), list(order), tail) if tail is not None else out


def explode_lines(docs, keys, text="text"):
    """One row per line of a multi-line text, with its position. A text may be long, but it is one row already."""
    lines = F.posexplode(F.split(text, "\n")).alias("line", "text")
    return docs.select(*keys, lines)


def follow_log(spark, path):
    """Unbounded stream of the lines of all files in a folder, with the file they come from."""
    stream = spark.readStream.format("text").load(path)
    return stream.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
