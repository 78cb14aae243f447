"""Existence check of referenced files."""

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import functions as F

from fleetlens.functions.paths import strip_leading_slash
from fleetlens.schemas import OBJECT_STORE_SCHEMES


def list_files(spark, root, depth="recursive"):
    """Paths of all files below a folder, relative to it. Only file metadata is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", depth == "recursive").load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return files.select(F.substr(path, F.lit(len(base) + 1)).alias("object"))


def check_paths(refs, files, col="path"):
    """Add `exists`: is the referenced object, by its exact name, among the files?"""
    held = files.select(F.col("object").alias("_object")).distinct().withColumn("_held", F.lit(True))
    out = refs.withColumn("_object", strip_leading_slash(F.col(col))).join(held, "_object", "left")
    return out.withColumn("exists", F.coalesce("_held", F.lit(False))).drop("_object", "_held")


# Names that a task asks the store for at a time.
LOOKUP_NAMES = 1000


def _held_names(batches, root):
    """Those of the names that are files below the root."""
    store, base = stores.FileSystem.from_uri(root)
    for batch in batches:
        for start in range(0, batch.num_rows, LOOKUP_NAMES):
            names = batch.column(0).slice(start, LOOKUP_NAMES).to_pylist()
            infos = store.get_file_info([f"{base.rstrip('/')}/{n}" for n in names])
            held = [n for n, info in zip(names, infos) if info.type == stores.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["object"])


def _uri(root):
    """A root as the store library takes it: a URI, with one scheme for object stores."""
    scheme, _, rest = root.rpartition("://")
    if not scheme:
        return f"file://{rest}" if rest.startswith("/") else rest
    return f"s3://{rest}" if scheme in OBJECT_STORE_SCHEMES else root


def check_objects(refs, root, col="path", tasks=200):
    """Add `exists` by asking the store for each referenced object, from `tasks` tasks; nothing is listed.

    The work grows with the distinct references, not with what the store holds. A null path, and a name with an empty, `.`
    or `..` part, doesn't exist. `root` is a path or URI that the tasks can reach.
    """
    name = strip_leading_slash(F.col(col))
    whole = ~F.concat(F.lit("/"), name, F.lit("/")).rlike(r"/\.{0,2}/")
    # few bytes but a round trip per name, so the number of tasks is given rather than found by size
    names = refs.select(name.alias("object")).filter(whole).distinct().repartition(tasks, "object")
    uri = _uri(root)
    return check_paths(refs, names.mapInArrow(lambda batches: _held_names(batches, uri), "object STRING"), col)
