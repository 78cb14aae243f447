"""Composite identity keys: cluster (cluster_id, namespace), job and worker keys below a cluster."""

from pyspark.sql import functions as F

CLUSTER = ["cluster_id", "namespace"]
JOB = [*CLUSTER, "job_id"]
MEMBER = [*CLUSTER, "tid"]

# Prefixes of the encoded keys, one per kind of state.
KEY_PREFIXES = ["clOv", "jmMt", "jobMt", "jobOv", "podMt", "k8R", "tmDt", "tmMt"]


def key(cols):
    """One struct per key; structs compare and sort field by field."""
    return F.struct(*cols)


def show_key(labels):
    """Display text `label=value, ...` from (label, column) pairs."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{label}="), F.col(c)) for label, c in labels])


def encode_key(prefix, cols):
    """`prefix@part@part`. A null part gives null, so that no key is silently shortened."""
    parts = [F.col(c).cast("string") for c in cols]
    return F.concat(F.lit(prefix), *[F.concat(F.lit("@"), p) for p in parts])


def decode_key(col, index):
    """Part `index` of an encoded key (1 = cluster, 2 = namespace)."""
    return F.get(F.split(F.col(col), "@"), F.lit(index))


def key_rows(df, prefix, cols=tuple(CLUSTER), col="key"):
    """Rows with their encoded key and the parts read back from it."""
    out = df.withColumn(col, encode_key(prefix, cols))
    return out.withColumns({f"{c}_part": decode_key(col, i + 1) for i, c in enumerate(cols)})


def under_cluster(df, cluster_id, namespace, cols=tuple(CLUSTER)):
    """Rows of one cluster: plain equality, so that it reaches the Parquet scan."""
    return df.filter((F.col(cols[0]) == cluster_id) & (F.col(cols[1]) == namespace))
