"""Change detection along the order of a key."""

from pyspark.sql import functions as F

from fleetlens.operators.spread import newest_rows, with_previous
from fleetlens.session import reliable_checkpoint


def set_fingerprint(df, group, cols):
    """Order-free fingerprint of the set of rows per group: two hashes and the number of distinct rows.

    Leave the ingest time out of `cols`. Rows are reduced to their hashes before the shuffle.
    """
    return fingerprint_of(row_hashes(df, group, cols), group)


def row_hashes(df, group, cols):
    return df.select(*group, F.xxhash64(*cols).alias("_h1"), F.hash(*cols).alias("_h2"))


def fingerprint_of(hashed, group):
    return hashed.distinct().groupBy(*group).agg(
        F.bit_xor("_h1").alias("hash1"), F.bit_xor("_h2").alias("hash2"), F.count(F.lit(1)).alias("members")
    )


# 2**64: sums of hashes wrap here, so that they can be added in any order and grouping
_WRAP = f"CAST({1 << 64} AS DECIMAL(20, 0))"


def multiset_fingerprint(df, group, cols, key=None):
    """Order-free fingerprint of the rows per group, repeated rows counted: `hash1` and `hash2` (sums of 64-bit hashes that
    wrap at 2**64) and `members`. Fingerprints of parts of a group add up by `merge_fingerprints`.

    With `key`, rows of a group that repeat the key within `df` count once (polls that were delivered twice).
    """
    if key:
        df = df.dropDuplicates([*group, *key])
    hashed = df.select(
        *group, F.xxhash64(*cols).cast("decimal(20,0)").alias("hash1"),
        F.xxhash64(F.lit("second"), *cols).cast("decimal(20,0)").alias("hash2"), F.lit(1).cast("bigint").alias("members"),
    )
    return merge_fingerprints(hashed, group)


def merge_fingerprints(prints, group):
    """One fingerprint per group from those of its parts."""
    wrapped = lambda c: F.expr(f"CAST(pmod(sum({c}), {_WRAP}) AS DECIMAL(20, 0))").alias(c)
    return prints.groupBy(*group).agg(wrapped("hash1"), wrapped("hash2"), F.sum("members").alias("members"))


def only_multiset_changes(df, keys, order, cols, key=None, rows=None):
    """Snapshots (keys, order) whose rows, repeated ones counted, differ from those of the snapshot before."""
    return changed_prints(multiset_fingerprint(df, [*keys, *order], cols, key), keys, order, rows)


def only_changes(df, keys, order, cols, rows=None):
    """Rows whose `cols` differ from the previous row of the same key; the first row always counts."""
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    out = with_previous(df, keys, order, cols, rows=rows)
    return out.filter(F.col("_prev").isNull() | ~same).drop("_prev")


def only_set_changes(df, keys, order, cols, rows=None):
    """Snapshots (keys, order) whose set of rows differs from the snapshot before.

    The fingerprints, one row per snapshot, are checkpointed, as they are looked at several times.
    """
    return changed_prints(set_fingerprint(df, [*keys, *order], cols), keys, order, rows)


def changed_prints(prints, keys, order, rows=None):
    """Fingerprints that differ from the one before of their keys."""
    return only_changes(reliable_checkpoint(prints), keys, order, ["hash1", "hash2", "members"], rows=rows)


def first_of_error_runs(df, keys, order, is_error, message, rows=None):
    """Errors whose message differs from the error before. Successes in between do not count."""
    return only_changes(df.filter(is_error), keys, order, [message], rows=rows)


def tail(df, keys, order, n, rows=None):
    """The last n rows per key."""
    return newest_rows(df, keys, order, n, rows=rows)


def first_of(df, keys, order):
    """The first row per key."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


