"""Splitting of hot groups.

One key may hold a large share of all rows, so nothing here puts a whole group into one task. Whether a key is hot is
decided by its counted rows alone: one job counts the rows per key (combined map-side, keys only) when an operator is
built. Without a hot key the plain window or join is used. With one, the rows of the hot keys are range-partitioned once
by key and order, with splitters from a sample, and written; each slice is worked on by itself, and what a slice has to
know of the ones before it is one row per slice. Results never depend on which keys are split. There is no limit on the
number of hot keys: at most total rows / `rows` keys can be hot, and the join with them has no hint.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.session import run_dir

HOT_ROWS = 1_000_000


def hashable(df):
    """The columns that Spark can hash: all but those with a map inside."""
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def _on(left, right, keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_hot_{k}"])
    return cond


def hot_keys(df, keys, rows=HOT_ROWS):
    """The keys with more than `rows` rows: `_hot_<key>` and `_rows`."""
    counts = df.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > rows)


def _written(df, name):
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_table(df, keys, rows):
    """The hot keys as a table in the shared folder, or None if there are none."""
    hot = hot_keys(df, keys, HOT_ROWS if rows is None else rows)
    return None if hot.isEmpty() else _written(hot, "hot-keys")


def cut(df, keys, order, rows, hot):
    """The rows of hot keys with `_tie` and `_slice`, written to the shared folder.

    The number of the slice grows with the order of the rows of a key. Slices are of about equal size; only rows that
    are equal in all hashable columns can't be told apart and stay together.
    """
    total = hot.agg(F.sum("_rows")).first()[0]
    # for a small `rows` no more slices than a shuffle has partitions anyway
    usual = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total / HOT_ROWS))
    slices = max(2, min(usual, math.ceil(2 * total / (rows or HOT_ROWS))))
    x = df.join(hot, _on(df, hot, keys)).drop(*[f"_hot_{k}" for k in keys], "_rows")
    x = x.withColumn("_tie", F.xxhash64(*hashable(df)))
    x = x.repartitionByRange(slices, *keys, *order, "_tie")
    return _written(x.withColumn("_slice", F.spark_partition_id()), "slices")


def ordinary(df, keys, hot):
    """The rows of all keys that are not hot."""
    return df.join(hot, _on(df, hot, keys), "left_anti")


def with_previous(df, keys, order, cols, name="_prev", rows=None):
    """Add a struct with `cols` of the previous row of the same key (null for the first row).

    The last row of each slice of a hot key is carried over to its next slice as an extra row.
    """
    hot = hot_table(df, keys, rows)
    packed = F.struct(*cols)
    plain = lambda x: x.withColumn(name, F.lag(packed).over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is None:
        return plain(df)
    x = cut(df, keys, order, rows, hot)
    kept = list(dict.fromkeys([*order, *cols, "_tie"]))
    tails = x.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*kept), F.struct(*order, "_tie")).alias("_tail"))
    after = F.lead("_slice").over(Window.partitionBy(*keys).orderBy("_slice"))
    carried = (
        tails.withColumn("_slice", after)
        .filter(F.col("_slice").isNotNull())
        .select(*keys, "_slice", *[F.col(f"_tail.{c}").alias(c) for c in kept if c not in keys],
                F.lit(True).alias("_carried"))
    )
    both = x.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    # a carried row comes before all rows of the slice, also before those that are equal to it
    w = Window.partitionBy(*keys, "_slice").orderBy(*order, "_tie", F.desc("_carried"))
    split = both.withColumn(name, F.lag(packed).over(w)).filter(~F.col("_carried")).drop("_carried", "_slice", "_tie")
    return plain(ordinary(df, keys, hot)).unionByName(split)


def with_rank(df, keys, order, name="_rank", rows=None):
    """Add the row number within the key. A hot key is numbered slice by slice, each from where the last one ended."""
    hot = hot_table(df, keys, rows)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if hot is None:
        return df.withColumn(name, number)
    return ordinary(df, keys, hot).withColumn(name, number).unionByName(_ranked_slices(df, keys, order, name, rows, hot))


def _ranked_slices(df, keys, order, name, rows, hot):
    x = cut(df, keys, order, rows, hot)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one extra row per slice brings the number of rows before the slice
    starts = (
        x.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_count"), F.lit(0).alias("_row"))
    )
    both = x.withColumns({"_count": F.lit(1).cast("bigint"), "_row": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_row", *order, "_tie")
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumn(name, F.sum("_count").over(w)).filter("_row = 1")
    return ranked.drop("_count", "_row", "_slice", "_tie")


def newest_rows(df, keys, order, n, rows=None):
    """The last n rows per key. Hot keys are ranked slice by slice, so that n may be of any size."""
    newest_first = [F.desc(c) for c in order]
    hot = hot_table(df, keys, rows)
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    last = lambda x: x.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
    if hot is None:
        return last(df)
    split = _ranked_slices(df, keys, newest_first, "_rank", rows, hot).filter(F.col("_rank") <= n).drop("_rank")
    return last(ordinary(df, keys, hot)).unionByName(split)


def spread_join(big, small, keys, spread, how="inner", rows=None):
    """Join on keys of which some are hot in `big` while `small` holds few rows per key.

    A hot key gets one salt for each `rows` of its rows in `big`, dealt out by the `spread` columns, and its rows in `small`
    are repeated once per salt. All other keys are joined as usual. Null keys never match, as in any equi join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    rows = HOT_ROWS if rows is None else rows
    hot = hot_table(big.filter(F.col(keys[0]).isNotNull()), keys, rows)
    if hot is None:
        return big.join(small, list(keys), how)
    salts = F.coalesce(F.ceil(F.col("_rows") / F.lit(rows)), F.lit(1)).cast("bigint")
    salted = lambda df: df.join(hot, _on(df, hot, keys), "left").withColumn("_salts", salts).drop(
        *[f"_hot_{k}" for k in keys], "_rows")
    left = salted(big).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_salts"))).drop("_salts")
    right = salted(small).withColumn("_salt", F.explode(F.expr("sequence(0L, _salts - 1)"))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
