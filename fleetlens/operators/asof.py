"""As-of join: each row with the last row of another table that is not after it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.spread import cut, hot_table, ordinary


def asof_join(left, right, keys, order, cols, ties=(), name="asof", rows=None):
    """Add a struct `name` with `cols` of the last row of `right` that has the same keys and whose `order` is not after
    that of the row; null if there is none.

    Both tables have the columns `keys` and `order`. A row of `right` with the same order counts as before; of several rows
    of `right` with equal order the last one by `ties`, then by a hash of the row, is taken. Rows of `right` with a null key
    or order match nothing. Every row of `left` comes out once.

    The tables are united and sorted once, so a key with many rows on both sides costs their sum, not their product. A hot
    key is cut into slices; of the slices before it a slice has to know one row.
    """
    ties = list(ties)
    known = F.lit(True)
    for c in (*keys, *order):
        known = known & F.col(c).isNotNull()
    tied = F.struct(*ties, F.xxhash64(*[c for c in right.columns if "map<" not in right.schema[c].dataType.simpleString()]))
    there = right.filter(known).select(*keys, *order, F.struct(*cols).alias(name), F.lit(0).alias("_side"), tied.alias("_ties"))
    both = left.withColumn("_side", F.lit(1)).unionByName(there, allowMissingColumns=True)
    sort = [*order, "_side", "_ties"]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(name, ignorenulls=True)
    plain = lambda x: x.withColumn(name, last.over(upto(Window.partitionBy(*keys).orderBy(*sort))))
    done = lambda x: x.filter("_side = 1").select(*left.columns, name)
    hot = hot_table(both, keys, rows)
    if hot is None:
        return done(plain(both))
    x = cut(both, keys, sort, rows, hot)
    tail = F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*sort, "_tie")))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = x.groupBy(*keys, "_slice").agg(tail.alias("_tail")).select(
        *keys, "_slice", F.last("_tail", ignorenulls=True).over(before).alias(name), F.lit(0).alias("_own"))
    slices = x.withColumn("_own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_own", *sort, "_tie")
    split = slices.withColumn(name, last.over(upto(w)))
    return done(plain(ordinary(both, keys, hot))).unionByName(done(split))
