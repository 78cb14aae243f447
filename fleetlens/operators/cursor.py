"""Paging by cursor: the sort values of the last row become a range filter, so that no page counts the ones before it.

A cursor page is a filter and a top-n. The filter is a comparison of the sort columns in their order, nulls included, and
its bound on the first column is a predicate by itself, which reaches the scan. Rows that tie in the sort columns are
ordered by a hash of the row; of rows that are equal altogether the cursor tells how many were given.

A long page is no top-n, as each task would hold the whole page: its last row is found by counts, and the page is what lies
between the two ends, sorted by all tasks.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetlens.operators.spread import hashable
from fleetlens.session import reliable_checkpoint


@dataclass(frozen=True)
class Cursor:
    """The end of a page: sort values and hash of its last row, and how many rows equal to it were given so far."""

    values: tuple
    row_hash: int
    seen: int


def _sort(df, orders):
    """(sort columns with the hash of the row last, whether each ascends)."""
    ascending = [direction != "desc" for _, direction in orders]
    return [*[F.col(c) for c, _ in orders], F.xxhash64(*hashable(df))], [*ascending, True]


def _after(col, value, ascending):
    """Rows that come after the value: nulls are first where values ascend and last where they descend."""
    if value is None:
        return col.isNotNull() if ascending else F.lit(False)
    return col > F.lit(value) if ascending else (col < F.lit(value)) | col.isNull()


def _bound(col, value, ascending):
    """What holds for all rows from the value on: implied by the rest, but simple enough for a scan to use."""
    if value is None:
        return F.lit(True) if ascending else col.isNull()
    return col >= F.lit(value) if ascending else (col <= F.lit(value)) | col.isNull()


def _at(cols, values):
    """Rows with these values of the sort columns and the hash."""
    out = F.lit(True)
    for c, v in zip(cols, values, strict=True):
        out = out & (c.isNull() if v is None else c.eqNullSafe(F.lit(v)))
    return out


def _directed(cols, ascending):
    return [c.asc() if a else c.desc() for c, a in zip(cols, ascending, strict=True)]


def from_cursor(df, orders, cursor):
    """Condition for the rows from the cursor's row on, that row and its equals included."""
    cols, ascending = _sort(df, orders)
    values = [*cursor.values, cursor.row_hash]
    after = [_after(c, v, a) for c, v, a in zip(cols, values, ascending, strict=True)]
    same = [c.isNull() if v is None else c == F.lit(v) for c, v in zip(cols, values, strict=True)]
    out = F.lit(True)
    for later, equal in zip(after[::-1], same[::-1], strict=True):
        out = later | (equal & out)
    return _bound(cols[0], values[0], ascending[0]) & out


def cursor_page(df, orders, size, cursor=None, top_n=1_000):
    """The next `size` rows, in order, after a cursor (None: from the start). `orders` are (column, "asc" or "desc").

    Pages that need more than `top_n` rows, those equal to the cursor's row included, run the jobs that find their last row
    when the page is asked for. The rows are the same either way.
    """
    if size < 1:
        raise ValueError("a page has one row at least")
    cols, ascending = _sort(df, orders)
    total = _directed(cols, ascending)
    rows, seen = (df, 0) if cursor is None else (df.filter(from_cursor(df, orders, cursor)), cursor.seen)
    if seen + size > top_n:
        return _long_page(rows, orders, size, cursor).orderBy(*total)
    if cursor is None:
        return rows.orderBy(*total).limit(size)
    return rows.orderBy(*total).offset(seen).limit(size)


def _long_page(rows, orders, size, cursor):
    """The rows of a page, in no order, out of those from the cursor's row on."""
    cols, ascending = _sort(rows, orders)
    equal_to = lambda c: rows.filter(_at(cols, [*c.values, c.row_hash]))
    seen = cursor.seen if cursor else 0
    end, equals = _row_at(rows, cols, ascending, seen + size)
    if cursor and end and _same_row(cursor, end):
        return equal_to(end).offset(seen).limit(size)
    # all rows between the ends; of the rows equal to one of the ends a number, as it doesn't matter which of them
    between, parts = rows, []
    if cursor:
        between = between.filter(~_at(cols, [*cursor.values, cursor.row_hash]))
        parts.append(equal_to(cursor).offset(seen))
    if end:
        inside = ~F.coalesce(from_cursor(rows, orders, end), F.lit(False))
        if end.seen == equals:
            inside = inside | _at(cols, [*end.values, end.row_hash])
        else:
            parts.append(equal_to(end).limit(end.seen))
        between = between.filter(inside)
    for part in parts:
        between = between.union(part)
    return between


def _row_at(rows, cols, ascending, place):
    """(cursor at the row with this place in the order, number of rows equal to it), or (None, 0) if there are fewer rows.

    The sort values and hashes are counted, map-side first, range-partitioned and checkpointed; the counts of the partitions,
    one row each, tell which of them is ranked.
    """
    counts, names = _counted(rows, cols)
    total = _directed([F.col(n) for n in names], ascending)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    index = reliable_checkpoint(counts.repartitionByRange(n, *total).withColumn("_part", F.spark_partition_id()))
    start = 0
    for part, held in index.groupBy("_part").agg(F.sum("_n")).orderBy("_part").collect():
        if start + held >= place:
            break
        start += held
    else:
        return None, 0
    w = Window.partitionBy("_part").orderBy(*total).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = index.filter(F.col("_part") == part).withColumn("_upto", F.sum("_n").over(w)).drop("_part")
    *values, row_hash, equals, last = upto.filter(F.col("_upto") >= place - start).orderBy("_upto").first()
    return Cursor(tuple(values), row_hash, place - start - (last - equals)), equals


def _counted(rows, cols):
    """(rows per sort values and hash as `_n`, names of these columns)."""
    names = [f"_{i}" for i in range(len(cols))]
    return rows.groupBy(*[c.alias(n) for c, n in zip(cols, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n")), names


def _same_row(one, other):
    """Whether two cursors stand at equal rows; NaN equals NaN, as in Spark."""
    pairs = zip((*one.values, one.row_hash), (*other.values, other.row_hash), strict=True)
    return all(a == b or (a != a and b != b) for a, b in pairs)


def next_cursor(page, orders, cursor=None):
    """The cursor after a page, or None for an empty page. Only the sort values of its last row come to the driver."""
    cols, ascending = _sort(page, orders)
    counts, names = _counted(page, cols)
    # nulls are first where values ascend and last where they descend, in both directions
    last = counts.orderBy(*_directed([F.col(n) for n in names], [not a for a in ascending])).limit(1).collect()
    if not last:
        return None
    *values, row_hash, equals = last[0]
    out = Cursor(tuple(values), row_hash, equals)
    before = cursor.seen if cursor and _same_row(cursor, out) else 0
    return Cursor(out.values, out.row_hash, before + equals)
