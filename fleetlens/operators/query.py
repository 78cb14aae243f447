"""Filters, sorting and paging over current tables."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetlens.functions.columns import all_of, enum_ordinal
from fleetlens.functions.keys import CLUSTER, JOB
from fleetlens.operators.spread import hashable
from fleetlens.schemas import JOB_STATES
from fleetlens.session import reliable_checkpoint

DEFAULT_PAGE_SIZE = 10


@dataclass(frozen=True)
class JobFilter:
    """Clauses are joined by AND. An empty set or a missing value means that there is no such clause."""

    clusters: frozenset = frozenset()
    job_ids: frozenset = frozenset()
    name_contains: str | None = None
    states: frozenset = frozenset()
    begin: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class PageRequest:
    number: int = 1
    size: int = DEFAULT_PAGE_SIZE
    orders: tuple = field(default=())

    def safe(self):
        """Page 1 and the default size stand in for values that are not positive."""
        return PageRequest(
            self.number if self.number > 0 else 1,
            self.size if self.size > 0 else DEFAULT_PAGE_SIZE,
            self.orders,
        )

    @property
    def offset(self):
        return (self.number - 1) * self.size

    @property
    def is_head(self):
        return self.number == 1


def in_set(cols, values):
    """Membership of a column, or of several columns together, in a set of literals; no values means no filter."""
    if not values:
        return F.lit(True)
    if len(cols) == 1:
        return F.col(cols[0]).isin(*sorted(values))
    return F.struct(*[F.col(c) for c in cols]).isin(
        *[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, cols)]) for row in sorted(values)]
    )


def keep_keys(df, wanted, keys):
    """Membership in a table of keys, for sets that are too large for literals."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def contains_text(col, text):
    """Case-sensitive literal substring; `%` and `_` have no special meaning."""
    return F.lit(True) if text is None else F.col(col).contains(text)


def ts_range(col, begin=None, end=None):
    """begin <= value < end, either side may be open."""
    parts = []
    if begin is not None:
        parts.append(F.col(col) >= begin)
    if end is not None:
        parts.append(F.col(col) < end)
    return all_of(parts)


def select_jobs(jobs, flt):
    """Jobs that meet all clauses of the filter. Every clause reaches the Parquet scan."""
    out = jobs
    if flt.clusters:
        # the single columns prune row groups, the pair makes it exact
        out = out.filter(F.col(CLUSTER[0]).isin(*sorted({c for c, _ in flt.clusters})))
        out = out.filter(F.col(CLUSTER[1]).isin(*sorted({n for _, n in flt.clusters})))
        out = out.filter(in_set(CLUSTER, flt.clusters))
    if flt.job_ids:
        out = out.filter(in_set(["job_id"], flt.job_ids))
    if flt.states:
        out = out.filter(in_set(["state"], flt.states))
    if flt.name_contains is not None:
        out = out.filter(contains_text("job_name", flt.name_contains))
    if flt.begin is not None or flt.end is not None:
        out = out.filter(ts_range("start_ts", flt.begin, flt.end))
    return out


def remove_where(df, predicate):
    """Drop the rows that meet the predicate; a null predicate keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def with_broken_rules(df, rules):
    """All rows, with the names of the rules that they break: `rules` maps a name to a condition that good rows meet.

    One read serves both sides when the result is written partitioned by `size(broken_rules) = 0`.
    """
    broken = F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    return df.withColumn("broken_rules", F.array_compact(broken))


def quarantine(df, rules):
    """(good, bad) as two frames; each reads the input, so use `with_broken_rules` where both are wanted."""
    bad = with_broken_rules(df, rules).filter(F.size("broken_rules") > 0)
    return df.filter(all_of(rules.values())), bad


_SORT_FIELDS = {
    "jobName": lambda: F.col("job_name"),
    "jobState": lambda: enum_ordinal(F.col("state"), JOB_STATES),
    "startTs": lambda: F.col("start_ts"),
}


def order_columns(orders, ties=tuple(JOB)):
    """Sort columns for (field, asc | desc) terms; the keys break ties, so that the order is total."""
    cols = []
    for name, direction in orders:
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown direction {direction!r}")
        col = _SORT_FIELDS[name]()
        cols.append(col.desc() if direction == "desc" else col.asc())
    return cols + [F.col(t).asc() for t in ties]


def sort_by(df, orders=(), ties=tuple(JOB)):
    return df.orderBy(*order_columns(orders, ties))


# Natural order of the tables.
CANONICAL_ORDERS = {
    "job": JOB,
    "cluster": CLUSTER,
    "k8s_ref": ["namespace", "cluster_id"],
    "member": ["tid"],
    "object": ["name"],
    "job_metrics": ["job_id"],
    "member_metrics": ["tid"],
    "pod_metrics": ["name"],
}


def canonical_order(df, kind):
    return df.orderBy(*CANONICAL_ORDERS[kind])


def list_all(jobs):
    """All jobs of all clusters in natural order."""
    return canonical_order(jobs, "job")


def page(df, req, orders, top_n=1_000):
    """One page of a total order. Pages that end within `top_n` rows are a top-n, in which each task hands on that many
    rows; deeper ones are ranked, so that their offset never passes through one task.

    Both give the same rows. `orders` needs to name neither all columns nor unique ones: what ties in them is ordered by a
    hash of the row, so that only rows that are equal can change places.
    """
    req = req.safe()
    total = [*orders, F.xxhash64(*hashable(df))]
    if req.offset + req.size <= top_n:
        return df.orderBy(*total).offset(req.offset).limit(req.size)
    return _ranked_page(df, req, total)


def _ranked_page(df, req, orders):
    """The rows are range-partitioned and checkpointed once and counted per partition; only the partitions that the
    page touches are ranked. This runs the job of the checkpoint when the page is asked for."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    index = reliable_checkpoint(df.repartitionByRange(n, *orders).withColumn("_part", F.spark_partition_id()))
    counts = index.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per partition of the shuffle: a fixed, small number
    starts = counts.withColumn("_start", F.coalesce(before, F.lit(0)))
    first, last = req.offset, req.offset + req.size
    touched = starts.filter((F.col("_start") < last) & (F.col("_start") + F.col("_n") > first))
    ranked = index.join(F.broadcast(touched), "_part").withColumn(
        "_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*orders))
    )
    out = ranked.filter((F.col("_rank") > first) & (F.col("_rank") <= last))
    return out.orderBy("_rank").select(*df.columns)


def with_place(df, orders, name="place"):
    """Add the place (from 1) of each row in a total order, by the row counts of a range-partitioned checkpoint."""
    total = [*orders, F.xxhash64(*hashable(df))]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    index = reliable_checkpoint(df.repartitionByRange(n, *total).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = index.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*total))
    return index.join(F.broadcast(starts), "_part").withColumn(name, place.cast("bigint")).drop("_part", "_start")


def page_envelope(df, req):
    """Totals of a paged query as one row."""
    req = req.safe()
    total = df.agg(F.count(F.lit(1)).alias("total_ele"))
    pages = F.ceil(F.col("total_ele") / F.lit(req.size)).cast("bigint")
    return total.select(
        "total_ele",
        pages.alias("total_page"),
        F.least(F.lit(req.size), F.greatest(F.lit(0), F.col("total_ele") - req.offset)).cast("bigint").alias("size"),
        F.lit(req.number).cast("bigint").alias("pag_num"),
        F.lit(req.size).cast("bigint").alias("pag_size"),
        (F.lit(req.number) < pages).alias("has_next"),
        F.lit(req.number > 1).alias("has_prev"),
    )


def select_all(jobs, flt, orders=()):
    return sort_by(select_jobs(jobs, flt), orders)


def select_page(jobs, flt, req):
    """(rows of the page, envelope) of a filtered and sorted query."""
    hits = select_jobs(jobs, flt)
    return page(hits, req, order_columns(req.orders)), page_envelope(hits, req)


def states_of(jobs, cluster_id, namespace, job_id=None):
    """Job id and state of one cluster, or of one job."""
    out = jobs.filter((F.col("cluster_id") == cluster_id) & (F.col("namespace") == namespace))
    if job_id is not None:
        out = out.filter(F.col("job_id") == job_id)
    return out.select("job_id", "state")
