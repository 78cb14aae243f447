"""Current and history tables on Parquet.

A table is a folder with one sub-folder per batch id. A batch is written with overwrite, so a repeated batch gives the
same table, and it counts once its job has committed. Reading merges the batches (last write wins), so an upsert never
rewrites rows that it does not touch; `compact` folds old batches into a base from time to time. A table that only grows
(history) uses `fold` instead, which merges the batches since the last fold and rewrites no older rows.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.keys import CLUSTER, JOB
from fleetlens.operators.state import latest_per_key
from fleetlens.schemas import TASK_STATES


# Name of the batch folders. Spark reads it as a partition column, so no table may have a column of this name.
BATCH = "fleetlens_batch"


# Folders of merged batches, the longest runs first.
FOLDS = ("fold2", "fold1")


class BatchTable:
    """Folder of committed batches below `delta` and, after compaction or folding, below `base`, `fold1` and `fold2`.

    `bloom` names columns whose files get Bloom filters, so that a search for one value skips the row groups without it.
    `row_group` is the size of a row group in bytes (default: that of the session): a task holds one in memory while it
    reads or writes, which matters where rows are whole payloads.
    """

    def __init__(self, spark, path, schema, bloom=(), row_group=None):
        self.spark, self.path, self.schema, self.bloom = spark, path.rstrip("/"), schema, tuple(bloom)
        self.row_group = row_group

    def _committed(self, kind):
        """Ids of the committed batches: a listing of folder names on the driver, one per batch."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        ids = [int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}=")]
        return sorted(i for i in ids if fs.exists(hadoop.Path(f"{self.path}/{kind}/{BATCH}={i}/_SUCCESS")))

    def write(self, df, batch_id, partition_by=(), kind="delta", sort=()):
        # the reader gives the schema, so columns are put into its order and types here
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self._fields()])
        if partition_by:
            # few files per folder; adaptive execution splits a large folder over several tasks
            rows = rows.hint("rebalance", *[F.col(c) for c in partition_by])
        if sort:
            # so that row groups cover few keys and a filter on a key skips most of them
            rows = rows.sortWithinPartitions(*sort)
        writer = rows.write.mode("overwrite").partitionBy(*partition_by)
        for c in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if self.row_group:
            writer = writer.option("parquet.block.size", str(self.row_group))
        writer.parquet(f"{self.path}/{kind}/{BATCH}={batch_id}")

    def _fields(self):
        return self.schema if isinstance(self.schema, T.StructType) else T.StructType.fromDDL(self.schema)

    def read(self, before=None):
        """Rows of all committed batches (with an id below `before`): the newest base, the folds after it, the batches
        after those."""
        below = lambda ids: [i for i in ids if before is None or i < before]
        parts, top = [("base", below(self._committed("base"))[-1:])], -1
        for kind in (*FOLDS, "delta"):
            top = max([top, *parts[-1][1]])
            parts.append((kind, [i for i in below(self._committed(kind)) if i > top]))
        rows = self.spark.createDataFrame([], self._fields())
        for kind, ids in parts:
            if ids:
                rows = rows.unionByName(self._scan(kind, ids))
        return rows

    def read_batch(self, batch_id):
        """The rows of one batch as they were written."""
        return self._scan("delta", [batch_id])

    def _scan(self, kind, ids):
        root = f"{self.path}/{kind}"
        scan = self.spark.read.schema(self._fields()).option("basePath", root)
        return scan.parquet(*[f"{root}/{BATCH}={i}" for i in ids]).select(*self._fields().names)

    def compact(self, batch_id, reduce):
        """Fold all batches up to and including this one into a base with `reduce`.

        What the base before this one had replaced is deleted: a reader that began before this call still finds the
        batches that it has listed.
        """
        before = self._committed("base")[-1:]
        self.write(reduce(self.read(before=batch_id + 1)), batch_id, kind="base")
        if before and before[0] < batch_id:
            self._delete("delta", lambda i: i <= before[0])
            self._delete("base", lambda i: i < before[0])

    def fold(self, batch_id, reduce=lambda df: df, level=1, **layout):
        """Merge the batches since the last fold, up to and including this one, into one folder: fewer and longer files,
        and each row is written once per level. Level 2 merges the folds of level 1. `layout` is that of `write`.

        Batches that the fold before this one had merged are deleted then, as in `compact`. A repeated fold does nothing.
        """
        source, target = ("delta", "fold1") if level == 1 else ("fold1", "fold2")
        done = self._committed(target)
        # a fold of level 1 also ends where level 2 does
        last = max([-1, *done, *(self._committed("fold2") if level == 1 else [])])
        ids = [i for i in self._committed(source) if last < i <= batch_id]
        if ids:
            # named after its last batch, so that what comes after it is read on
            self.write(reduce(self._scan(source, ids)), ids[-1], kind=target, **layout)
            self._delete(source, lambda i: i <= last)

    def _delete(self, kind, where):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for i in filter(where, self._committed(kind)):
            folder = path(f"{self.path}/{kind}/{BATCH}={i}")
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


# The history table, one row per job and ingest time.
HISTORY = (
    "cluster_id STRING, namespace STRING, job_id STRING, job_name STRING, state STRING, start_ts BIGINT, "
    "end_ts BIGINT, " + ", ".join(f"task_{s} INT" for s in TASK_STATES) + ", ts BIGINT"
)


def flatten_tasks(df):
    """Nested task counts as `task_*` columns."""
    if "tasks" not in df.columns:
        return df
    return df.withColumns({f"task_{s}": F.col(f"tasks.{s}") for s in TASK_STATES}).drop("tasks")


def newest_by_key(df, keys, order):
    """Newest row per key; rows that tie in the order are told apart by a hash, so that every run takes the same one."""
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    return latest_per_key(tied, list(keys), [*order, "_tie"]).drop("_tie").select(*df.columns)


def history_table(spark, path, schema=HISTORY):
    return BatchTable(spark, path, f"{schema}, day DATE", bloom=["job_id"])


# Fixed layout: time ranges prune folders, and within a file a job's rows lie together.
HISTORY_LAYOUT = {"partition_by": ["day"], "sort": ["day", *JOB, "ts"]}


def write_history(df, table, batch_id):
    """Append overviews; the key includes the ingest time. Partitioned by day, so that time ranges prune folders."""
    rows = newest_by_key(flatten_tasks(df), [*JOB, "ts"], ())
    rows = rows.withColumn("day", F.to_date(F.timestamp_millis("ts")))
    table.write(rows, batch_id, **HISTORY_LAYOUT)


def fold_history(table, batch_id, level=1):
    """Merge the history batches since the last fold by day; older files stay as they are."""
    table.fold(batch_id, lambda df: newest_by_key(df, [*JOB, "ts"], ()), level, **HISTORY_LAYOUT)


def history_of(history, cluster_id, namespace, job_id):
    """History of one job, newest first. On a history table the three conditions are pushed to the files, where minima,
    maxima and Bloom filters leave out the row groups without the job."""
    rows = history.filter(
        (F.col("cluster_id") == cluster_id) & (F.col("namespace") == namespace) & (F.col("job_id") == job_id)
    )
    return newest_by_key(rows, [*JOB, "ts"], ()).orderBy(F.desc("ts"))


def current_table(spark, path, schema=HISTORY):
    return BatchTable(spark, path, f"{schema}, deleted BOOLEAN")


def write_current(df, table, batch_id, keys=tuple(JOB), order=("ts",)):
    """Upsert: only the newest row per key of this batch is written."""
    rows = newest_by_key(flatten_tasks(df), keys, order)
    table.write(rows.withColumn("deleted", F.lit(False)), batch_id)


def write_deletes(keys_df, table, batch_id, keys=tuple(JOB), order="ts"):
    """Delete rows by key: a marker row with the time of the deletion."""
    fields = {f.name: F.lit(None).cast(f.dataType) for f in table._fields()}
    cols = {**fields, **{k: F.col(k) for k in keys}, order: F.col(order), "deleted": F.lit(True)}
    table.write(keys_df.select(*[c.alias(n) for n, c in cols.items()]), batch_id)


def read_current(table, keys=tuple(JOB), order=("ts",), before=None):
    """Current rows: the newest row per key, without deleted ones. A delete wins a tie."""
    last = newest_by_key(table.read(before), keys, [*order, "deleted"])
    return last.filter(~F.col("deleted")).drop("deleted")


def compact_current(table, batch_id, keys=tuple(JOB), order=("ts",)):
    table.compact(batch_id, lambda df: newest_by_key(df, keys, [*order, "deleted"]))


def delete_keys(df, gone, keys=tuple(JOB)):
    return df.join(gone.select(*keys), list(keys), "left_anti")


def delete_cluster(df, cluster_id, namespace, keys=tuple(CLUSTER)):
    hit = (F.col(keys[0]) == cluster_id) & (F.col(keys[1]) == namespace)
    return df.filter(~F.coalesce(hit, F.lit(False)))
