"""Aggregates over clusters and jobs."""

from pyspark.sql import functions as F

from fleetlens.functions.keys import CLUSTER
from fleetlens.schemas import JOB_STATES


def keys_by_cluster(df, cluster=tuple(CLUSTER), key="job_id"):
    """The distinct keys of each cluster, one row each, so that a large cluster is not gathered in one place."""
    return df.select(*cluster, key).distinct()


def key_counts(df, cluster=tuple(CLUSTER), key="job_id", name="keys"):
    """Number of distinct keys of each cluster; the keys are made distinct before they are counted by cluster."""
    return keys_by_cluster(df, cluster, key).groupBy(*cluster).agg(F.count(key).alias(name))


def merge_maps(df, keys=tuple(CLUSTER), col="data", source="name"):
    """Union of all maps of a cluster as (keys, key, value) rows; the map with the greatest source name wins."""
    rows = df.select(*keys, source, F.explode(col).alias("key", "value"))
    return rows.groupBy(*keys, "key").agg(F.max_by("value", source).alias("value"))


def state_counts(jobs, keys=tuple(CLUSTER), col="state", states=tuple(JOB_STATES)):
    """Number of jobs per state, one column each."""
    return jobs.groupBy(*keys).agg(*[F.count_if(F.col(col) == s).alias(s.lower()) for s in states])


def task_counts(tasks, keys, col="state", states=("CREATED", "SCHEDULED", "DEPLOYING", "RUNNING", "FINISHED",
                                                  "CANCELING", "CANCELED", "FAILED", "RECONCILING", "INITIALIZING")):
    """Task counts of each job, computed from task rows."""
    counts = [F.count_if(F.col(col) == s).alias(s.lower()) for s in states]
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)


def random_member(df, group, key, seed):
    """One member per group, chosen by the MD5 of its key and the seed: repeatable, and one pass with map-side combine."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.groupBy(*group).agg(F.min_by(key, F.struct(digest, F.col(key))).alias(key))
