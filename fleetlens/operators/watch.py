"""Async operations: watch until complete or timed out."""

from pyspark.sql import functions as F

from fleetlens.operators.spread import spread_join


def watch_until_complete(events, keys, ts, is_start, is_done, timeout, now=None, rows=None):
    """One row per started operation: status COMPLETED, WATCH_TIMEOUT or IN_PROGRESS, with start and completion.

    The operation starts with its first start row and completes with its first done row from then on, unless that
    comes later than `timeout` (in the unit of the numeric `ts`). It is open while `now` (default: the newest
    event) has not passed the timeout.
    """
    starts = events.filter(is_start).groupBy(*keys).agg(F.min(ts).alias("start_ts"))
    done = events.filter(is_done).select(*keys, F.col(ts).alias("_done"))
    first = (
        spread_join(done, starts, keys, ["_done"], "inner", rows)
        .filter((F.col("_done") >= F.col("start_ts")) & (F.col("_done") <= F.col("start_ts") + timeout))
        .groupBy(*keys)
        .agg(F.min("_done").alias("completed_ts"))
    )
    newest = F.lit(now) if now is not None else events.agg(F.max(ts)).scalar()
    status = (
        F.when(F.col("completed_ts").isNotNull(), "COMPLETED")
        .when(newest > F.col("start_ts") + timeout, "WATCH_TIMEOUT")
        .otherwise("IN_PROGRESS")
    )
    return starts.join(first, list(keys), "left").withColumn("status", status)
