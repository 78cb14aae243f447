"""Pod usage of live pods."""

from pyspark.sql import functions as F

from fleetlens.operators.state import latest_per_key


def usage_by_live_pods(pod_events, usage, scope, key, seq="seq", op="op", reset="Reseted", deleted="Deleted"):
    """Newest usage of each live pod. A reset clears its scope and a delete its pod; older usage does not come back."""
    is_op = lambda name: F.col(op) == name
    pods = (
        pod_events.filter(F.col(op) != reset)
        .groupBy(*scope, *key)
        .agg(F.max(seq).alias("_last"), F.max(F.when(is_op(deleted), F.col(seq))).alias("_deleted"))
    )
    resets = pod_events.filter(is_op(reset)).groupBy(*scope).agg(F.max(seq).alias("_reset"))
    live = pods.filter(F.col("_deleted").isNull() | (F.col("_last") > F.col("_deleted")))
    live = live.join(resets, list(scope), "left")
    live = live.filter(F.col("_reset").isNull() | (F.col("_last") > F.col("_reset")))
    since = live.select(*scope, *key, F.greatest("_deleted", "_reset").alias("_since"))
    last = latest_per_key(usage, [*scope, *key], [seq]).join(since, [*scope, *key])
    return last.filter(F.col("_since").isNull() | (F.col(seq) > F.col("_since"))).drop("_since")
