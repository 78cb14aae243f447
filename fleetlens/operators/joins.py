"""Equi joins on identity keys.

No join here carries a broadcast hint: a side becomes a broadcast only when its size was measured (adaptive
execution), and the big side of every join may be split there when one key is hot, as no grouping follows the join.
"""

from pyspark.sql import functions as F

from fleetlens.functions.config import classify_clusters
from fleetlens.functions.keys import CLUSTER, JOB
from fleetlens.operators.asof import asof_join
from fleetlens.operators.changes import only_changes


def tracked_state(tracked, state, keys=tuple(CLUSTER)):
    """State rows of tracked keys; keys without state are dropped."""
    return state.join(tracked.select(*keys), list(keys), "left_semi")


def index_then_fetch(index, records, predicate, keys=tuple(JOB)):
    """Records whose index row meets the predicate."""
    return records.join(index.filter(predicate).select(*keys), list(keys), "left_semi")


def with_container_resources(statuses, specs, keys=("pod",), name="container", position="position",
                             cols=("cpu_limit", "cpu_request", "memory_limit", "memory_request")):
    """Container status rows with the resources of the spec of the same name; the last spec of a name wins."""
    on = [*keys, name]
    last = F.max_by(F.struct(*cols), F.col(position)).alias("_spec")
    spec = specs.groupBy(*on).agg(last).select(*on, *[F.col(f"_spec.{c}").alias(c) for c in cols])
    return statuses.join(spec, on, "left")


def route_lookup(requests, enabled, endpoints, keys=tuple(CLUSTER), host="host", port="port"):
    """Forward target of each request: host and port if the key is enabled and has an endpoint, else NOT_FOUND."""
    open_keys = enabled.select(*keys).distinct()
    routes = endpoints.join(open_keys, list(keys), "left_semi").select(
        *keys, F.col(host).alias("forward_host"), F.col(port).alias("forward_port")
    )
    found = F.col("forward_host").isNotNull()
    return requests.join(routes, list(keys), "left").withColumn(
        "route", F.when(found, "FORWARD").otherwise("NOT_FOUND")
    )


def require_tracked(requests, tracked, keys=tuple(CLUSTER)):
    """(accepted, violations): requests for tracked and for unknown keys."""
    known = tracked.select(*keys)
    return requests.join(known, list(keys), "left_semi"), requests.join(known, list(keys), "left_anti")


def lookup_with_fallback(wanted, cache, source, keys, cols, directly=False):
    """Values from the cache, else from the source; `directly` skips the cache. No match gives nulls.

    `found_in` tells where the values come from; `get` semantics are `require_found` on the result.
    """
    def side(df, name):
        return df.select(*keys, F.struct(*cols).alias(name))

    out = wanted.join(side(source, "_source"), list(keys), "left")
    if directly:
        out = out.withColumn("_cache", F.lit(None).cast(out.schema["_source"].dataType))
    else:
        out = out.join(side(cache, "_cache"), list(keys), "left")
    hit = F.coalesce("_cache", "_source")
    found_in = F.when(F.col("_cache").isNotNull(), "cache").when(F.col("_source").isNotNull(), "source")
    return out.withColumns({**{c: hit[c] for c in cols}, "found_in": found_in}).drop("_cache", "_source")


def require_found(df, col="found_in"):
    """Raise an error for rows without a match."""
    missing = F.when(F.col(col).isNull(), F.raise_error(F.lit("not found")).cast("string"))
    return df.withColumn(col, F.coalesce(F.col(col), missing))


# Kinds of objects of a cluster, in the order of the snapshot.
OBJECT_KINDS = ["deployment", "service", "pod", "config_map"]


def assemble_snapshot(objects, keys=tuple(CLUSTER), item="name"):
    """The objects of each cluster as rows (keys, kind, item). `objects` has keys, kind and item (a name or a struct).

    Rows, not one array per kind: the form is the same for a cluster of any size, and nothing is gathered.
    """
    return objects.filter(F.col("kind").isin(*OBJECT_KINDS)).select(*keys, "kind", item)


def snapshot_counts(objects, keys=tuple(CLUSTER)):
    """Number of objects of each kind, one row per cluster with any object."""
    return objects.filter(F.col("kind").isin(*OBJECT_KINDS)).groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in OBJECT_KINDS]
    )


def full_snapshot(tables, keys=tuple(CLUSTER), name="name"):
    """All objects of all kinds with their details: keys, kind, name, `detail` (the other columns as JSON).

    `tables` maps a kind to its rows, which have the keys and the name.
    """
    parts = [
        df.select(*keys, F.lit(kind).alias("kind"), F.col(name).alias("name"),
                  F.to_json(F.struct(*[c for c in df.columns if c not in (*keys, name)])).alias("detail"))
        for kind, df in tables.items() if kind in OBJECT_KINDS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fetch_many(state, wanted, keys, order=None):
    """Rows of the wanted keys."""
    out = state.join(wanted.select(*keys), list(keys), "left_semi")
    return out.orderBy(*order) if order else out


def container_names(pods, pod):
    """Container names of one pod, one row each; an unknown pod gives no rows."""
    return pods.filter(F.col("name") == pod).select(F.explode("containers.name").alias("container"))


def first_job_of_cluster(clusters, jobs, keys=tuple(CLUSTER), orders=("job_id",)):
    """The job of a single-job cluster; clusters without one get `error` set."""
    first = jobs.groupBy(*keys).agg(F.min_by("job_id", F.struct(*orders)).alias("job_id"))
    out = clusters.select(*keys).join(first, list(keys), "left")
    return out.withColumn("error", F.when(F.col("job_id").isNull(), "EMPTY_JOB_IN_CLUSTER"))


def cluster_overview(overviews, configs, keys=tuple(CLUSTER), marker=("deploy.source", "fleet"), col="config",
                     order=("ts",), ties=(), keep_unconfigured=False, rows=None):
    """Overview polls with the exec mode and managed flag of the config in force: the last one polled by then.

    `configs` has the polled configs of each cluster over time; without the `order` columns it is one config per cluster (of
    several the one whose JSON text is largest). A poll before the first config of its cluster has no overview; with
    `keep_unconfigured` it stays, in mode Unknown and not managed.
    """
    if all(c in configs.columns for c in order):
        joined = asof_join(overviews, configs, list(keys), list(order), [col], ties, "_config", rows)
    else:
        one = configs.groupBy(*keys).agg(F.max_by(F.struct(col), F.to_json(col)).alias("_config"))
        joined = overviews.join(one, list(keys), "left")
    if not keep_unconfigured:
        joined = joined.filter(F.col("_config").isNotNull())
    return classify_clusters(joined.withColumn(col, F.col(f"_config.{col}")), marker, col).drop(col, "_config")


def overview_changes(overviews, configs, keys=tuple(CLUSTER), order=("ts",), marker=("deploy.source", "fleet"),
                     col="config", ties=(), keep_unconfigured=False, rows=None):
    """`cluster_overview` of several polls, only where a cluster differs from its poll before."""
    joined = cluster_overview(overviews, configs, keys, marker, col, order, ties, keep_unconfigured, rows)
    cols = [c for c in joined.columns if c not in (*keys, *order)]
    return only_changes(joined, list(keys), list(order), cols, rows)
