"""Metrics of a stream in long form, with a table of metric keys and types that grows by versions."""

from fleetlens.operators import metrics as M
from fleetlens.sources import tables
from fleetlens.streaming import runs


def stream_metrics(stream, path, checkpoint, col="metrics", **options):
    """Keep a stream of metric maps in long form and register their keys; a version is the id of a micro-batch.

    Gives (query, view, registry): `view(version)` are the typed rows by the types of a version, the newest by default, and
    `registry()` the rows for `registry_at` and `registered_spec`. Values are kept as texts and typed when read, so a metric
    that becomes a double later is one in its early rows too. A key has at most two registry rows.
    """
    spark = stream.sparkSession
    rows = M.long_metrics(stream, col)
    values = tables.BatchTable(spark, f"{path}/values", rows.schema)
    keys = tables.BatchTable(spark, f"{path}/keys", M.REGISTRY)

    def each(b, i):
        held = b.persist()
        values.write(held, i)
        # keys of earlier batches only, so that a repeated batch registers the same
        runs._put(keys, M.new_metric_keys(held, keys.read(before=i), i), i, lambda df: df)
        held.unpersist()
        runs._fold(i, values.fold)

    query = runs.run(rows, checkpoint, each, **options)
    return query, lambda version=None: M.type_metrics_long(values.read(), M.registry_at(keys.read(), version)), keys.read
