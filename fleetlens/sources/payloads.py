"""Typed rows from landed JSON payloads. Input: key columns, `payload` text, ingest time `ts`.

The same functions take batch and streaming frames; each is one projection without a shuffle, except the listing of
distinct metric keys.
"""

from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.columns import decode_enum
from fleetlens.functions.config import last_entries_map
from fleetlens.functions.keys import CLUSTER, JOB
from fleetlens.functions.quantity import parse_quantity


def read_payloads(spark, path, schema, fmt="json", stream=False, **options):
    """Landed payload files as a batch or a streaming frame. The schema is always given, never inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(**options).format(fmt).load(path)


def parsed(df, schema, payload, name="_p"):
    """Add the parsed payload. It comes out of a generator, so that picking many fields does not parse many times."""
    return df.select("*", F.explode_outer(F.array(F.from_json(payload, schema))).alias(name))


def unreadable(df, schema, payload="payload"):
    """Rows whose payload is not JSON of the schema's shape."""
    marked = schema if schema.upper().startswith("ARRAY") else f"{schema}, _corrupt_record STRING"
    p = F.from_json(payload, marked)
    bad = p.isNull() if marked == schema else p["_corrupt_record"].isNotNull()
    return df.filter(F.col(payload).isNotNull() & bad)


def checked_items(df, schema, items, cols, keys=tuple(CLUSTER), payload="payload", more=(), rules=None):
    """One row per element of the array `items` of the payload, and `broken_rules`; nothing is lost.

    `cols` maps output names to columns over `i`, the element; `rules` maps a rule to a condition over the output. A
    payload that can't be read gives one row with the rule `payload` and its text in `bad_payload`; one without items
    gives none. Payloads are parsed once.
    """
    p = parsed(df, f"{schema}, _corrupt_record STRING", payload)
    broken = F.col(payload).isNotNull() & (F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull())
    p = p.withColumn("_broken", broken)
    rows = p.select(*keys, *more, "_broken", F.when(F.col("_broken"), F.col(payload)).alias("bad_payload"),
                    F.explode_outer(items).alias("i"))
    rows = rows.filter(F.col("_broken") | F.col("i").isNotNull())
    rows = rows.select(*keys, *[c.alias(n) for n, c in cols.items()], *more, "_broken", "bad_payload")
    found = [F.when(F.col("_broken"), F.lit("payload"))]
    found += [F.when(~F.col("_broken") & ~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (rules or {}).items()]
    return rows.withColumn("broken_rules", F.array_compact(F.array(*found))).drop("_broken")


def _known_state(col="state"):
    return F.col(col).isin(*S.JOB_STATES)


def checked_job_overview(df, keys=tuple(CLUSTER), payload="payload", ts="ts"):
    """`payload_job_overview` with `broken_rules`: unreadable payloads and unknown job states stay, marked."""
    cols = {"job_id": F.col("i.jid"), "job_name": F.col("i.name"), "state": F.col("i.state"),
            "start_ts": F.col("i.`start-time`"), "end_ts": F.col("i.`end-time`"), "tasks": F.col("i.tasks")}
    return checked_items(df, S.JOB_OVERVIEW, "_p.jobs", cols, keys, payload, [ts], {"state": _known_state()})


def checked_job_status(df, keys=tuple(CLUSTER), payload="payload"):
    """`payload_job_status` with `broken_rules`."""
    cols = {"job_id": F.col("i.id"), "state": F.col("i.status")}
    return checked_items(df, S.JOB_STATUS, "_p.jobs", cols, keys, payload, (), {"state": _known_state()})


def checked_member_ids(df, keys=tuple(CLUSTER), payload="payload"):
    """`payload_member_ids` with `broken_rules`."""
    return checked_items(df, S.MEMBER_IDS, "_p.taskmanagers.id", {"tid": F.col("i")}, keys, payload)


def payload_job_overview(df, keys=tuple(CLUSTER), payload="payload", ts="ts"):
    """One row per job with its nested task counts."""
    j = parsed(df, S.JOB_OVERVIEW, payload).select(*keys, ts, F.explode("_p.jobs").alias("j"))
    return j.select(
        *keys,
        F.col("j.jid").alias("job_id"),
        F.col("j.name").alias("job_name"),
        F.col("j.state").alias("state"),
        F.col("j.`start-time`").alias("start_ts"),
        F.col("j.`end-time`").alias("end_ts"),
        F.col("j.tasks").alias("tasks"),
        ts,
    )


def payload_job_status(df, keys=tuple(CLUSTER), payload="payload"):
    j = parsed(df, S.JOB_STATUS, payload).select(*keys, F.explode("_p.jobs").alias("j"))
    return j.select(*keys, F.col("j.id").alias("job_id"), F.col("j.status").alias("state"))


def payload_metrics(df, keys=tuple(JOB), payload="payload", ts="ts"):
    """Map of metric id to value; the last entry of a repeated id wins."""
    p = parsed(df, S.METRICS, payload)
    return p.select(*keys, ts, last_entries_map(F.col("_p"), "id", "value").alias("metrics"))


def payload_metric_keys(df, keys=tuple(JOB), payload="payload"):
    """Distinct metric ids."""
    ids = parsed(df, S.METRICS, payload).select(*keys, F.explode("_p.id").alias("id"))
    return ids.distinct()


def payload_cluster_overview(df, keys=tuple(CLUSTER), payload="payload", ts="ts"):
    p = F.col("_p")
    jobs = F.struct(*[p[f"jobs-{s}"].alias(s) for s in ("running", "finished")],
                    p["jobs-cancelled"].alias("canceled"), p["jobs-failed"].alias("failed"))
    return parsed(df, S.CLUSTER_OVERVIEW, payload).select(
        *keys,
        p["flink-version"].alias("version"),
        p["taskmanagers"].alias("members"),
        p["slots-total"].alias("slots_total"),
        p["slots-available"].alias("slots_available"),
        jobs.alias("jobs"),
        ts,
    )


def payload_kv_config(df, keys=tuple(CLUSTER), payload="payload"):
    """Config map of each cluster; the last entry of a repeated key wins."""
    p = parsed(df, S.CONFIG, payload)
    return p.select(*keys, last_entries_map(F.col("_p")).alias("config"))


def payload_member_ids(df, keys=tuple(CLUSTER), payload="payload"):
    return parsed(df, S.MEMBER_IDS, payload).select(*keys, F.explode("_p.taskmanagers.id").alias("tid"))


def payload_member_detail(df, keys=tuple(CLUSTER), payload="payload", ts="ts"):
    """Worker detail with its nested resource structs."""
    return parsed(df, S.MEMBER_DETAIL, payload).select(*keys, "_p.*", ts).withColumnRenamed("id", "tid")


def payload_op_status(df, keys=("job_id", "trigger_id"), payload="payload", on_miss="null"):
    """State of an async operation. The cause is null if the operation has none.

    An unknown state gives null, so that such rows can be put aside; on_miss="error" fails instead.
    """
    return parsed(df, S.OP_STATUS, payload).select(
        *keys,
        decode_enum(F.col("_p.status.id"), S.OP_STATES, on_miss).alias("state"),
        F.col("_p.operation.`failure-cause`.`stack-trace`").alias("failure_cause"),
    )


def payload_pod_usage(df, keys=(*CLUSTER, "pod"), payload="payload"):
    """Usage of each pod: epoch millis and an array of (name, cpu, memory) with parsed quantities."""
    containers = F.transform(
        "_p.containers",
        lambda c: F.struct(
            c["name"].alias("name"),
            parse_quantity(c["usage"]["cpu"]).alias("cpu"),
            parse_quantity(c["usage"]["memory"]).alias("memory"),
        ),
    )
    return parsed(df, S.POD_USAGE, payload).select(
        *keys,
        F.unix_millis(F.try_to_timestamp("_p.timestamp")).alias("ts"),
        containers.alias("containers"),
    )
