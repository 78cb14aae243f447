"""Cluster configuration: execution mode, versions, flattened entries, merge, redaction and checks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.columns import clamp_min, decode_enum, or_default, safe_trim
from fleetlens.functions.paths import file_name, is_object_store_path
from fleetlens.schemas import EXEC_MODES, FORBIDDEN_CONFIG_KEYS, PROTECTED_CONFIG_KEYS

# Schema of a cluster definition. Columns that a table lacks count as null.
CLUSTER_DEF = (
    "cluster_id STRING, namespace STRING, version STRING, mode STRING, image STRING, k8s_account STRING, "
    "rest_export STRING, "
    "cpu STRUCT<jm: DOUBLE, tm: DOUBLE, jm_factor: DOUBLE, tm_factor: DOUBLE>, "
    "mem STRUCT<jm_mb: INT, tm_mb: INT>, "
    "par STRUCT<slots: INT, parallelism: INT>, "
    "webui STRUCT<submit: BOOLEAN, cancel: BOOLEAN>, "
    "restart STRUCT<strategy: STRING, attempts: INT, delay_sec: INT, interval_sec: INT, max_failures: INT>, "
    "state STRUCT<backend: STRING, storage: STRING, checkpoint_dir: STRING, savepoint_dir: STRING, "
    "incremental: BOOLEAN, local_recovery: BOOLEAN, retained: INT>, "
    "ha STRUCT<impl: STRING, storage_dir: STRING, cluster_id: STRING>, "
    "s3 STRUCT<endpoint: STRING, access_key: STRING, secret_key: STRING, path_style: BOOLEAN, ssl: BOOLEAN>, "
    "deps ARRAY<STRING>, plugins ARRAY<STRING>, "
    "job_jar STRING, job_name STRING, "
    "restore STRUCT<path: STRING, allow_non_restored: BOOLEAN, mode: STRING>, "
    "overrides MAP<STRING, STRING>"
)
HA_IMPL = "org.apache.flink.kubernetes.highavailability.KubernetesHaServicesFactory"


def infer_exec_mode(config, mode_key="exec.mode", target_key="execution.target"):
    """Exec mode of a config map: the exact mode name if it is set, else by the execution target."""
    target = F.element_at(config, F.lit(target_key))
    by_target = (
        F.when(target.isin("kubernetes-session", "remote"), "kubernetes-session")
        .when(target == "embedded", "kubernetes-application")
        .otherwise("Unknown")
    )
    return F.coalesce(decode_enum(F.element_at(config, F.lit(mode_key)), EXEC_MODES), by_target)


def is_managed(config, key, value):
    """Does the config map hold the marker pair of clusters that were deployed by the owner?"""
    return F.coalesce(F.element_at(config, F.lit(key)) == value, F.lit(False))


def classify_clusters(configs, marker, col="config"):
    """Add `exec_mode` and `managed` from the config map of each cluster."""
    c = F.col(col)
    return configs.withColumns({"exec_mode": infer_exec_mode(c), "managed": is_managed(c, *marker)})


def major_version(col):
    """The first two dot parts, or the whole text if there are fewer."""
    parts = F.split(F.regexp_replace(col, r"\.+$", ""), r"\.")
    return F.when(F.size(parts) < 2, col).otherwise(F.concat_ws(".", F.slice(parts, 1, 2)))


def full_version(col, scala):
    return F.concat(col, F.lit("-scala_"), scala if not isinstance(scala, str) else F.lit(scala))


def version_rollup(clusters, col="version", scala="2.12"):
    """Clusters counted by major and full version."""
    c = F.col(col)
    return clusters.groupBy(
        major_version(c).alias("major_version"), full_version(c, scala).alias("full_version")
    ).agg(F.count(F.lit(1)).alias("clusters"))


def config_value_text(col, data_type):
    """Text of a config value: map as `k=v;k=v`, array joined by `;`, else plain text."""
    if isinstance(data_type, T.MapType):
        pairs = F.transform(F.map_entries(col), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.when(col.isNotNull(), F.array_join(pairs, ";"))
    if isinstance(data_type, T.ArrayType):
        return F.array_join(F.transform(col, lambda x: x.cast("string")), ";")
    return col.cast("string")


def drop_empty_config(df, col="value"):
    """Rows whose value is set: not null and, for arrays and maps, not empty."""
    keep = F.col(col).isNotNull()
    if isinstance(df.schema[col].dataType, (T.ArrayType, T.MapType)):
        keep = keep & (F.size(col) > 0)
    return df.filter(keep)


def _with_all_columns(defs):
    schema = T.StructType.fromDDL(CLUSTER_DEF)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in defs.columns}
    return defs.withColumns(missing) if missing else defs


def needs_object_store(defs):
    """Is any directory, dependency or application jar of the definition an object store path?"""
    d = _with_all_columns(defs)
    dirs = [F.col("state.checkpoint_dir"), F.col("state.savepoint_dir"), F.col("ha.storage_dir"), F.col("job_jar")]
    needed = F.coalesce(F.exists("deps", is_object_store_path), F.lit(False))
    for c in dirs:
        needed = needed | F.coalesce(is_object_store_path(c), F.lit(False))
    return d.withColumn("needs_object_store", needed).select(*defs.columns, "needs_object_store")


def _seconds(col):
    return F.concat(clamp_min(col, 1).cast("string"), F.lit(" s"))


def _positive(col, default):
    return or_default(col, lambda c: c > 0, default)


def _blocks(default_account, store):
    """(key, column) pairs of a definition, block by block."""
    c = F.col
    strategy = c("restart.strategy")
    fixed, rate = strategy == "fixed-delay", strategy == "failure-rate"
    jar = c("job_jar")
    pairs = [
        ("execution.target", c("mode")),
        ("kubernetes.cluster-id", c("cluster_id")),
        ("kubernetes.namespace", c("namespace")),
        ("kubernetes.container.image", c("image")),
        ("kubernetes.jobmanager.service-account", F.coalesce(c("k8s_account"), F.lit(default_account))),
        ("kubernetes.rest-service.exposed.type", c("rest_export")),
        ("blob.server.port", F.lit("6124")),
        ("taskmanager.rpc.port", F.lit("6122")),
        ("kubernetes.jobmanager.cpu", _positive(c("cpu.jm"), 1.0)),
        ("kubernetes.jobmanager.cpu.limit-factor", _positive(c("cpu.jm_factor"), 1.0)),
        ("kubernetes.taskmanager.cpu", c("cpu.tm")),
        ("kubernetes.taskmanager.cpu.limit-factor", _positive(c("cpu.tm_factor"), 1.0)),
        ("jobmanager.memory.process.size", F.concat(_positive(c("mem.jm_mb"), 1920).cast("string"), F.lit("m"))),
        ("taskmanager.memory.process.size", F.concat(_positive(c("mem.tm_mb"), 1920).cast("string"), F.lit("m"))),
        ("taskmanager.numberOfTaskSlots", clamp_min(c("par.slots"), 1)),
        ("parallelism.default", clamp_min(c("par.parallelism"), 1)),
        ("web.submit.enable", c("webui.submit")),
        ("web.cancel.enable", c("webui.cancel")),
        ("restart-strategy", strategy),
        ("restart-strategy.fixed-delay.attempts", F.when(fixed, clamp_min(c("restart.attempts"), 1))),
        ("restart-strategy.fixed-delay.delay", F.when(fixed, _seconds(c("restart.delay_sec")))),
        ("restart-strategy.failure-rate.delay", F.when(rate, _seconds(c("restart.delay_sec")))),
        ("restart-strategy.failure-rate.failure-rate-interval", F.when(rate, _seconds(c("restart.interval_sec")))),
        (
            "restart-strategy.failure-rate.max-failures-per-interval",
            F.when(rate, clamp_min(c("restart.max_failures"), 1)),
        ),
        ("state.backend", c("state.backend")),
        ("state.checkpoint-storage", c("state.storage")),
        ("state.checkpoints.dir", c("state.checkpoint_dir")),
        ("state.savepoints.dir", c("state.savepoint_dir")),
        ("state.backend.incremental", c("state.incremental")),
        ("state.backend.local-recovery", c("state.local_recovery")),
        ("state.checkpoints.num-retained", clamp_min(c("state.retained"), 1)),
        ("high-availability", F.when(c("ha").isNotNull(), F.coalesce(c("ha.impl"), F.lit(HA_IMPL)))),
        ("high-availability.storageDir", c("ha.storage_dir")),
        ("high-availability.cluster-id", c("ha.cluster_id")),
    ]
    store_keys = ["endpoint", "access_key", "secret_key", "path_style", "ssl"]
    own = ["hive.s3.endpoint", "hive.s3.aws-access-key", "hive.s3.aws-secret-key",
           "hive.s3.path-style-access", "hive.s3.ssl.enabled"]
    job = ["fs.s3a.endpoint", "fs.s3a.access.key", "fs.s3a.secret.key",
           "fs.s3a.path.style.access", "fs.s3a.connection.ssl.enabled"]
    for name, key in zip(store_keys, own):
        value = (store or {}).get(name)
        if value is not None:
            text = str(value).lower() if isinstance(value, bool) else str(value)
            pairs.append((key, F.when(c("needs_object_store"), F.lit(text))))
    pairs += [(key, c(f"s3.{name}")) for name, key in zip(store_keys, job)]
    plugins = F.when(F.size("plugins") > 0, F.array_join("plugins", ";"))
    pairs += [
        ("containerized.master.env.ENABLE_BUILT_IN_PLUGINS", plugins),
        ("containerized.taskmanager.env.ENABLE_BUILT_IN_PLUGINS", plugins),
        (
            "pipeline.jars",
            F.when(is_object_store_path(jar), F.concat(F.lit("local:///opt/flink/lib/"), file_name(jar))).otherwise(jar),
        ),
        ("pipeline.name", c("job_name")),
        ("execution.savepoint-restore-mode", c("restore.mode")),
        ("execution.savepoint.path", c("restore.path")),
        ("execution.savepoint.ignore-unclaimed-state", c("restore.allow_non_restored")),
    ]
    return pairs


def config_entries(defs, keys=("cluster_id", "namespace"), default_account="default", store=None):
    """Definition rows to long (key, value) rows. Overrides win; empty values are left out.

    Everything happens inside one row, so there is no shuffle.
    """
    d = needs_object_store(_with_all_columns(defs))
    pairs = _blocks(default_account, store)
    base = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    overrides = F.coalesce(F.col("overrides"), F.create_map().cast("map<string,string>"))
    own = F.filter(base, lambda e: e["value"].isNotNull() & ~F.map_contains_key(overrides, e["key"]))
    entries = F.concat(own, F.map_entries(overrides))
    return d.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.key", "e.value")


def merge_config(base, override):
    """Union of two map columns; the override wins for each key."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, empty), F.coalesce(override, empty)
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))


def redact(config, keys=tuple(PROTECTED_CONFIG_KEYS)):
    """Entries of a map sorted by key, with the values of the listed keys hidden."""
    hidden = F.transform_values(config, lambda k, v: F.when(k.isin(*keys), F.lit("***")).otherwise(v))
    return F.array_sort(F.map_entries(hidden))


def remove_forbidden(config, keys=tuple(FORBIDDEN_CONFIG_KEYS)):
    """Trim keys and values, drop blank ones and forbidden keys. If trimmed keys collide, the last wins."""
    entries = F.filter(
        F.transform(
            F.map_entries(config),
            lambda e: F.struct(safe_trim(e["key"]).alias("key"), safe_trim(e["value"]).alias("value")),
        ),
        lambda e: (e["key"] != "") & (e["value"] != "") & ~e["key"].isin(*keys),
    )
    return last_entries_map(entries)


def last_entries_map(entries, key="key", value="value"):
    """Map from an array of structs. For a repeated key the last entry wins, whatever the session's policy."""
    names = F.transform(entries, lambda e: e[key])
    unique = F.array_distinct(names)
    values = F.transform(
        unique, lambda k: F.element_at(F.filter(entries, lambda e: e[key] == k), -1)[value]
    )
    plain = F.map_from_arrays(names, F.transform(entries, lambda e: e[value]))
    return F.when(F.size(unique) == F.size(names), plain).otherwise(F.map_from_arrays(unique, values))


def config_audit(defs, forbidden=tuple(FORBIDDEN_CONFIG_KEYS), protected=tuple(PROTECTED_CONFIG_KEYS),
                 keys=("cluster_id", "namespace"), **entry_options):
    """Config entries of all definitions, redacted, plus the forbidden overrides as violations.

    Rows: keys, key, value, violation. A forbidden override is listed and does not take effect.
    """
    cleaned = defs.withColumn("overrides", remove_forbidden(F.col("overrides"), forbidden))
    entries = config_entries(cleaned, keys, **entry_options).withColumn("violation", F.lit(False))
    bad = (
        defs.select(*keys, F.explode("overrides").alias("key", "value"))
        .withColumns({"key": safe_trim(F.col("key")), "value": safe_trim(F.col("value"))})
        .filter(F.col("key").isin(*forbidden) & (F.col("value") != ""))
        .withColumn("violation", F.lit(True))
    )
    hidden = F.when(F.col("key").isin(*protected), F.lit("***")).otherwise(F.col("value"))
    return entries.unionByName(bad).withColumn("value", hidden)
