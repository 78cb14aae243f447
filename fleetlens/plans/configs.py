"""Cluster definitions and configuration."""

from pyspark.sql import functions as F

from fleetlens.functions import config as G
from fleetlens.operators import aggregates, joins
from fleetlens.plans.registry import case
from fleetlens.plans.roles import text
from fleetlens.sources import payloads


def _configs(t):
    """Config maps of parts: the exec mode, the execution target and the owner's mark."""
    size = F.col("p_size")
    mode = F.when(size % 5 == 0, "kubernetes-application").when(size % 5 == 1, "bad-name")
    target = F.when(size % 4 == 0, "remote").when(size % 4 == 1, "embedded").when(size % 4 == 2, "kubernetes-session")
    owner = F.when(size % 3 == 0, "fleet").when(size % 3 == 1, "other")
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value"))
          for k, v in (("exec.mode", mode), ("execution.target", target), ("deploy.source", owner))]
    )
    config = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    return t.part.select("p_partkey", config.alias("config"))


CLASSES = """classes AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR (p_size % 4 = 1) THEN 'kubernetes-application'
    WHEN p_size % 4 IN (0, 2) THEN 'kubernetes-session' ELSE 'Unknown' END AS exec_mode,
  p_size % 3 = 0 AS managed FROM part)"""


@case("p7_infer_exec_mode", f"WITH {CLASSES} SELECT p_partkey, exec_mode FROM classes")
def _(t):
    return _configs(t).select("p_partkey", G.infer_exec_mode(F.col("config")).alias("exec_mode"))


@case("p8_classify_clusters", f"WITH {CLASSES} SELECT p_partkey, exec_mode, managed FROM classes")
def _(t):
    return G.classify_clusters(_configs(t), ("deploy.source", "fleet")).drop("config")


@case("j12_cluster_overview", f"""WITH {CLASSES} SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, l_quantity,
  exec_mode, managed FROM lineitem JOIN classes ON l_partkey = p_partkey""")
def _(t):
    overviews = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return joins.cluster_overview(overviews, _configs(t), ["p_partkey"])


@case("j12_overview_changes", f"""WITH {CLASSES}, x AS (SELECT user_id % 50 + 1 AS k, event_id, length(event_type) AS members,
    exec_mode, managed, lag(length(event_type)) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS p
    FROM events JOIN classes ON user_id % 50 + 1 = p_partkey)
  SELECT concat('c', k) AS cluster_id, event_id AS ts, CAST(members AS INTEGER) AS members, exec_mode, managed FROM x
  WHERE p IS DISTINCT FROM members""")
def _(t):
    keyed = lambda df, key: df.withColumns({"cluster_id": text("c", key), "namespace": F.lit("ns")})
    polls = keyed(t.events, F.col("user_id") % 50 + 1).withColumn("ts", F.col("event_id"))
    polls = polls.withColumn("payload", F.to_json(F.struct(F.length("event_type").alias("taskmanagers"))))
    entry = lambda k: F.struct(k.alias("key"), F.col("config")[k].alias("value"))
    configs = keyed(_configs(t), F.col("p_partkey")).withColumn(
        "payload", F.to_json(F.transform(F.map_keys("config"), entry)))
    changed = joins.overview_changes(payloads.payload_cluster_overview(polls), payloads.payload_kv_config(configs))
    return changed.select("cluster_id", "ts", "members", "exec_mode", "managed")


# config polls of clusters 0 to 39: some at the time of an overview, several at one time (the last event counts)
POLLED = """polls AS (SELECT user_id % 50 AS c, event_id AS ts, CAST(length(event_type) AS INTEGER) AS members FROM events),
  configs AS (SELECT user_id % 50 AS c, event_id - event_id % 7 AS ts, arg_max(event_id % 5, event_id) AS m,
    arg_max(event_id % 3, event_id) AS o FROM events WHERE user_id % 50 < 40 AND event_type <> 'view' GROUP BY 1, 2),
  known AS (SELECT concat('c', p.c) AS cluster_id, p.ts, members, CASE WHEN m = 0 THEN 'kubernetes-application'
      WHEN m = 1 THEN 'kubernetes-session' WHEN m IS NOT NULL THEN 'Unknown' END AS exec_mode, o = 0 AS managed
    FROM polls p ASOF LEFT JOIN configs ON p.c = configs.c AND p.ts >= configs.ts)"""


def _polled(t):
    """(overview polls, config polls with `seq` for those of one time)."""
    cluster = [text("c", F.col("user_id") % 50).alias("cluster_id"), F.lit("ns").alias("namespace")]
    polls = t.events.select(*cluster, F.col("event_id").alias("ts"), F.length("event_type").alias("members"))
    mode, owner = F.col("event_id") % 5, F.col("event_id") % 3
    mode = F.when(mode == 0, "kubernetes-application").when(mode == 1, "kubernetes-session").otherwise("other")
    config = F.create_map(F.lit("exec.mode"), mode, F.lit("deploy.source"), F.when(owner == 0, "fleet").otherwise("x"))
    configs = t.events.filter("user_id % 50 < 40 AND event_type <> 'view'").select(
        *cluster, (F.col("event_id") - F.col("event_id") % 7).alias("ts"), F.col("event_id").alias("seq"), config.alias("config"))
    return polls, configs


@case("j12_overview_asof", f"""WITH {POLLED} SELECT cluster_id, ts, members, coalesce(exec_mode, 'Unknown') AS exec_mode,
  coalesce(managed, false) AS managed FROM known""")
def _(t):
    return joins.cluster_overview(*_polled(t), ties=["seq"], keep_unconfigured=True).drop("namespace")


@case("j12_overview_asof_hot_keys", f"WITH {POLLED} SELECT * FROM known WHERE exec_mode IS NOT NULL")
def _(t):
    # every cluster counts as hot here, so all of them are cut into slices
    return joins.cluster_overview(*_polled(t), ties=["seq"], rows=20).drop("namespace")


@case("j12_overview_asof_changes", f"""WITH {POLLED} SELECT cluster_id, ts, members, exec_mode, managed FROM (
  SELECT *, lag((members, exec_mode, managed)) OVER (PARTITION BY cluster_id ORDER BY ts) AS prev FROM known
  WHERE exec_mode IS NOT NULL) WHERE prev IS DISTINCT FROM (members, exec_mode, managed)""")
def _(t):
    return joins.overview_changes(*_polled(t), ties=["seq"]).drop("namespace")


@case("p27_version_rollup", """WITH v AS (SELECT concat('1.', c_nationkey, '.', c_custkey % 4) AS version FROM customer
    UNION ALL SELECT 'v2' FROM customer WHERE c_acctbal < 0)
  SELECT CASE WHEN version = 'v2' THEN 'v2' ELSE concat(split_part(version, '.', 1), '.', split_part(version, '.', 2))
    END AS major_version, concat(version, '-scala_2.12') AS full_version, count(*) AS clusters FROM v GROUP BY 1, 2""")
def _(t):
    version = F.concat(F.lit("1."), F.col("c_nationkey").cast("string"), text(".", F.col("c_custkey") % 4))
    rows = t.customer.select(version.alias("version")).unionByName(
        t.customer.filter("c_acctbal < 0").select(F.lit("v2").alias("version")))
    return G.version_rollup(rows)


@case("p29_drop_empty_config", """SELECT p_partkey, p_brand AS value FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'list' FROM part WHERE p_size % 3 = 0""")
def _(t):
    texts = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("value"))
    tags = F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    lists = G.drop_empty_config(t.part.select("p_partkey", tags.alias("value")))
    return G.drop_empty_config(texts).unionByName(lists.select("p_partkey", F.lit("list").alias("value")))


def definitions(t):
    """Parts as cluster definitions; odd sizes are application clusters."""
    c, size = F.col, F.col("p_size")
    odd = size % 2 == 1
    scheme = F.when(size % 3 == 0, "s3").when(size % 3 == 1, "hdfs")
    directory = F.concat(scheme, F.lit("://b1/"), "p_brand")
    strategy = F.when(size % 5 == 0, "none").when(size % 5 < 3, "fixed-delay").otherwise("failure-rate")
    return t.part.select(
        text("c", c("p_partkey")).alias("cluster_id"),
        F.lower("p_type").alias("namespace"),
        F.when(odd, "kubernetes-application").otherwise("kubernetes-session").alias("mode"),
        F.concat(F.lit("img:"), "p_brand").alias("image"),
        F.when(size % 4 == 0, F.lit("robot")).alias("k8s_account"),
        F.lit("ClusterIP").alias("rest_export"),
        F.struct((size - 5).cast("double").alias("jm"), F.lit(-1.0).alias("tm"), F.lit(1.5).alias("jm_factor"),
                 F.lit(0.0).alias("tm_factor")).alias("cpu"),
        F.struct((size * 100 - 1000).alias("jm_mb"), (size * 64).alias("tm_mb")).alias("mem"),
        F.struct((size % 6).alias("slots"), (size % 9 - 2).alias("parallelism")).alias("par"),
        F.struct((~odd).alias("submit"), (~odd).alias("cancel")).alias("webui"),
        F.struct(strategy.alias("strategy"), (size % 4).alias("attempts"), (size % 3).alias("delay_sec"),
                 F.lit(60).alias("interval_sec"), (size % 2).alias("max_failures")).alias("restart"),
        F.when(scheme.isNotNull(), F.struct(
            F.lit("rocksdb").alias("backend"), F.lit("filesystem").alias("storage"), directory.alias("checkpoint_dir"),
            F.lit(None).cast("string").alias("savepoint_dir"), odd.alias("incremental"),
            F.lit(False).alias("local_recovery"), (size % 3).alias("retained"))).alias("state"),
        F.when(size % 7 == 0, F.struct(F.lit(None).cast("string").alias("impl"), F.lit("s3a://b1/ha").alias("storage_dir"),
                                       F.lit(None).cast("string").alias("cluster_id"))).alias("ha"),
        F.when(size % 11 == 0, F.array(F.lit("hdfs://x/y.jar"), F.lit("s3p://b1/z.jar"))).alias("deps"),
        F.when(odd, F.concat(F.when(size % 13 == 0, "s3n://b1/").otherwise("local:///opt/"), F.lit("jobs/"),
                             F.regexp_replace("p_name", " ", "-"), F.lit(".jar"))).alias("job_jar"),
        F.when(odd, c("p_name")).alias("job_name"),
        F.create_map(F.lit("parallelism.default"), F.lit("99"), F.lit(" kubernetes.namespace "), F.lit("hack"),
                     F.lit("user.key"), F.concat(F.lit(" "), "p_brand"), F.lit("blank"), F.lit("  ")).alias("overrides"),
    )


NEEDS = """p_size % 3 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0 OR (p_size % 2 = 1 AND p_size % 13 = 0)"""


@case("p35_needs_object_store", f"SELECT concat('c', p_partkey) AS cluster_id, {NEEDS} AS needed FROM part")
def _(t):
    return G.needs_object_store(definitions(t)).select("cluster_id", F.col("needs_object_store").alias("needed"))


def _entry(key, value, where="true"):
    return f"SELECT cluster_id, namespace, '{key}' AS key, {value} AS value FROM d WHERE {where}"


DEFS = "d AS (SELECT *, concat('c', p_partkey) AS cluster_id, lower(p_type) AS namespace FROM part)"
_FIXED, _RATE, _STATE = "p_size % 5 IN (1, 2)", "p_size % 5 IN (3, 4)", "p_size % 3 <> 2"
BASE_ENTRIES = [
    _entry("execution.target", "CASE WHEN p_size % 2 = 1 THEN 'kubernetes-application' ELSE 'kubernetes-session' END"),
    _entry("kubernetes.cluster-id", "cluster_id"),
    _entry("kubernetes.namespace", "namespace"),
    _entry("kubernetes.container.image", "concat('img:', p_brand)"),
    _entry("kubernetes.jobmanager.service-account", "CASE WHEN p_size % 4 = 0 THEN 'robot' ELSE 'default' END"),
    _entry("kubernetes.rest-service.exposed.type", "'ClusterIP'"),
    _entry("blob.server.port", "'6124'"),
    _entry("taskmanager.rpc.port", "'6122'"),
    _entry("kubernetes.jobmanager.cpu", "concat(CASE WHEN p_size > 5 THEN p_size - 5 ELSE 1 END, '.0')"),
    _entry("kubernetes.jobmanager.cpu.limit-factor", "'1.5'"),
    _entry("kubernetes.taskmanager.cpu", "'-1.0'"),
    _entry("kubernetes.taskmanager.cpu.limit-factor", "'1.0'"),
    _entry("jobmanager.memory.process.size", "concat(CASE WHEN p_size > 10 THEN p_size * 100 - 1000 ELSE 1920 END, 'm')"),
    _entry("taskmanager.memory.process.size", "concat(p_size * 64, 'm')"),
    _entry("taskmanager.numberOfTaskSlots", "CAST(greatest(p_size % 6, 1) AS VARCHAR)"),
    _entry("web.submit.enable", "CAST(p_size % 2 = 0 AS VARCHAR)"),
    _entry("web.cancel.enable", "CAST(p_size % 2 = 0 AS VARCHAR)"),
    _entry("restart-strategy", f"CASE WHEN {_FIXED} THEN 'fixed-delay' WHEN {_RATE} THEN 'failure-rate' ELSE 'none' END"),
    _entry("restart-strategy.fixed-delay.attempts", "CAST(greatest(p_size % 4, 1) AS VARCHAR)", _FIXED),
    _entry("restart-strategy.fixed-delay.delay", "concat(greatest(p_size % 3, 1), ' s')", _FIXED),
    _entry("restart-strategy.failure-rate.delay", "concat(greatest(p_size % 3, 1), ' s')", _RATE),
    _entry("restart-strategy.failure-rate.failure-rate-interval", "'60 s'", _RATE),
    _entry("restart-strategy.failure-rate.max-failures-per-interval", "'1'", _RATE),
    _entry("state.backend", "'rocksdb'", _STATE),
    _entry("state.checkpoint-storage", "'filesystem'", _STATE),
    _entry("state.checkpoints.dir", "concat(CASE WHEN p_size % 3 = 0 THEN 's3' ELSE 'hdfs' END, '://b1/', p_brand)", _STATE),
    _entry("state.backend.incremental", "CAST(p_size % 2 = 1 AS VARCHAR)", _STATE),
    _entry("state.backend.local-recovery", "'false'", _STATE),
    _entry("state.checkpoints.num-retained", "'1'", _STATE),
    _entry("high-availability", f"'{G.HA_IMPL}'", "p_size % 7 = 0"),
    _entry("high-availability.storageDir", "'s3a://b1/ha'", "p_size % 7 = 0"),
    _entry("hive.s3.endpoint", "'http://store'", NEEDS),
    _entry("hive.s3.aws-secret-key", "'secret'", NEEDS),
    _entry("hive.s3.path-style-access", "'true'", NEEDS),
    _entry("pipeline.jars", """concat(CASE WHEN p_size % 13 = 0 THEN 'local:///opt/flink/lib/' ELSE 'local:///opt/jobs/' END,
      replace(p_name, ' ', '-'), '.jar')""", "p_size % 2 = 1"),
    _entry("pipeline.name", "p_name", "p_size % 2 = 1"),
    _entry("parallelism.default", "'99'"),
]
STORE = {"endpoint": "http://store", "secret_key": "secret", "path_style": True}


@case("p30_config_entries", f"WITH {DEFS} " + " UNION ALL ".join([
    *BASE_ENTRIES, _entry(" kubernetes.namespace ", "'hack'"), _entry("user.key", "concat(' ', p_brand)"),
    _entry("blank", "'  '")]))
def _(t):
    return G.config_entries(definitions(t), store=STORE)


@case("p31_config_value_text", """SELECT p_partkey, concat('brand=', p_brand, ';type=', p_type) AS map_text,
  concat(p_brand, ';', p_type) AS list_text, CAST(p_size AS VARCHAR) AS plain FROM part""")
def _(t):
    rows = t.part.select(
        "p_partkey", "p_size", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("m"),
        F.array("p_brand", "p_type").alias("a"),
    )
    value = lambda c: G.config_value_text(F.col(c), rows.schema[c].dataType)
    return rows.select("p_partkey", value("m").alias("map_text"), value("a").alias("list_text"),
                       value("p_size").alias("plain"))


@case("p32_merge_config", """SELECT p_partkey, 'a' AS key, p_brand AS value FROM part WHERE p_size % 2 = 1
  UNION ALL SELECT p_partkey, 'a', 'over' FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'b', p_type FROM part UNION ALL SELECT p_partkey, 'c', 'new' FROM part WHERE p_size % 2 = 0""")
def _(t):
    base = F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_type")
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("a"), F.lit("over"), F.lit("c"), F.lit("new")))
    return t.part.select("p_partkey", F.explode(G.merge_config(base, over)).alias("key", "value"))


@case("p33_redact", """SELECT p_partkey, concat('a.first=', p_brand, ',exec.mode=***,s3.secret-key=***,z=', p_type)
  AS shown FROM part""")
def _(t):
    config = F.create_map(F.lit("z"), "p_type", F.lit("s3.secret-key"), "p_name", F.lit("a.first"), "p_brand",
                          F.lit("exec.mode"), F.lit("x"))
    pairs = F.transform(G.redact(config), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.part.select("p_partkey", F.array_join(pairs, ",").alias("shown"))


@case("p34_remove_forbidden", """SELECT concat('c', p_partkey) AS cluster_id, 'parallelism.default' AS key, '99' AS value FROM part
  UNION ALL SELECT concat('c', p_partkey), 'user.key', p_brand FROM part""")
def _(t):
    kept = G.remove_forbidden(F.col("overrides"))
    return definitions(t).select("cluster_id", F.explode(kept).alias("key", "value"))


@case("p30_config_audit", f"WITH {DEFS}, e AS (" + " UNION ALL ".join(
    [*BASE_ENTRIES, _entry("user.key", "p_brand")]) + """)
  SELECT cluster_id, namespace, key, CASE WHEN key = 'hive.s3.aws-secret-key' THEN '***' ELSE value END AS value,
    false AS violation FROM e
  UNION ALL SELECT cluster_id, namespace, 'kubernetes.namespace', 'hack', true FROM d""")
def _(t):
    return G.config_audit(definitions(t), store=STORE)


@case("a6_merge_maps", """WITH m AS (SELECT p_partkey % 100 AS cluster, p_partkey, p_brand, p_type, p_size FROM part),
  e AS (SELECT cluster, p_partkey, concat('k', p_size % 5) AS key, p_brand AS value FROM m
    UNION ALL SELECT cluster, p_partkey, 'type', p_type FROM m)
  SELECT cluster, key, arg_max(value, p_partkey) AS value FROM e GROUP BY cluster, key""")
def _(t):
    data = F.create_map(text("k", F.col("p_size") % 5), "p_brand", F.lit("type"), "p_type")
    rows = t.part.select((F.col("p_partkey") % 100).alias("cluster"), F.col("p_partkey").alias("name"), data.alias("data"))
    return aggregates.merge_maps(rows, ["cluster"])
