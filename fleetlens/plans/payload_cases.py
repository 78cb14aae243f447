"""Payloads and resource objects. The JSON texts are built by Spark from the sample tables, in groups of at most ten rows."""

from pyspark.sql import functions as F

from fleetlens.functions.quantity import parse_quantity
from fleetlens.operators import joins, state
from fleetlens.operators.changes import tail
from fleetlens.plans.registry import case
from fleetlens.plans.roles import cents, epoch_ms, text
from fleetlens.schemas import TASK_STATES
from fleetlens.sources import logs, objects, payloads, storage_check


def _batch(df, key, per, items, order):
    """One JSON array text per group of `per` consecutive keys."""
    group = F.floor(F.col(key) / per).alias("batch")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*items).alias("i"))))
    return df.groupBy(group).agg(F.transform(ordered, lambda x: x["i"]).alias("items"))


def _keyed(df):
    return df.withColumns({"cluster_id": text("c", F.col("batch")), "namespace": F.lit("ns"), "ts": F.lit(1000)})


def _job_payloads(t):
    tasks = F.struct(*[(F.col("o_custkey") % (i + 2)).cast("int").alias(s) for i, s in enumerate(TASK_STATES)])
    items = [
        F.col("o_orderkey").cast("string").alias("jid"), text("job-", F.col("o_orderkey") % 7).alias("name"),
        F.col("o_orderstatus").alias("state"), epoch_ms("o_orderdate").alias("start-time"),
        F.lit(-1).alias("end-time"), epoch_ms("o_orderdate").alias("last-modification"), tasks.alias("tasks"),
    ]
    rows = _keyed(_batch(t.orders, "o_orderkey", 8, items, "o_orderkey"))
    return rows.withColumn("payload", F.to_json(F.struct(F.col("items").alias("jobs"))))


@case("s1_payload_job_overview", """SELECT concat('c', o_orderkey // 8) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS job_id,
  concat('job-', o_orderkey % 7) AS job_name, o_orderstatus AS state, epoch_ms(o_orderdate) AS start_ts,
  CAST(-1 AS BIGINT) AS end_ts, CAST(o_custkey % 2 AS INTEGER) AS total, CAST(o_custkey % 6 AS INTEGER) AS running,
  CAST(o_custkey % 12 AS INTEGER) AS initializing FROM orders""")
def _(t):
    rows = payloads.payload_job_overview(_job_payloads(t))
    tasks = [F.col(f"tasks.{s}").alias(s) for s in ("total", "running", "initializing")]
    return rows.select("cluster_id", "job_id", "job_name", "state", "start_ts", "end_ts", *tasks)


def checked_payloads(t):
    """Job payloads of which each tenth is cut off; running and finished jobs have known states, the others don't."""
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("P")
    items = [F.col("o_orderkey").cast("string").alias("jid"), state.alias("state")]
    rows = _keyed(_batch(t.orders, "o_orderkey", 8, items, "o_orderkey"))
    whole = F.to_json(F.struct(F.col("items").alias("jobs")))
    return rows.withColumn("payload", F.when(F.col("batch") % 10 == 3, F.left(whole, F.lit(20))).otherwise(whole)).drop("items")


CHECKED = """b AS (SELECT o_orderkey // 8 AS batch, CAST(o_orderkey AS VARCHAR) AS job_id,
    CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FINISHED' ELSE 'P' END AS state FROM orders),
  checked AS (SELECT concat('c', batch) AS cluster_id, job_id, state, CASE state WHEN 'P' THEN 'state' ELSE '' END AS broken
    FROM b WHERE batch % 10 <> 3 UNION ALL SELECT DISTINCT concat('c', batch), NULL, NULL, 'payload' FROM b WHERE batch % 10 = 3)"""


@case("s1_unreadable", f"WITH {CHECKED} SELECT cluster_id, job_id FROM checked WHERE broken = 'payload'")
def _(t):
    rows = payloads.checked_job_overview(checked_payloads(t))
    return rows.filter(F.array_contains("broken_rules", "payload")).select("cluster_id", "job_id")


@case("s1_unknown_state", f"WITH {CHECKED} SELECT * FROM checked")
def _(t):
    rows = payloads.checked_job_overview(checked_payloads(t))
    return rows.select("cluster_id", "job_id", "state", F.array_join("broken_rules", ",").alias("broken"))


@case("s2_checked_job_status", f"""WITH {CHECKED} SELECT cluster_id, CASE broken WHEN 'payload' THEN 'payload' ELSE 'state' END
    AS broken, count(*) AS n FROM checked GROUP BY 1, 2""")
def _(t):
    known = F.expr("transform(items, i -> named_struct('id', i.jid, 'status', i.state))")
    items = [F.col("o_orderkey").cast("string").alias("jid"), F.lit("x").alias("state")]
    rows = _keyed(_batch(t.orders, "o_orderkey", 8, items, "o_orderkey")).withColumn("items", known)
    whole = F.to_json(F.struct(F.col("items").alias("jobs")))
    rows = rows.withColumn("payload", F.when(F.col("batch") % 10 == 3, F.left(whole, F.lit(20))).otherwise(whole))
    found = payloads.checked_job_status(rows)
    return found.groupBy("cluster_id", F.array_join("broken_rules", ",").alias("broken")).agg(F.count("*").alias("n"))


@case("s12_unknown_kind", """SELECT p_partkey AS seq, CASE p_partkey % 5 WHEN 3 THEN 'config_map' END AS kind
  FROM part WHERE p_partkey % 5 >= 3""")
def _(t):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("deployment", "service", "pod", "config_map", None)]),
                         (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = t.part.select(F.col("p_partkey").alias("seq"), kinds.alias("kind"), F.lit("{}").alias("object"))
    return objects.unknown_kinds(rows).select("seq", "kind")


@case("s2_payload_job_status", """SELECT concat('c', o_orderkey // 8) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS job_id,
  o_orderstatus AS state FROM orders""")
def _(t):
    items = [F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status")]
    rows = _keyed(_batch(t.orders, "o_orderkey", 8, items, "o_orderkey"))
    rows = rows.withColumn("payload", F.to_json(F.struct(F.col("items").alias("jobs"))))
    return payloads.payload_job_status(rows).drop("namespace")


def _metric_payloads(t):
    items = [F.col("event_type").alias("id"), cents("value").cast("string").alias("value")]
    rows = _keyed(_batch(t.events, "event_id", 10, items, "event_id"))
    return rows.withColumn("payload", F.to_json("items"))


@case("s3_payload_metrics", """SELECT concat('c', event_id // 10) AS cluster_id, event_type AS id,
  CAST(CAST(round(arg_max(value, event_id) * 100) AS BIGINT) AS VARCHAR) AS value FROM events GROUP BY 1, 2""")
def _(t):
    rows = payloads.payload_metrics(_metric_payloads(t), keys=["cluster_id"])
    return rows.select("cluster_id", F.explode("metrics").alias("id", "value"))


@case("s4_payload_metric_keys", "SELECT DISTINCT concat('c', event_id // 10) AS cluster_id, event_type AS id FROM events")
def _(t):
    return payloads.payload_metric_keys(_metric_payloads(t), keys=["cluster_id"])


@case("s5_payload_cluster_overview", """SELECT concat('c', c_custkey) AS cluster_id, concat('1.', c_nationkey) AS version,
  c_nationkey AS members, c_nationkey * 4 AS slots_total, c_nationkey + 1 AS slots_available, c_nationkey % 3 AS running,
  c_nationkey % 4 AS finished, c_nationkey % 5 AS canceled, c_nationkey % 6 AS failed FROM customer""")
def _(t):
    n = F.col("c_nationkey")
    fields = {
        "flink-version": text("1.", n), "taskmanagers": n, "slots-total": n * 4, "slots-available": n + 1,
        "jobs-running": n % 3, "jobs-finished": n % 4, "jobs-cancelled": n % 5, "jobs-failed": n % 6,
    }
    rows = _keyed(t.customer.withColumn("batch", F.col("c_custkey")))
    rows = rows.withColumn("payload", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))
    out = payloads.payload_cluster_overview(rows)
    return out.select("cluster_id", "version", "members", "slots_total", "slots_available", "jobs.*")


@case("s6_payload_kv_config", """SELECT concat('c', p_partkey) AS cluster_id, 'brand' AS key, p_type AS value FROM part
  UNION ALL SELECT concat('c', p_partkey), 'size', CAST(p_size AS VARCHAR) FROM part""")
def _(t):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    config = F.array(pair("brand", F.col("p_brand")), pair("size", F.col("p_size").cast("string")),
                     pair("brand", F.col("p_type")))
    rows = _keyed(t.part.withColumn("batch", F.col("p_partkey"))).withColumn("payload", F.to_json(config))
    return payloads.payload_kv_config(rows).select("cluster_id", F.explode("config").alias("key", "value"))


@case("s7_payload_member_ids", """SELECT concat('c', o_orderkey // 8) AS cluster_id, concat('tm-', o_orderkey) AS tid
  FROM orders""")
def _(t):
    rows = _keyed(_batch(t.orders, "o_orderkey", 8, [text("tm-", F.col("o_orderkey")).alias("id")], "o_orderkey"))
    rows = rows.withColumn("payload", F.to_json(F.struct(F.col("items").alias("taskmanagers"))))
    return payloads.payload_member_ids(rows).drop("namespace")


@case("s8_payload_member_detail", """SELECT concat('c', l_orderkey) AS cluster_id, concat('tm-', l_linenumber) AS tid,
  l_linenumber AS slots, l_partkey AS total_managed, l_suppkey AS free_network, l_partkey * 1024 AS physical,
  l_suppkey * 2 AS jvm_overhead, CAST(NULL AS BIGINT) AS task_heap FROM lineitem""")
def _(t):
    c = F.col
    detail = F.struct(
        text("tm-", c("l_linenumber")).alias("id"), c("l_linenumber").alias("slotsNumber"),
        F.struct(F.lit(1.5).alias("cpuCores"), c("l_partkey").alias("managedMemory")).alias("totalResource"),
        F.struct(c("l_suppkey").alias("networkMemory")).alias("freeResource"),
        F.struct((c("l_partkey") * 1024).alias("physicalMemory")).alias("hardware"),
        F.struct((c("l_suppkey") * 2).alias("jvmOverhead")).alias("memoryConfiguration"),
    )
    rows = _keyed(t.lineitem.withColumn("batch", c("l_orderkey"))).withColumn("payload", F.to_json(detail))
    return payloads.payload_member_detail(rows).select(
        "cluster_id", "tid", c("slotsNumber").alias("slots"), c("totalResource.managedMemory").alias("total_managed"),
        c("freeResource.networkMemory").alias("free_network"), c("hardware.physicalMemory").alias("physical"),
        c("memoryConfiguration.jvmOverhead").alias("jvm_overhead"),
        c("memoryConfiguration.taskHeap").alias("task_heap"),
    )


@case("s9_payload_op_status", """SELECT event_id AS trigger_id,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS state,
  CASE WHEN event_type = 'error' THEN concat('failed: ', user_id) END AS failure_cause FROM events""")
def _(t):
    kind = F.col("event_type")
    cause = F.struct(F.struct(text("failed: ", F.col("user_id")).alias("stack-trace")).alias("failure-cause"))
    status = F.struct(F.when(kind.isin("purchase", "error"), "COMPLETED").otherwise("IN_PROGRESS").alias("id"))
    body = F.to_json(F.struct(status.alias("status"), F.when(kind == "error", cause).alias("operation")))
    rows = t.events.select(F.col("event_id").alias("trigger_id"), body.alias("payload"))
    return payloads.payload_op_status(rows, keys=["trigger_id"])


@case("s10_payload_pod_usage", """SELECT event_id, epoch_us(ts) // 1000 AS ts, 'main' AS container,
  CAST(user_id AS DOUBLE) AS cpu, 'm' AS cpu_unit, CAST(user_id * 2 AS DOUBLE) AS memory, 'Ki' AS memory_unit FROM events
  UNION ALL SELECT event_id, epoch_us(ts) // 1000, 'side', 1.5, 'k', 2.0, 'Gi' FROM events WHERE user_id % 2 = 0""")
def _(t):
    c = F.col
    one = lambda name, cpu, memory: F.struct(
        F.lit(name).alias("name"), F.struct(cpu.alias("cpu"), memory.alias("memory")).alias("usage"))
    main = one("main", F.concat(c("user_id").cast("string"), F.lit("m")),
               F.concat((c("user_id") * 2).cast("string"), F.lit("Ki")))
    side = one("side", F.lit("1.5"), F.lit("2Gi"))
    boxes = F.when(c("user_id") % 2 == 0, F.array(main, side)).otherwise(F.array(main))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(stamp.alias("timestamp"), boxes.alias("containers")))
    rows = payloads.payload_pod_usage(t.events.select("event_id", body.alias("payload")), keys=["event_id"])
    return rows.select("event_id", "ts", F.explode("containers").alias("x")).select(
        "event_id", "ts", c("x.name").alias("container"), c("x.cpu.value").alias("cpu"), c("x.cpu.unit").alias("cpu_unit"),
        c("x.memory.value").alias("memory"), c("x.memory.unit").alias("memory_unit"),
    )


def _meta(name, namespace, created, labels=None):
    fields = [name.alias("name"), namespace.alias("namespace"), created.alias("creationTimestamp")]
    return F.struct(*fields, *([labels.alias("labels")] if labels is not None else []))


def _labels(app, component, native=None):
    pairs = [F.lit("app"), app, F.lit("component"), component]
    return F.create_map(*pairs, F.lit("type"), native if native is not None else F.lit("flink-native-kubernetes"))


def _stamp(col):
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


@case("s11_read_changelog", """SELECT event_id AS seq, CASE WHEN event_id % 997 = 0 THEN 'Reseted' ELSE 'Added' END AS op,
  ['deployment', 'service', 'pod', 'configmap'][CAST(user_id % 4 AS INTEGER) + 1] AS kind,
  CASE WHEN event_id % 997 <> 0 THEN concat('o-', user_id) END AS name FROM events
  WHERE user_id % 6 < 4 AND (event_id % 997 = 0 OR (event_type <> 'view' AND user_id % 10 = 3))""")
def _(t):
    c, user = F.col, F.col("user_id")
    kinds = F.array(*[F.lit(k) for k in ("deployment", "service", "pod", "configmap")])
    kind = F.when(user % 6 < 4, F.get(kinds, (user % 4).cast("int"))).otherwise("secret")
    native = F.when(c("event_type") == "view", "other").otherwise("flink-native-kubernetes")
    body = F.to_json(F.struct(
        _meta(text("o-", user), F.lit("ns"), _stamp("ts"), _labels(text("c", user % 10), F.lit("x"), native)).alias("metadata")))
    reset = c("event_id") % 997 == 0
    events = t.events.select(
        F.when(reset, "Reseted").otherwise("Added").alias("op"), kind.alias("kind"), F.lit("s").alias("scope"),
        c("event_id").alias("seq"), F.when(~reset, body).alias("object"),
    )
    return objects.read_changelog(events, cluster="c3").select("seq", "op", "kind", "name")


def _services(t):
    c, key = F.col, F.col("s_suppkey")
    port = lambda name, number, target: F.struct(
        name.alias("name"), F.lit("TCP").alias("protocol"), number.cast("int").alias("port"), target.alias("targetPort"))
    ports = F.array(
        port(F.when(key % 5 != 0, F.lit("rest")), key + 8000, F.lit("8081")),
        port(F.lit("blob"), F.lit(6124), text("", key + 6000)),
    )
    spec = F.struct(
        F.when(key % 7 != 0, text("10.0.0.", key)).alias("clusterIP"),
        F.when(key % 11 != 0, _labels(text("c", key), F.lit("jobmanager"))).alias("selector"), ports.alias("ports"))
    name = F.concat("s_name", F.when(key % 2 == 0, F.lit("-rest")).otherwise(F.lit("")))
    body = F.struct(_meta(name, text("n", c("s_nationkey")), F.lit("2024-01-01T00:00:10Z")).alias("metadata"), spec.alias("spec"))
    return t.supplier.select(F.lit("service").alias("kind"), F.to_json(body).alias("object"))


SERVICES = """svc AS (SELECT s_suppkey AS k, concat('c', s_suppkey) AS cluster_id, concat('n', s_nationkey) AS namespace,
  concat(s_name, CASE WHEN s_suppkey % 2 = 0 THEN '-rest' ELSE '' END) AS name,
  CASE WHEN s_suppkey % 7 <> 0 THEN concat('10.0.0.', s_suppkey) END AS cluster_ip FROM supplier)"""


@case("s12a_service_rows", f"""WITH {SERVICES} SELECT cluster_id, namespace, name, 'jobmanager' AS component, cluster_ip,
  concat(name, '.', namespace) AS dns, k % 2 = 0 AS is_rest, CAST(1704067210 AS BIGINT) AS create_time,
  concat('blob:6124:', k + 6000, CASE WHEN k % 5 <> 0 THEN concat(',rest:', k + 8000, ':8081') ELSE '' END) AS ports
  FROM svc WHERE k % 11 <> 0""")
def _(t):
    good, _ = objects.service_rows(_services(t))
    shown = F.transform("ports", lambda p: F.concat_ws(":", p["name"], p["port"].cast("string"), p["target_port"].cast("string")))
    cols = ["cluster_id", "namespace", "name", "component", "cluster_ip", "dns", "is_rest", "create_time"]
    return good.select(*cols, F.array_join(shown, ",").alias("ports"))


@case("f7_rejected_services", f"""WITH {SERVICES} SELECT name, 'cluster_id,component' AS broken FROM svc WHERE k % 11 = 0""")
def _(t):
    _, bad = objects.service_rows(_services(t))
    return bad.select("name", F.array_join("broken_rules", ",").alias("broken"))


ENDS = f"""{SERVICES}, ends AS (SELECT *, k + 8000 AS port, concat(name, '.', namespace) AS dns FROM svc
  WHERE k % 11 <> 0 AND k % 2 = 0 AND k % 7 <> 0 AND k % 5 <> 0)"""


@case("p11_endpoint_from_service", f"""WITH {ENDS} SELECT cluster_id, namespace, name AS svc_name, CAST(port AS INTEGER) AS port,
  cluster_ip FROM ends""")
def _(t):
    rows = objects.endpoint_from_service(objects.service_rows(_services(t))[0])
    return rows.drop("svc_ns")


@case("p10_endpoint_urls", f"""WITH {ENDS} SELECT cluster_id, dns, concat('http://', dns, ':', port) AS dns_rest,
  concat('http://', cluster_ip, ':', port) AS cluster_ip_rest, concat('http://', dns, ':', port) AS url, dns AS host FROM ends""")
def _(t):
    rows = objects.endpoint_table(objects.service_rows(_services(t))[0])
    return rows.select("cluster_id", "dns", "dns_rest", "cluster_ip_rest", "url", "host")


@case("p14_port_choice", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey + 9000 AS INTEGER) ELSE 8081 END AS port
  FROM supplier""")
def _(t):
    ports = F.array(F.struct(F.when(F.col("s_suppkey") % 3 == 0, 8081).otherwise(80).alias("port"),
                             (F.col("s_suppkey") + 9000).cast("int").alias("target_port")))
    return t.supplier.select("s_suppkey", objects.port_choice(ports).alias("port"))


def _conditions(key):
    """Three conditions whose times tie for some keys; one has no time, one an unknown status."""
    one = lambda kind, status, sec: F.struct(
        F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit("r").alias("reason"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad(sec.cast("string"), 2, "0"), F.lit("Z")).alias("lastTransitionTime"))
    return F.array(one("A", "True", key % 3 + 10), one("B", "maybe", key % 2 + 10), one("C", "False", F.when(key % 4 == 0, key % 5 + 10)))


CONDITIONS = """conds AS (SELECT o_orderkey, pos, kind, status, CASE WHEN sec IS NULL THEN 0 ELSE sec END AS sec FROM (
  SELECT o_orderkey, 0 AS pos, 'A' AS kind, 'True' AS status, o_orderkey % 3 + 10 AS sec FROM orders
  UNION ALL SELECT o_orderkey, 1, 'B', 'Unknown', o_orderkey % 2 + 10 FROM orders
  UNION ALL SELECT o_orderkey, 2, 'C', 'False', CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 + 10 END FROM orders)),
  shown AS (SELECT o_orderkey, string_agg(concat(kind, '=', status), ',' ORDER BY sec DESC, pos DESC) AS conditions
  FROM conds GROUP BY o_orderkey)"""


@case("s12b_deployment_rows", f"""WITH {CONDITIONS} SELECT concat('c', o_custkey) AS cluster_id, o_orderpriority AS namespace,
  concat('d-', o_orderkey) AS name, epoch_ms(o_orderdate) // 1000 AS create_time, CAST(o_orderkey % 9 AS INTEGER) AS replicas,
  0 AS ready_replicas, conditions FROM orders JOIN shown USING (o_orderkey)""")
def _(t):
    c, key = F.col, F.col("o_orderkey")
    body = F.struct(
        _meta(text("d-", key), c("o_orderpriority"), _stamp("o_orderdate")).alias("metadata"),
        F.struct(F.struct(_labels(text("c", c("o_custkey")), F.lit("jobmanager")).alias("matchLabels")).alias("selector")).alias("spec"),
        F.struct((key % 9).alias("replicas"), _conditions(key).alias("conditions")).alias("status"))
    good, _ = objects.deployment_rows(t.orders.select(F.to_json(body).alias("object")))
    cols = ["cluster_id", "namespace", "name", "create_time", "replicas", "ready_replicas"]
    return good.select(*cols, _show_conditions().alias("conditions"))


def _show_conditions():
    return F.array_join(F.transform("conditions", lambda x: F.concat_ws("=", x["type"], x["status"])), ",")


@case("p12_normalize_conditions", f"WITH {CONDITIONS} SELECT o_orderkey, conditions FROM shown")
def _(t):
    raw = F.from_json(F.to_json(_conditions(F.col("o_orderkey"))),
                      "array<struct<type:string,status:string,reason:string,message:string,lastTransitionTime:string>>")
    rows = t.orders.select("o_orderkey", objects.normalize_conditions(raw).alias("conditions"))
    return rows.select("o_orderkey", _show_conditions().alias("conditions"))


def _pods(t):
    c, n = F.col, F.col("l_linenumber")
    started = F.struct(_stamp("l_shipdate").alias("startedAt"))
    state = F.struct(
        F.when(n % 3 == 0, started).alias("running"),
        F.when(n % 3 == 1, F.struct(F.lit("pulling").alias("message"), F.lit("wait").alias("reason"))).alias("waiting"),
        F.when(n == 5, F.struct(n.alias("exitCode"), F.lit("boom").alias("message"))).alias("terminated"))
    status = F.struct(F.lit("main").alias("name"), F.lit("img").alias("image"), (n > 3).alias("ready"), n.alias("restartCount"), state.alias("state"))
    limits = F.create_map(F.lit("cpu"), F.concat(c("l_quantity").cast("int").cast("string"), F.lit("m")))
    spec = lambda name, lim: F.struct(F.lit(name).alias("name"), F.struct(lim.alias("limits")).alias("resources"))
    specs = F.array(spec("main", F.create_map(F.lit("cpu"), F.lit("1"))), spec("main", limits), spec("other", limits))
    name = F.concat(text("p-", c("l_orderkey")), text("-", n))
    body = F.struct(
        _meta(name, c("l_returnflag"), _stamp("l_shipdate"), _labels(text("c", c("l_suppkey")), F.lit("taskmanager"))).alias("metadata"),
        F.struct(specs.alias("containers")).alias("spec"),
        F.struct(F.when(n % 2 == 0, "Running").otherwise("Odd").alias("phase"), F.array(status).alias("containerStatuses")).alias("status"))
    return t.lineitem.select(F.to_json(body).alias("object"))


PODS = """pods AS (SELECT concat('c', l_suppkey) AS cluster_id, concat('p-', l_orderkey, '-', l_linenumber) AS name,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Running' ELSE 'Unknown' END AS phase, l_linenumber AS restart_count,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Running' WHEN l_linenumber % 3 = 1 THEN 'Waiting' WHEN l_linenumber = 5 THEN 'Terminated'
    ELSE 'Unknown' END AS state, floor(l_quantity) AS cpu, epoch_ms(l_shipdate) // 1000 AS created FROM lineitem)"""


@case("s12c_pod_rows", f"""WITH {PODS} SELECT cluster_id, name, phase, restart_count, state, created AS create_time,
  CASE state WHEN 'Running' THEN created END AS started_at,
  CASE state WHEN 'Waiting' THEN 'pulling' WHEN 'Terminated' THEN 'boom' END AS message,
  CASE state WHEN 'Terminated' THEN restart_count END AS exit_code, cpu AS cpu_limit, 'm' AS cpu_unit,
  CAST(NULL AS DOUBLE) AS memory_limit FROM pods""")
def _(t):
    good, _ = objects.pod_rows(_pods(t))
    x = F.explode("containers").alias("x")
    return good.select("cluster_id", "name", "phase", "create_time", x).select(
        "cluster_id", "name", "phase", "create_time", "x.restart_count", "x.state", "x.state_detail.started_at",
        "x.state_detail.message", "x.state_detail.exit_code", F.col("x.cpu_limit.value").alias("cpu_limit"),
        F.col("x.cpu_limit.unit").alias("cpu_unit"), F.col("x.memory_limit.value").alias("memory_limit"),
    )


@case("p13_resolve_container_state", """SELECT event_id, CASE event_type WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Waiting'
  WHEN 'error' THEN 'Terminated' ELSE 'Unknown' END AS state, CASE event_type WHEN 'error' THEN 137 END AS exit_code FROM events""")
def _(t):
    kind = F.col("event_type")
    null = F.lit(None).cast("string")
    state = F.struct(
        F.when(kind == "view", F.struct(null.alias("startedAt"))).alias("running"),
        F.when(kind == "click", F.struct(null.alias("message"), null.alias("reason"))).alias("waiting"),
        F.when(kind.isin("error", "view"), F.struct(
            F.lit(137).alias("exitCode"), null.alias("message"), null.alias("reason"), F.lit(None).cast("int").alias("signal"),
            null.alias("startedAt"), null.alias("finishedAt"))).alias("terminated"))
    resolved = objects.resolve_container_state(F.col("s"))
    rows = t.events.select("event_id", state.alias("s")).withColumn("r", resolved)
    return rows.select("event_id", "r.state", "r.detail.exit_code")


@case("s12_workload_rows", f"""WITH {SERVICES} SELECT 'service' AS kind, name, k % 11 <> 0 AS good FROM svc
  UNION ALL SELECT 'pod', concat('p-', l_orderkey, '-', l_linenumber), true FROM lineitem""")
def _(t):
    every = _services(t).unionByName(_pods(t).withColumn("kind", F.lit("pod")))
    sides = [
        side.select("kind", "name", F.lit(good).alias("good"))
        for pair in objects.workload_rows(every).values() for side, good in zip(pair, (True, False))
    ]
    return state.union_all(sides)


@case("s13_read_log_lines", """SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 86400 SECONDS
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2""")
def _(t):
    lines = t.events.select("event_id", "user_id", "ts")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    out = logs.read_log_lines(lines, now, since_sec=86_400, tail=2, keys=["user_id"], order=["event_id"])
    return out.drop("ts")


@case("s13_main_container_log", """SELECT event_id, user_id FROM events WHERE event_type NOT IN ('click', 'error')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3""")
def _(t):
    # side-car lines don't count towards the tail; lines of an unknown container belong to no log
    kind = F.col("event_type")
    name = F.when(kind == "click", "sidecar").when(kind == "error", None).otherwise("flink-main-container")
    lines = t.events.select("event_id", "user_id", name.alias("container"))
    return logs.read_log_lines(lines, tail=3, keys=["user_id"], order=["event_id"]).drop("container")


LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"""


@case("s13_log_lines_of_texts", f"WITH {LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, text FROM lines")
def _(t):
    return logs.explode_lines(t.documents, ["doc_id"])


@case("w4_tail", """SELECT conv_id, turn, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", "text")
    return logs.read_log_lines(rows, tail=3, keys=["conv_id"], order=["turn"])


@case("w4_tail_hot_keys", """SELECT user_id, event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 7""")
def _(t):
    # every user counts as hot here
    return tail(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 7, rows=10)


@case("s14_config_map_data", """SELECT c_custkey AS name, 'k' AS key, p_brand AS value FROM customer JOIN part
  ON c_custkey = p_partkey WHERE p_size % 2 = 0""")
def _(t):
    data = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("k"), F.col("p_brand")))
    maps = t.part.select(F.col("p_partkey").alias("name"), F.to_json(F.struct(data.alias("data"))).alias("object"))
    wanted = t.customer.select(F.col("c_custkey").alias("name"))
    return objects.config_map_data(wanted, maps, ["name"]).select("name", F.explode("data").alias("key", "value"))


@case("s14_empty_config_maps", """SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN
  (SELECT p_partkey FROM part WHERE p_size % 2 = 0)""")
def _(t):
    data = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("k"), F.col("p_brand")))
    maps = t.part.select(F.col("p_partkey").alias("name"), F.to_json(F.struct(data.alias("data"))).alias("object"))
    wanted = t.customer.select(F.col("c_custkey").alias("name"))
    return objects.config_map_data(wanted, maps, ["name"]).filter(F.size("data") == 0).select("name")


@case("s15_resource_spec", """SELECT c_custkey AS name, CASE WHEN p_size % 3 <> 0 THEN concat('{"image":"', p_brand, '"}') END AS spec
  FROM customer LEFT JOIN part ON c_custkey = p_partkey""")
def _(t):
    spec = F.when(F.col("p_size") % 3 != 0, F.struct(F.col("p_brand").alias("image")))
    held = t.part.select(
        F.col("p_partkey").alias("name"), F.lit("pod").alias("kind"), F.to_json(F.struct(spec.alias("spec"))).alias("object"))
    wanted = t.customer.select(F.col("c_custkey").alias("name"))
    return objects.resource_spec(wanted, held, "pod", ["name"])


@case("s16_scan_namespace", """SELECT DISTINCT concat('c', o_custkey) AS cluster_id, o_orderpriority AS namespace FROM orders
  WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AND o_orderkey % 5 <> 0""")
def _(t):
    c = F.col
    native = F.when(c("o_orderstatus") == "O", "flink-native-kubernetes").otherwise("other")
    name = F.when(c("o_orderkey") % 5 != 0, text("c", c("o_custkey")))
    meta = _meta(name, c("o_orderpriority"), _stamp("o_orderdate"), _labels(F.lit("a"), F.lit("b"), native))
    rows = t.orders.select(F.to_json(F.struct(meta.alias("metadata"))).alias("object"))
    return objects.scan_namespace(rows, "2-HIGH")


@case("s21_check_paths", """SELECT event_id, event_id % 4 < 2 AS "exists" FROM events""")
def _(t):
    names = F.array(*[F.lit(n) for n in ("/orders.parquet", "lineitem.parquet", "missing.parquet", "orders")])
    refs = t.events.select("event_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("path"))
    return storage_check.check_paths(refs, storage_check.list_files(t.spark, t.folder)).select("event_id", "exists")


@case("s21_check_objects", """SELECT event_id, event_id % 5 < 2 AS "exists" FROM events""")
def _(t):
    names = F.array(*[F.lit(n) for n in ("/orders.parquet", "lineitem.parquet", "missing.parquet", "./orders.parquet", None)])
    refs = t.events.select("event_id", F.get(names, (F.col("event_id") % 5).cast("int")).alias("path"))
    return storage_check.check_objects(refs, t.folder, tasks=4).select("event_id", "exists")


@case("j3_container_quantities", """SELECT l_orderkey, l_linenumber, CAST(p_size AS DOUBLE) AS cpu, 'm' AS cpu_unit FROM lineitem
  JOIN part ON l_partkey = p_partkey""")
def _(t):
    specs = t.part.select(
        F.col("p_partkey").alias("pod"), F.lit("main").alias("container"), F.lit(0).alias("position"),
        F.concat(F.col("p_size").cast("string"), F.lit("m")).alias("cpu_limit"))
    status = t.lineitem.select(F.col("l_partkey").alias("pod"), F.lit("main").alias("container"), "l_orderkey", "l_linenumber")
    rows = joins.with_container_resources(status, specs, cols=("cpu_limit",)).withColumn("q", parse_quantity(F.col("cpu_limit")))
    return rows.select("l_orderkey", "l_linenumber", F.col("q.value").alias("cpu"), F.col("q.unit").alias("cpu_unit"))
