"""Resource objects of clusters (deployments, services, pods, config maps) and their change events."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas as S
from fleetlens.functions.columns import decode_enum
from fleetlens.functions.keys import CLUSTER
from fleetlens.functions.quantity import parse_quantity
from fleetlens.operators.query import quarantine, with_broken_rules
from fleetlens.operators.state import latest_per_key
from fleetlens.session import run_dir
from fleetlens.sources.payloads import parsed


def read_changelog(events, cluster=None, kinds=("deployment", "service", "pod", "configmap")):
    """Change events of native clusters, with the labels taken from the object. Resets carry no object.

    `events` is a batch or streaming frame of (op, kind, scope, seq, object); `cluster` keeps one application.
    """
    label = lambda name: F.get_json_object("object", f"$.metadata.labels.{name}")
    native = label(S.TYPE_LABEL) == S.NATIVE_TYPE
    app = label(S.APP_LABEL)
    wanted = native & (app == cluster) if cluster is not None else native & app.isNotNull()
    rows = events.filter(F.col("kind").isin(*kinds) & ((F.col("op") == "Reseted") | wanted))
    return rows.withColumn("name", F.get_json_object("object", "$.metadata.name"))


def scan_namespace(deployments, namespace):
    """Distinct clusters among the native deployments of one namespace; rows without a name are left out."""
    d = parsed(deployments, S.DEPLOYMENT_OBJECT, "object", "_o").select(
        F.col("_o.metadata.name").alias("cluster_id"),
        F.col("_o.metadata.namespace").alias("namespace"),
        F.col("_o.metadata.labels").alias("labels"),
    )
    hit = (F.element_at("labels", F.lit(S.TYPE_LABEL)) == S.NATIVE_TYPE) & F.col("cluster_id").isNotNull()
    return d.filter(hit & (F.col("namespace") == namespace)).select("cluster_id", "namespace").distinct()


def _epoch(col):
    return F.unix_seconds(F.try_to_timestamp(col))


def normalize_conditions(col):
    """Conditions with checked status, newest transition first. Of equal times the later entry comes first."""
    placed = F.transform(
        F.coalesce(col, F.array().cast(S.CONDITIONS)),
        lambda c, i: F.struct(
            F.coalesce(_epoch(c["lastTransitionTime"]), F.lit(0).cast("bigint")).alias("_time"),
            i.alias("_pos"),
            F.struct(
                c["type"].alias("type"),
                decode_enum(c["status"], S.CONDITION_STATUSES, "default", "Unknown").alias("status"),
                c["reason"].alias("reason"),
                c["message"].alias("message"),
                _epoch(c["lastTransitionTime"]).alias("last_transition"),
            ).alias("_cond"),
        ),
    )
    return F.transform(F.sort_array(placed, asc=False), lambda x: x["_cond"])


def resolve_container_state(state):
    """struct(state, detail): the first of running, waiting, terminated that is present, else Unknown."""
    run, wait, term = state["running"], state["waiting"], state["terminated"]
    name = (
        F.when(run.isNotNull(), "Running")
        .when(wait.isNotNull(), "Waiting")
        .when(term.isNotNull(), "Terminated")
        .otherwise("Unknown")
    )
    pick = lambda *pairs: F.coalesce(*[F.when(name == n, v) for n, v in pairs])
    return F.struct(
        name.alias("state"),
        F.struct(
            pick(("Terminated", term["exitCode"])).alias("exit_code"),
            pick(("Waiting", wait["message"]), ("Terminated", term["message"])).alias("message"),
            pick(("Waiting", wait["reason"]), ("Terminated", term["reason"])).alias("reason"),
            pick(("Terminated", term["signal"])).alias("signal"),
            pick(("Running", _epoch(run["startedAt"])), ("Terminated", _epoch(term["startedAt"]))).alias("started_at"),
            pick(("Terminated", _epoch(term["finishedAt"]))).alias("finished_at"),
        ).alias("detail"),
    )


def _base(labels):
    o = F.col("_o")
    return {
        "cluster_id": F.element_at(labels, F.lit(S.APP_LABEL)),
        "namespace": o["metadata"]["namespace"],
        "name": o["metadata"]["name"],
        "component": F.element_at(labels, F.lit(S.COMPONENT_LABEL)),
        "create_time": _epoch(o["metadata"]["creationTimestamp"]),
    }


def _rows(df, shape):
    """(good, bad): bad rows lack a required field."""
    schema, cols, rules, helpers = shape
    good, bad = quarantine(parsed(df, schema, "object", "_o").withColumns(cols), rules)
    return good.drop("_o", "object", *helpers), bad.drop("_o", *helpers)


def _shape(schema, labels, cols, extra_rules, helpers=()):
    """How a kind is read: (schema, columns over `_o`, rules over the columns, columns that only rules need)."""
    rules = {c: F.col(c).isNotNull() for c in ("cluster_id", "namespace", "name", "component", "create_time")}
    return schema, {**_base(labels), **cols}, rules | extra_rules, helpers


def service_rows(df):
    """(services, rejected) from service objects. Ports without name, protocol or target port are dropped."""
    return _rows(df, _service_shape())


def _service_shape():
    ports = F.coalesce(F.col("_o")["spec"]["ports"], F.array().cast(
        "array<struct<name:string,protocol:string,port:int,targetPort:string>>"))
    whole = F.filter(
        ports, lambda p: p["name"].isNotNull() & p["protocol"].isNotNull() & p["targetPort"].isNotNull()
    )
    typed = F.transform(
        whole,
        lambda p: F.struct(
            p["name"].alias("name"), p["protocol"].alias("protocol"), p["port"].alias("port"),
            p["targetPort"].try_cast("int").alias("target_port"),
        ),
    )
    cols = {
        "cluster_ip": F.col("_o")["spec"]["clusterIP"],
        "ports": F.array_sort(F.array_distinct(typed)),
        "dns": F.concat_ws(".", F.col("_o")["metadata"]["name"], F.col("_o")["metadata"]["namespace"]),
        "is_rest": F.col("_o")["metadata"]["name"].endswith(S.REST_SUFFIX),
    }
    numbers = {"target_port": F.forall("ports", lambda p: p["target_port"].isNotNull())}
    return _shape(S.SERVICE_OBJECT, F.col("_o")["spec"]["selector"], cols, numbers)


def deployment_rows(df):
    """(deployments, rejected) from deployment objects. Missing counts are 0."""
    return _rows(df, _deployment_shape())


def _deployment_shape():
    o = F.col("_o")
    counts = {
        "observed_generation": "observedGeneration", "replicas": "replicas", "ready_replicas": "readyReplicas",
        "unavailable_replicas": "unavailableReplicas", "available_replicas": "availableReplicas",
        "updated_replicas": "updatedReplicas",
    }
    cols = {name: F.coalesce(o["status"][raw], F.lit(0)) for name, raw in counts.items()}
    cols["conditions"] = normalize_conditions(o["status"]["conditions"])
    cols["has_status"] = o["status"].isNotNull()
    labels = o["spec"]["selector"]["matchLabels"]
    return _shape(S.DEPLOYMENT_OBJECT, labels, cols, {"status": F.col("has_status")}, ["has_status"])


def pod_rows(df):
    """(pods, rejected) from pod objects, with the resources of each container looked up by name in the same row."""
    return _rows(df, _pod_shape())


def _pod_shape():
    o = F.col("_o")
    specs = F.coalesce(o["spec"]["containers"], F.array().cast(_pod_type("spec", "containers")))
    statuses = F.coalesce(o["status"]["containerStatuses"], F.array().cast(_pod_type("status", "containerStatuses")))
    paired = F.transform(
        statuses,
        lambda c: F.struct(
            c.alias("c"),
            F.try_element_at(F.filter(specs, lambda s: s["name"] == c["name"]), F.lit(-1))["resources"].alias("r"),
            resolve_container_state(c["state"]).alias("s"),
        ),
    )
    quantity = lambda x, kind, name: parse_quantity(F.try_element_at(x["r"][kind], F.lit(name)))
    containers = F.transform(
        paired,
        lambda x: F.struct(
            x["c"]["name"].alias("name"), x["c"]["image"].alias("image"), x["c"]["ready"].alias("ready"),
            x["c"]["restartCount"].alias("restart_count"),
            x["s"]["state"].alias("state"), x["s"]["detail"].alias("state_detail"),
            quantity(x, "limits", "cpu").alias("cpu_limit"), quantity(x, "requests", "cpu").alias("cpu_request"),
            quantity(x, "limits", "memory").alias("memory_limit"),
            quantity(x, "requests", "memory").alias("memory_request"),
        ),
    )
    cols = {
        "conditions": normalize_conditions(o["status"]["conditions"]),
        "phase": decode_enum(o["status"]["phase"], S.POD_PHASES, "default", "Unknown"),
        "reason": o["status"]["reason"],
        "containers": containers,
        "node_name": F.coalesce(o["spec"]["nodeName"], F.lit("")),
        "host_ip": F.coalesce(o["status"]["hostIP"], F.lit("")),
        "pod_ip": F.coalesce(o["status"]["podIP"], F.lit("")),
        "start_time": _epoch(o["status"]["startTime"]),
        "has_parts": o["spec"].isNotNull() & o["status"].isNotNull(),
    }
    return _shape(S.POD_OBJECT, o["metadata"]["labels"], cols, {"parts": F.col("has_parts")}, ["has_parts"])


def _pod_type(part, name):
    return T.StructType.fromDDL(S.POD_OBJECT)[part].dataType[name].dataType


_SHAPES = {"deployment": _deployment_shape, "service": _service_shape, "pod": _pod_shape}


def route_workloads(objects):
    """One row per object of a known kind, in one scan: `kind`, `good`, `broken_rules`, the columns of the input in
    `source`, and the typed columns in a struct named like the kind (null for the other kinds).

    An object is parsed once, by the reader of its kind.
    """
    rows = objects.filter(F.col("kind").isin(*_SHAPES)).select(F.struct(*objects.columns).alias("source"), "kind")
    done = []
    for kind, shape in _SHAPES.items():
        schema, cols, rules, helpers = shape()
        mine = F.col("kind") == kind
        typed = parsed(rows, schema, F.when(mine, F.col("source.object")), "_o").withColumns(cols)
        typed = with_broken_rules(typed, rules)
        names = [c for c in cols if c not in helpers]
        row = F.when(mine, F.struct(*names)).alias(kind)
        rows = typed.select("source", "kind", *done, row, F.when(mine, F.col("broken_rules")).alias(f"broken_{kind}"))
        done += [kind, f"broken_{kind}"]
    broken = F.coalesce(*[F.col(f"broken_{k}") for k in _SHAPES])
    return rows.select("source", "kind", *_SHAPES, broken.alias("broken_rules"), (F.size(broken) == 0).alias("good"))


def workloads_of(routed, kind):
    """(good, bad) of one kind from routed rows, in the columns of the kind's own reader."""
    cols = routed.schema[kind].dataType.names
    kept = [F.col(f"source.{c}") for c in routed.schema["source"].dataType.names if c not in cols]
    mine = routed.filter(F.col("kind") == kind).select(*kept, f"{kind}.*", "broken_rules", F.col("good").alias("_good"))
    return mine.filter("_good").drop("_good", "object", "broken_rules"), mine.filter("NOT _good").drop("_good")


def workload_rows(objects, path=None):
    """Typed rows of all kinds: {kind: (good, bad)} from one table of (kind, object).

    The objects are read and parsed once and written below `path` (a run's own folder if not given), partitioned by kind
    and `good`, so that each of the frames reads its own rows only.
    """
    spark, routed = objects.sparkSession, route_workloads(objects)
    path = path or run_dir(spark, "workloads")
    routed.write.mode("overwrite").partitionBy("kind", "good").parquet(path)
    held = spark.read.schema(routed.schema).parquet(path)
    return {kind: workloads_of(held, kind) for kind in _SHAPES}


def unknown_kinds(objects, kinds=("deployment", "service", "pod")):
    """The rows that `workload_rows` has no reader for, null kinds included."""
    return objects.filter(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))


def config_map_data(wanted, config_maps, keys=("namespace", "name")):
    """Data of the wanted config maps; a missing object or missing data gives an empty map."""
    data = F.from_json(F.get_json_object("object", "$.data"), "map<string,string>")
    held = config_maps.select(*keys, data.alias("data"))
    empty = F.create_map().cast("map<string,string>")
    return wanted.select(*keys).join(held, list(keys), "left").withColumn("data", F.coalesce("data", empty))


def resource_spec(wanted, objects, kind, keys=("namespace", "name")):
    """Spec of the wanted objects of one kind as JSON text, null if missing."""
    held = objects.filter(F.col("kind") == kind).select(*keys, F.get_json_object("object", "$.spec").alias("spec"))
    return wanted.select(*keys).join(held, list(keys), "left")


def endpoint_from_service(services):
    """Endpoints of services that are named `*-rest`, have a cluster ip and a port named `rest`."""
    port = F.get(F.filter("ports", lambda p: p["name"] == S.REST_PORT_NAME), F.lit(0))["port"]
    rest = services.filter(F.col("name").endswith(S.REST_SUFFIX) & F.col("cluster_ip").isNotNull())
    keys = [c for c in (*CLUSTER, "seq") if c in services.columns]
    return rest.select(
        *keys, F.col("name").alias("svc_name"), F.col("namespace").alias("svc_ns"), port.alias("port"), "cluster_ip"
    ).filter(F.col("port").isNotNull())


def endpoint_urls(endpoints, kind="svc_dns"):
    """Add dns name, both urls, and the url and host of the chosen kind (svc_dns or cluster_ip)."""
    if kind not in ("svc_dns", "cluster_ip"):
        raise ValueError(f"unknown endpoint kind {kind!r}")
    dns = F.concat_ws(".", "svc_name", "svc_ns")
    port = F.col("port").cast("string")
    urls = {
        "dns": dns,
        "dns_rest": F.concat(F.lit("http://"), dns, F.lit(":"), port),
        "cluster_ip_rest": F.concat(F.lit("http://"), F.col("cluster_ip"), F.lit(":"), port),
    }
    by_dns = kind == "svc_dns"
    urls["url"] = urls["dns_rest"] if by_dns else urls["cluster_ip_rest"]
    urls["host"] = urls["dns"] if by_dns else F.col("cluster_ip")
    return endpoints.withColumns(urls)


def port_choice(ports):
    """Target port of port 8081, else 8081."""
    hit = F.get(F.filter(ports, lambda p: p["port"] == S.REST_PORT), F.lit(0))
    return F.coalesce(hit["target_port"], F.lit(S.REST_PORT))


def endpoint_table(services, kind="svc_dns"):
    """One endpoint with urls per cluster; the newest service of a cluster wins."""
    ends = endpoint_from_service(services)
    if "seq" in ends.columns:
        ends = latest_per_key(ends, CLUSTER, ["seq"])
    return endpoint_urls(ends, kind)
