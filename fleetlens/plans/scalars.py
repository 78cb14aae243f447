"""Keys, enums, numbers, quantities, paths, metrics and log levels."""

from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.functions import keys as K
from fleetlens.functions import paths as P
from fleetlens.functions import quantity as Q
from fleetlens.operators import metrics as M
from fleetlens.plans.registry import case
from fleetlens.plans.roles import JOBS, STATE_ORDER, cents, jobs, text
from fleetlens.schemas import JOB_STATES, QUANTITY_UNITS


@case("p1_project_metrics", """SELECT event_id, CAST(round(value * 100) AS BIGINT) AS numRunningJobs,
  CASE WHEN user_id % 3 = 0 THEN value END AS jvmCpuLoad, CAST(NULL AS BIGINT) AS taskSlotsTotal FROM events""")
def _(t):
    raw = F.map_concat(
        F.create_map(F.lit("numRunningJobs"), cents("value").cast("string")),
        F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("Status.JVM.CPU.Load"), F.col("value").cast("string")))
        .otherwise(F.create_map(F.lit("taskSlotsTotal"), F.lit("n/a"))),
    )
    rows = t.events.select("event_id", raw.alias("metrics"))
    wide = M.project_metrics(rows, M.COORDINATOR_METRICS)
    return wide.select("event_id", "numRunningJobs", "jvmCpuLoad", "taskSlotsTotal")


@case("p1_project_metrics_long", """SELECT user_id,
  CAST(arg_max(CAST(round(value * 100) AS BIGINT), event_id) FILTER (event_type = 'view') AS BIGINT) AS view,
  CAST(arg_max(CAST(round(value * 100) AS BIGINT), event_id) FILTER (event_type = 'click') AS BIGINT) AS click
  FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def _(t):
    rows = t.events.select("user_id", "event_id", F.col("event_type").alias("id"), cents("value").cast("string").alias("value"))
    return M.project_metrics_long(rows, ["user_id"], M.spec_of(["view", "click"]), ["event_id"])


@case("p2_infer_metric_schema", """WITH m AS (SELECT concat('Status.JVM.', p_type, '_', p_brand) AS raw_key,
    p_size % 10 = 0 AS dot FROM part)
  SELECT raw_key, concat('jvm', replace(replace(replace(raw_key, 'Status.JVM.', ''), '_', ''), '.', '')) AS field_name,
    CASE WHEN bool_or(dot) THEN 'double' ELSE 'bigint' END AS field_type FROM m GROUP BY raw_key""")
def _(t):
    key = F.concat(F.lit("Status.JVM."), "p_type", F.lit("_"), "p_brand")
    value = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 10 == 0, F.lit(".5")).otherwise(F.lit("")))
    return M.infer_metric_schema(t.part.select(key.alias("id"), value.alias("value")))


@case("p1_type_metrics", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) + 0.5 END AS even,
  CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS BIGINT) END AS odd FROM part""")
def _(t):
    size = F.col("p_size")
    metric = F.when(size % 2 == 0, F.create_map(F.lit("even"), text("", size + 0.5))).otherwise(
        F.create_map(F.lit("odd"), text("", size)))
    spec = [("even", "even", "double"), ("odd", "odd", "bigint")]
    return M.type_metrics(t.part.select("p_partkey", metric.alias("metrics")), spec)


@case("p1_type_metrics_long", """SELECT o_orderkey, concat('Status.JVM.m', o_custkey) AS raw_key, concat('jvmm', o_custkey) AS field_name,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS BIGINT) END AS long_value,
  CASE WHEN o_orderkey % 2 = 1 THEN o_custkey + 0.5::DOUBLE END AS double_value FROM orders WHERE o_orderkey % 3 > 0
  UNION ALL SELECT o_orderkey, 'uptime', 'uptime', NULL, NULL FROM orders WHERE o_orderkey % 3 > 0""")
def _(t):
    # one metric key per customer: far too many for columns
    c = F.col("o_custkey")
    value = F.when(F.col("o_orderkey") % 2 == 0, text("", c)).otherwise(text("", c + 0.5))
    whole = F.create_map(text("Status.JVM.m", c), value, F.lit("uptime"), F.lit("n/a"))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, whole).alias("metrics"))
    return M.type_metrics(rows).select("o_orderkey", "raw_key", "field_name", "long_value", "double_value")


def _catalogue_case(name, spec):
    """Every metric of a catalogue as a typed column; every fourth one of a row is missing."""
    cols = [f"""CASE WHEN (event_id + {i}) % 4 > 0 THEN {'value' if kind == 'double' else
            f'CAST((event_id * {i + 1}) % 1009 AS BIGINT)'} END AS "{field}" """ for i, (_, field, kind) in enumerate(spec)]

    @case(name, f"SELECT event_id, {', '.join(cols)} FROM events")
    def _(t):
        number = lambda i: F.col("event_id") * (i + 1) % 1009
        held = [
            F.struct(F.lit(raw).alias("k"), F.when((F.col("event_id") + i) % 4 > 0, text(
                "", F.col("value") if kind == "double" else number(i))).alias("v"))
            for i, (raw, _, kind) in enumerate(spec)
        ]
        metrics = F.map_from_entries(F.filter(F.array(*held), lambda x: x["v"].isNotNull()))
        return M.project_metrics(t.events.select("event_id", metrics.alias("metrics")), spec)


_catalogue_case("p1_job_catalogue", M.JOB_METRICS)
_catalogue_case("p1_coordinator_catalogue", M.COORDINATOR_METRICS)
_catalogue_case("p1_worker_catalogue", M.WORKER_METRICS)


@case("p3_key_rows", f"""WITH {JOBS} SELECT job_id,
  concat('clusterId=', cluster_id, ', namespace=', namespace) AS shown,
  cluster_id = 'c3' AND namespace = '5-LOW' AS under_c3, (cluster_id, namespace) < ('c3', '3-MEDIUM') AS before_c3
  FROM jobs""")
def _(t):
    pair = K.key(K.CLUSTER)
    lit = lambda c, n: F.struct(F.lit(c).alias("cluster_id"), F.lit(n).alias("namespace"))
    return jobs(t).select(
        "job_id",
        K.show_key([("clusterId", "cluster_id"), ("namespace", "namespace")]).alias("shown"),
        (pair == lit("c3", "5-LOW")).alias("under_c3"),
        (pair < lit("c3", "3-MEDIUM")).alias("before_c3"),
    )


@case("p4_encode_key", f"""WITH {JOBS} SELECT job_id, concat('jobOv@', cluster_id, '@', namespace) AS key,
  cluster_id AS cluster_id_part, namespace AS namespace_part FROM jobs""")
def _(t):
    rows = K.key_rows(jobs(t), "jobOv")
    return rows.select("job_id", "key", "cluster_id_part", "namespace_part")


@case("p5_decode_enum", """SELECT conv_id, turn, CASE WHEN role IN ('user', 'system') THEN role ELSE 'Unknown' END AS role
  FROM conversations""")
def _(t):
    role = C.decode_enum(F.col("role"), ["user", "system"], "default", "Unknown")
    return t.conversations.select("conv_id", "turn", role.alias("role"))


@case("p5_decode_enums", f"""WITH {JOBS} SELECT job_id, CASE WHEN state <> 'RESTARTING' THEN state END AS state,
  CASE state WHEN 'RUNNING' THEN 0 WHEN 'FINISHED' THEN 1 END AS state_ordinal FROM jobs""")
def _(t):
    rows = C.decode_enums(jobs(t), {"state": ["RUNNING", "FINISHED"]})
    return rows.select("job_id", "state", F.col("state_ordinal").cast("int").alias("state_ordinal"))


@case("p6_enum_ordinal", f"WITH {JOBS} SELECT job_id, CAST({STATE_ORDER} AS BIGINT) AS ordinal FROM jobs")
def _(t):
    return jobs(t).select("job_id", C.enum_ordinal(F.col("state"), JOB_STATES).alias("ordinal"))


NOW = 1_000_000_000_000


@case("p9_job_durations", f"""WITH {JOBS} SELECT job_id, {NOW} - start_ts AS duration,
  CASE WHEN state = 'FINISHED' THEN 3600000 ELSE {NOW} - start_ts END AS stopped FROM jobs""")
def _(t):
    end = F.when(F.col("state") == "FINISHED", F.col("start_ts") + 3_600_000).otherwise(F.lit(-1))
    rows = jobs(t).withColumn("end_ts", end)
    stopped = C.duration(F.col("start_ts"), F.col("end_ts"), F.lit(NOW), stop_at_end=True)
    return C.job_durations(rows, NOW).select("job_id", "duration", stopped.alias("stopped"))


@case("p25_clean_columns", """SELECT p_partkey, trim(concat(' ', p_name, '  ')) AS name,
  CASE WHEN p_size % 2 = 0 THEN concat(p_brand, ',', p_type) ELSE p_brand END AS tags FROM part""")
def _(t):
    last = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" "))).otherwise(F.lit("   "))
    rows = t.part.select(
        "p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("name"),
        F.array(F.lit(None), F.concat(F.lit(" "), "p_brand"), last).alias("tags"),
    )
    clean = C.clean_columns(rows, trim=["name"], blank_free=["tags"])
    return clean.select("p_partkey", "name", F.array_join("tags", ",").alias("tags"))


@case("p26_clamp_min", """SELECT c_custkey, greatest(c_acctbal, 100.0::DOUBLE) AS clamped, CASE WHEN c_acctbal > 500 THEN c_acctbal
  ELSE -1 END AS kept, greatest(c_nationkey, 10) AS nation FROM customer""")
def _(t):
    kept = C.or_default(F.col("c_acctbal"), lambda c: c > 500, -1.0).alias("kept")
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("clamped"), kept, F.col("c_nationkey").alias("nation"))
    return C.clean_columns(rows, at_least={"clamped": 100.0, "nation": 10})


@case("p40_min_severity", """SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')""")
def _(t):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING")
    rows = t.events.withColumn("level", level.otherwise("INFO"))
    return C.min_severity(rows, "WARNING").select("event_id", "event_type")


def _quantities(t):
    units = F.array(*[F.lit(u) for u in [*QUANTITY_UNITS, ""]])
    unit = F.get(units, (F.col("l_orderkey") % 16).cast("int"))
    raw = F.concat(F.col("l_quantity").cast("int").cast("string"), unit)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", raw.alias("raw"))


UNITS = "['n', 'u', 'm', 'k', 'M', 'G', 'T', 'P', 'E', 'Ki', 'Mi', 'Gi', 'Ti', 'Pi', 'Ei']"
QUANTITIES = f"""q AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(floor(l_quantity) AS DOUBLE) AS value,
  CASE WHEN l_orderkey % 16 = 15 THEN 3 ELSE l_orderkey % 16 END AS i FROM lineitem),
  targets AS (SELECT *, CASE l_suppkey % 3 WHEN 2 THEN i
    WHEN 1 THEN CASE WHEN i < 3 THEN 9 WHEN i < 9 THEN i + 6 ELSE i - 6 END
    ELSE CASE WHEN i IN (8, 14) THEN i - 1 ELSE i + 1 END END AS j FROM q)"""


def _targets(t):
    """Target units: the same unit, its counterpart of the other family, or a neighbour."""
    i = F.when(F.col("l_orderkey") % 16 == 15, 3).otherwise(F.col("l_orderkey") % 16)
    other = F.when(i < 3, 9).when(i < 9, i + 6).otherwise(i - 6)
    near = F.when(i.isin(8, 14), i - 1).otherwise(i + 1)
    j = F.when(F.col("l_suppkey") % 3 == 2, i).when(F.col("l_suppkey") % 3 == 1, other).otherwise(near)
    units = F.array(*[F.lit(u) for u in QUANTITY_UNITS])
    rows = _quantities(t).withColumn("q", Q.parse_quantity(F.col("raw")))
    return rows.withColumn("target", F.get(units, j.cast("int")))


@case("p15_parse_quantity", f"WITH {QUANTITIES} SELECT l_orderkey, l_linenumber, value, {UNITS}[i + 1] AS unit FROM q")
def _(t):
    q = Q.parse_quantity(F.col("raw"))
    return _quantities(t).select("l_orderkey", "l_linenumber", q["value"].alias("value"), q["unit"].alias("unit"))


@case("p16_convert_quantity", f"""WITH {QUANTITIES} SELECT l_orderkey, l_linenumber, {UNITS}[j + 1] AS target,
  round(CASE WHEN i = j THEN value
    WHEN i < 9 AND j < 9 THEN value * power(1000.0::DOUBLE, i - j)
    WHEN i >= 9 AND j >= 9 THEN value * power(1024.0::DOUBLE, i - j)
    WHEN i < 9 THEN value * 1.024::DOUBLE * power(1000.0::DOUBLE, (j - 9) - (i - 3))
    ELSE value / 1.024::DOUBLE * power(1000.0::DOUBLE, (i - 9) - (j - 3)) END, 6) AS converted FROM targets""")
def _(t):
    converted = F.round(Q.convert_quantity(F.col("q"), F.col("target")), 6)
    return _targets(t).select("l_orderkey", "l_linenumber", "target", converted.alias("converted"))


@case("p16_convert_quantity_exact", f"""WITH {QUANTITIES}, s AS (SELECT *,
    CASE WHEN i < 3 THEN power(1000.0::DOUBLE, i - 3) WHEN i < 9 THEN power(1000.0::DOUBLE, i - 2)
         ELSE power(1024.0::DOUBLE, i - 8) END AS si,
    CASE WHEN j < 3 THEN power(1000.0::DOUBLE, j - 3) WHEN j < 9 THEN power(1000.0::DOUBLE, j - 2)
         ELSE power(1024.0::DOUBLE, j - 8) END AS sj FROM targets)
  SELECT l_orderkey, l_linenumber, {UNITS}[j + 1] AS target, round(value * si / sj, 6) AS converted FROM s""")
def _(t):
    converted = F.round(Q.convert_quantity(F.col("q"), F.col("target"), mode="exact"), 6)
    return _targets(t).select("l_orderkey", "l_linenumber", "target", converted.alias("converted"))


@case("p17_show_quantity", f"""WITH {QUANTITIES} SELECT l_orderkey, l_linenumber,
  concat(CAST(value AS VARCHAR), {UNITS}[i + 1]) AS shown FROM q""")
def _(t):
    return _quantities(t).select("l_orderkey", "l_linenumber", Q.show_quantity(Q.parse_quantity(F.col("raw"))).alias("shown"))


@case("p15_normalize_quantities", """SELECT l_orderkey, l_linenumber, floor(l_quantity) * 1000 AS cpu,
  l_linenumber * 1048576.0::DOUBLE AS memory FROM lineitem""")
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("m")).alias("cpu"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("Gi")).alias("memory"),
    )
    return Q.normalize_quantities(Q.normalize_quantities(rows, ["cpu"], "u"), ["memory"], "Ki")


def _paths(t):
    """Paths of parts: all schemes, with and without the bucket, and without scheme."""
    scheme = F.get(F.array(*[F.lit(s) for s in ("s3://", "s3a://", "s3n://", "s3p://", "hdfs://", "/", "")]),
                   (F.col("p_partkey") % 7).cast("int"))
    bucket = F.when(F.col("p_size") % 2 == 0, "b1/").otherwise("")
    name = F.regexp_replace("p_name", " ", "/")
    return t.part.select("p_partkey", F.concat(scheme, bucket, name, F.lit(".jar")).alias("path"))


PATHS = """parts AS (SELECT p_partkey, p_partkey % 7 AS s, p_size % 2 = 0 AS in_bucket,
    concat(replace(p_name, ' ', '/'), '.jar') AS rest FROM part),
  paths AS (SELECT *, ['s3://', 's3a://', 's3n://', 's3p://', 'hdfs://', '/', ''][s + 1] AS scheme,
    concat(CASE WHEN in_bucket THEN 'b1/' ELSE '' END, rest) AS tail FROM parts)"""


@case("p18_pure_path", f"WITH {PATHS} SELECT p_partkey, tail AS pure FROM paths")
def _(t):
    return _paths(t).select("p_partkey", P.pure_path(F.col("path")).alias("pure"))


@case("p18_pure_path_urls", """SELECT page_id, substr(url, strpos(url, '://') + 3) AS pure FROM pages""")
def _(t):
    return t.pages.select("page_id", P.pure_path(F.col("url")).alias("pure"))


@case("p19_strip_leading_slash", f"""WITH {PATHS} SELECT p_partkey,
  CASE WHEN s = 5 THEN tail ELSE concat(scheme, tail) END AS stripped FROM paths""")
def _(t):
    return _paths(t).select("p_partkey", P.strip_leading_slash(F.col("path")).alias("stripped"))


@case("p20_file_name", "SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS file FROM pages")
def _(t):
    return t.pages.select("page_id", P.file_name(F.col("url")).alias("file"))


@case("p21_is_object_store_path", f"WITH {PATHS} SELECT p_partkey, s < 4 AS hit FROM paths")
def _(t):
    return _paths(t).select("p_partkey", P.is_object_store_path(F.col("path")).alias("hit"))


@case("p22_rewrite_scheme", f"""WITH {PATHS} SELECT p_partkey,
  concat(CASE WHEN s < 4 THEN 's3p://' ELSE scheme END, tail) AS rewritten FROM paths""")
def _(t):
    return _paths(t).select("p_partkey", P.rewrite_scheme(F.col("path")).alias("rewritten"))


@case("p23_revise_bucket", f"""WITH {PATHS} SELECT p_partkey,
  CASE WHEN s < 5 THEN concat(scheme, 'b1/', rest) ELSE concat(scheme, tail) END AS path_style,
  CASE WHEN s < 5 THEN concat(scheme, rest) ELSE concat(scheme, tail) END AS host_style FROM paths""")
def _(t):
    c = F.col("path")
    return _paths(t).select(
        "p_partkey", P.revise_bucket(c, "b1").alias("path_style"),
        P.revise_bucket(c, "b1", P.VIRTUAL_HOSTED_STYLE).alias("host_style"),
    )


@case("p24_object_name", f"WITH {PATHS} SELECT p_partkey, rest AS path_style, tail AS host_style FROM paths")
def _(t):
    c = F.col("path")
    return _paths(t).select(
        "p_partkey", P.object_name(c, "b1").alias("path_style"),
        P.object_name(c, "b1", P.VIRTUAL_HOSTED_STYLE).alias("host_style"),
    )


@case("p18_normalize_paths", f"""WITH {PATHS} SELECT p_partkey, tail AS pure_path, rest AS object_name,
  regexp_extract(rest, '[^/]*$') AS file_name, s < 4 AS is_object_store FROM paths""")
def _(t):
    return P.normalize_paths(_paths(t), "path", "b1").select(
        "p_partkey", "pure_path", "object_name", "file_name", "is_object_store"
    )
