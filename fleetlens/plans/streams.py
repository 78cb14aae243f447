"""Current and history tables, and the streaming forms. The streams read the sample tables as files."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.metrics import registry_at
from fleetlens.plans import states
from fleetlens.plans.payload_cases import CHECKED, _job_payloads, _metric_payloads, checked_payloads
from fleetlens.plans.registry import case
from fleetlens.plans.roles import CHANGELOG, changelog, epoch_ms, set_ops, text
from fleetlens.session import run_dir
from fleetlens.sources import logs, tables
from fleetlens.sources.payloads import payload_job_overview, read_payloads
from fleetlens.streaming import bounded, metric_registry, runs


def _dirs(t, name):
    base = run_dir(t.spark, name)
    return f"{base}/table", f"{base}/checkpoint"


def _overviews(t, ts):
    return payload_job_overview(_job_payloads(t)).withColumn("ts", F.lit(ts).cast("bigint"))


BATCH_1, BATCH_2 = 1_700_000_000_000, 1_700_100_000_000


def _two_batches(t):
    """All jobs at the first poll; at the second only the running ones, as finished."""
    second = _overviews(t, BATCH_2).filter("state = 'O'").withColumn("state", F.lit("F"))
    return _overviews(t, BATCH_1), second


OVERVIEWS = f"""first AS (SELECT concat('c', o_orderkey // 8) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS job_id,
    o_orderstatus AS state, CAST(o_custkey % 6 AS INTEGER) AS task_running, CAST({BATCH_1} AS BIGINT) AS ts FROM orders),
  second AS (SELECT cluster_id, job_id, 'F' AS state, task_running, CAST({BATCH_2} AS BIGINT) AS ts FROM first
    WHERE state = 'O')"""
OV_COLS = ["cluster_id", "job_id", "state", "task_running", "ts"]


@case("s17_write_history", f"WITH {OVERVIEWS} SELECT * FROM first UNION ALL SELECT * FROM second")
def _(t):
    table = tables.history_table(t.spark, _dirs(t, "history")[0])
    first, second = _two_batches(t)
    tables.write_history(first, table, 0)
    tables.write_history(second, table, 1)
    tables.write_history(second, table, 1)  # a repeated batch changes nothing
    return table.read().select(OV_COLS)


def _current(t):
    table = tables.current_table(t.spark, _dirs(t, "current")[0])
    first, second = _two_batches(t)
    tables.write_current(first, table, 0)
    tables.write_current(second, table, 1)
    return table


@case("s18_write_current", f"""WITH {OVERVIEWS} SELECT * FROM second
  UNION ALL SELECT * FROM first WHERE state <> 'O'""")
def _(t):
    table = _current(t)
    tables.compact_current(table, 1)
    return tables.read_current(table).select(OV_COLS)


@case("s19_history_of", f"""WITH {OVERVIEWS}, al AS (SELECT * FROM first UNION ALL SELECT * FROM second)
  SELECT * FROM al WHERE cluster_id = 'c2' AND job_id = '16' ORDER BY ts DESC""")
def _(t):
    first, second = _two_batches(t)
    rows = tables.flatten_tasks(first.unionByName(second))
    return tables.history_of(rows, "c2", "ns", "16").select(OV_COLS)


POLLS = 6


@case("s19_history_newest_first", f"""WITH {OVERVIEWS}, polls AS (SELECT * REPLACE ({BATCH_1} + 40000000 * p AS ts),
    p FROM first, range({POLLS}) r(p) WHERE (CAST(job_id AS BIGINT) + p) % 3 > 0)
  SELECT cluster_id, job_id, state, task_running, ts, row_number() OVER (ORDER BY ts DESC) AS place FROM polls
  WHERE cluster_id = 'c2' AND job_id = '16'""")
def _(t):
    # six polls over three days, two of three jobs in each; the first four are merged
    table = tables.history_table(t.spark, _dirs(t, "history")[0])
    jobs = _overviews(t, BATCH_1)
    for p in range(POLLS):
        seen = jobs.filter((F.col("job_id").cast("bigint") + p) % 3 > 0)
        tables.write_history(seen.withColumn("ts", F.lit(BATCH_1 + 40_000_000 * p)), table, p)
    tables.fold_history(table, 3)
    rows = tables.history_of(table.read(), "c2", "ns", "16")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"))).cast("bigint")).select(*OV_COLS, "place")


@case("s20_delete_keys", f"""WITH {OVERVIEWS} SELECT * FROM first WHERE cluster_id <> 'c3'
  AND job_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""")
def _(t):
    rows = tables.flatten_tasks(_overviews(t, BATCH_1))
    gone = t.customer.select(F.col("c_custkey").cast("string").alias("job_id"))
    return tables.delete_cluster(tables.delete_keys(rows, gone, ["job_id"]), "c3", "ns").select(OV_COLS)


@case("s20_delete_in_table", f"""WITH {OVERVIEWS}, cur AS (SELECT * FROM second UNION ALL SELECT * FROM first WHERE state <> 'O')
  SELECT * FROM cur WHERE task_running <= 2""")
def _(t):
    table = _current(t)
    gone = _overviews(t, BATCH_2 + 1).filter("tasks.running > 2")
    tables.write_deletes(gone.select("cluster_id", "namespace", "job_id", "ts"), table, 2)
    return tables.read_current(table).select(OV_COLS)


@case("a1_stream_latest", f"WITH {states.LAST} SELECT user_id, event_id, event_type, value FROM last")
def _(t):
    rows = t.stream("events").select("user_id", "event_id", "event_type", "value")
    return runs.stream_latest(rows, *_dirs(t, "latest"), ["user_id"], ["event_id"])[1]()


@case("a2_stream_members", f"WITH {states.MEMBERS} SELECT scope, k FROM members")
def _(t):
    return runs.stream_members(
        set_ops(t.stream("events")), *_dirs(t, "members"), ["scope", "k"], ["seq"], scope=["scope"])[1]()


@case("t1_stream_changelog", f"WITH {CHANGELOG} SELECT scope, k, seq, op, event_type, value FROM live")
def _(t):
    return runs.stream_changelog(changelog(t.stream("events")), *_dirs(t, "changelog"), ["scope"], ["k"])[1]()


@case("t2_stream_snapshots", f"WITH {states.SNAPSHOTS} SELECT scope, batch_seq, event_id, user_id, event_type FROM newest")
def _(t):
    return runs.stream_snapshots(states.snapshots(t.stream("events")), *_dirs(t, "snapshots"), ["scope"])[1]()


@case("t3_stream_reconciled", f"WITH {states.RECONCILED} SELECT scope, k, seq FROM kept")
def _(t):
    stream = t.stream("events")
    seen = states.snapshots(stream).select(
        "scope", F.col("user_id").alias("k"), F.col("batch_seq").alias("seq"), "event_type")
    listings = seen.filter("event_type <> 'error'").drop("event_type")
    records = seen.filter("event_type = 'purchase'").drop("event_type")
    return runs.stream_reconciled(listings, records, *_dirs(t, "reconciled"), ["scope"], ["k"])[1]()


@case("t5_stream_watch", f"WITH {states.WATCHED} SELECT user_id, start_ts, completed_ts, status FROM watched")
def _(t):
    kind = F.col("event_type")
    return runs.stream_watch(
        states.timed(t.stream("events")), *_dirs(t, "watch"), ["user_id"], "tms", kind == "signup", kind == "purchase",
        states.DAY_MS)[1]()


@case("t6_stream_gated", f"WITH {states.GATED} SELECT user_id, seq, value FROM gated")
def _(t):
    rows = t.stream("events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("seq"), "value")
    return runs.stream_gated(rows, lambda: states.tracking(t.events), *_dirs(t, "gated"), ["user_id"], "seq")[1]()


@case("t7_maintain_index", """WITH s AS (SELECT concat('c', user_id % 10) AS cluster_id, 'ns' AS namespace, event_id AS job_id,
    concat('u', user_id) AS job_name, event_type AS state, epoch_us(ts) // 1000 AS start_ts, event_id // 500 AS batch_seq FROM events)
  SELECT * FROM s QUALIFY batch_seq = max(batch_seq) OVER (PARTITION BY cluster_id, namespace)""")
def _(t):
    rows = t.stream("events").select(
        text("c", F.col("user_id") % 10).alias("cluster_id"), F.lit("ns").alias("namespace"),
        F.col("event_id").alias("job_id"), text("u", F.col("user_id")).alias("job_name"),
        F.col("event_type").alias("state"), epoch_ms("ts").alias("start_ts"),
        F.floor(F.col("event_id") / 500).alias("batch_seq"), "value", "props",
    )
    return runs.maintain_index(rows, *_dirs(t, "index"))[1]()


@case("t8_maintain_endpoints", f"""WITH {CHANGELOG}, e AS (SELECT * FROM live WHERE k % 2 = 0 AND k % 3 <> 0)
  SELECT concat('c', scope) AS cluster_id, max(seq) AS seq, concat('svc-', arg_max(k, seq), '-rest.ns') AS dns,
    concat('http://10.0.0.', arg_max(k, seq), ':', 8000 + arg_max(k, seq)) AS cluster_ip_rest FROM e GROUP BY scope""")
def _(t):
    key = F.col("k")
    ports = F.array(F.struct(F.lit("rest").alias("name"), (key + 8000).cast("int").alias("port")))
    services = changelog(t.stream("events")).select(
        text("c", F.col("scope")).alias("cluster_id"), F.lit("ns").alias("namespace"),
        F.concat(text("svc-", key), F.when(key % 2 == 0, "-rest").otherwise("")).alias("name"),
        F.when(key % 3 != 0, text("10.0.0.", key)).alias("cluster_ip"), ports.alias("ports"), "seq", "op",
    )
    view = runs.stream_endpoints(services, *_dirs(t, "endpoints"))[1]()
    return view.select("cluster_id", "seq", "dns", "cluster_ip_rest")


@case("t9_ingest_overviews", f"""WITH {CHECKED}, good AS (SELECT * FROM checked WHERE broken = '')
  SELECT 'current' AS side, cluster_id, job_id, state, '' AS broken FROM good
  UNION ALL SELECT 'history', cluster_id, job_id, state, '' FROM good
  UNION ALL SELECT 'rejected', cluster_id, job_id, state, broken FROM checked WHERE broken <> ''""")
def _(t):
    table, checkpoint = _dirs(t, "ingest")
    schema = "cluster_id STRING, namespace STRING, payload STRING, ts BIGINT"
    landed = checked_payloads(t).select("cluster_id", "namespace", "payload", F.col("ts").cast("bigint").alias("ts"))
    landed.repartition(4, "cluster_id").write.parquet(f"{table}/landed")
    stream = read_payloads(t.spark, f"{table}/landed", schema, "parquet", stream=True, maxFilesPerTrigger=1)
    _, current, history, rejected = runs.ingest_overviews(stream, table, checkpoint)
    cols = ["cluster_id", "job_id", "state"]
    side = lambda df, name, broken: df.select(F.lit(name).alias("side"), *cols, broken.alias("broken"))
    return side(current(), "current", F.lit("")).unionByName(side(history(), "history", F.lit(""))).unionByName(
        side(rejected(), "rejected", F.array_join("broken_rules", ",")))


@case("t9_ingest_changed_overviews", """SELECT concat('c', o_orderkey // 8) AS cluster_id, CAST(o_orderkey AS VARCHAR) AS job_id,
  CAST(1000 + p AS BIGINT) AS ts, CAST(CASE p WHEN 2 THEN 5 ELSE -1 END AS BIGINT) AS end_ts
  FROM orders, (VALUES (0), (2), (4)) r(p) WHERE p = 0 OR (o_orderkey // 8) % 2 = 0""")
def _(t):
    # six polls of each cluster; those with an even number have other jobs at polls 2 and 3, and others an unreadable poll 3.
    # Every other poll lists its jobs the other way round.
    polls = _job_payloads(t).select("cluster_id", "namespace", "batch", "items", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p"))
    even, p = F.col("batch") % 2 == 0, F.col("p")
    ended = F.transform("items", lambda x: x.withField("`end-time`", F.when(even & p.isin(2, 3), 5).otherwise(-1)))
    whole = F.to_json(F.struct(F.when(p % 2 == 0, ended).otherwise(F.reverse(ended)).alias("jobs")))
    payload = F.when(~even & (p == 3), F.left(whole, F.lit(20))).otherwise(whole).alias("payload")
    rows = polls.select("cluster_id", "namespace", payload, (p + 1000).cast("bigint").alias("ts"))
    table, checkpoint = _dirs(t, "ingest")
    rows.repartition(4, F.xxhash64("cluster_id", "ts")).write.parquet(f"{table}/landed")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{table}/landed")
    view = runs.ingest_changed_overviews(stream, table, checkpoint)[1]
    return view().select("cluster_id", "job_id", "ts", "end_ts")


@case("t9_collect_both", """WITH h AS (SELECT user_id % 50 AS cluster, concat('j', user_id) AS job_id, event_type AS state,
    epoch_us(ts) // 1000 AS ts FROM events)
  SELECT 'history' AS side, concat('c', cluster) AS cluster_id, job_id, state, ts FROM h
  UNION ALL SELECT 'current', concat('c', cluster), job_id, state, ts FROM h
  QUALIFY ts = max(ts) OVER (PARTITION BY cluster, job_id)""")
def _(t):
    rows = t.stream("events").select(
        text("c", F.col("user_id") % 50).alias("cluster_id"), F.lit("ns").alias("namespace"),
        text("j", F.col("user_id")).alias("job_id"), F.lit("n").alias("job_name"),
        F.col("event_type").alias("state"), epoch_ms("ts").alias("start_ts"), F.lit(-1).cast("bigint").alias("end_ts"),
        *[F.lit(0).alias(f"task_{s}") for s in tables.TASK_STATES], epoch_ms("ts").alias("ts"),
    )
    table, checkpoint = _dirs(t, "both")
    _, current, history = runs.stream_both(rows, f"{table}/current", f"{table}/history", checkpoint)
    cols = ["cluster_id", "job_id", "state", "ts"]
    side = lambda df, name: df.select(F.lit(name).alias("side"), *cols)
    return side(history(), "history").unionByName(side(current(), "current"))


@case("t11_follow_log", """SELECT unnest(string_split(text, chr(10))) AS text, role FROM conversations""")
def _(t):
    folder, checkpoint = _dirs(t, "log")
    lines = t.conversations.select("text", "role")
    lines.repartition(4).write.partitionBy("role").text(f"{folder}/in")
    stream = logs.follow_log(t.spark, f"{folder}/in")
    table = tables.BatchTable(t.spark, f"{folder}/out", stream.schema)
    runs.run(stream, checkpoint, lambda b, i: table.write(b, i))
    return table.read().select("text", F.regexp_extract("file", "role=([a-z]+)", 1).alias("role"))


@case("w1_stream_changes", f"WITH {states.CHANGED} SELECT user_id, event_id, event_type FROM changed")
def _(t):
    rows = t.stream("events").select("user_id", "event_id", "event_type")
    return runs.stream_changes(rows, *_dirs(t, "changes"), ["user_id"], ["event_id"], ["event_type"])[1]()


@case("t12_stream_first_errors", f"WITH {states.ERRORS} SELECT user_id, event_id, message FROM firsts")
def _(t):
    rows = states.outcomes(t.stream("events"))
    return runs.stream_first_errors(
        rows, *_dirs(t, "errors"), ["user_id"], ["event_id"], F.col("event_type") == "error", "message"
    )[1]().drop("event_type")


@case("w1_stream_set_changes", f"""WITH {states.SETS} SELECT grp, batch, n AS members FROM (
  SELECT *, lag(members) OVER (PARTITION BY grp ORDER BY batch) AS prev FROM s) WHERE prev IS DISTINCT FROM members""")
def _(t):
    rows = t.stream("events").select(
        (F.col("user_id") % 50).alias("grp"), F.floor(F.col("event_id") / 500).alias("batch"), "event_type")
    view = runs.stream_set_changes(rows, *_dirs(t, "sets"), ["grp"], ["batch"], ["event_type"])[1]()
    return view.select("grp", "batch", "members")


@case("w1_stream_changes_late", f"WITH {states.CHANGED} SELECT user_id, event_id, event_type FROM changed")
def _(t):
    rows = t.shuffled_stream("events").select("user_id", "event_id", "event_type")
    return runs.stream_changes(rows, *_dirs(t, "changes"), ["user_id"], ["event_id"], ["event_type"])[1]()


@case("t12_stream_first_errors_late", f"WITH {states.ERRORS} SELECT user_id, event_id, message FROM firsts")
def _(t):
    rows = states.outcomes(t.shuffled_stream("events"))
    return runs.stream_first_errors(
        rows, *_dirs(t, "errors"), ["user_id"], ["event_id"], F.col("event_type") == "error", "message"
    )[1]().drop("event_type")


@case("w1_stream_multiset_changes", f"WITH {states.MULTISETS}")
def _(t):
    rows = states.kinds(t.shuffled_stream("events"))
    view = runs.stream_multiset_changes(rows, *_dirs(t, "multisets"), ["grp"], ["batch"], ["event_type"])[1]()
    return view.select("grp", "batch", "members")


def _listed(stream):
    """(listings, records) of the stream of events."""
    seen = states.snapshots(stream).select("scope", F.col("user_id").alias("k"), F.col("batch_seq").alias("seq"), "event_type")
    return seen.filter("event_type <> 'error'").drop("event_type"), seen.filter("event_type = 'purchase'").drop("event_type")


@case("t3_stream_folded", f"WITH {states.RECONCILED} SELECT scope, k, seq FROM kept")
def _(t):
    # a poll may lie in two files, so it is complete two polls later
    listings, records = _listed(t.ordered_stream("events", F.col("event_id")))
    return bounded.stream_reconciled(
        listings, records, *_dirs(t, "folded"), ["scope"], ["k"], delay=2, compact_every=1)[1]()


@case("t3_stream_reconciled_late", f"WITH {states.RECONCILED} SELECT scope, k, seq FROM kept")
def _(t):
    listings, records = _listed(t.shuffled_stream("events"))
    return bounded.stream_reconciled(listings, records, *_dirs(t, "late"), ["scope"], ["k"])[1]()


@case("t6_stream_gated_bounded", f"WITH {states.GATED} SELECT user_id, seq, value FROM gated")
def _(t):
    marks = states.tracking(t.ordered_stream("events", F.col("event_id")))
    rows = t.shuffled_stream("events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("seq"), "value")
    return bounded.stream_gated(rows, marks, *_dirs(t, "tracked"), ["user_id"], delay=0, compact_every=1)[1]()


@case("t5_stream_watch_event_time", f"""WITH {states.WATCHED} SELECT user_id, start_ts, completed_ts,
  CASE WHEN completed_ts IS NOT NULL THEN 'COMPLETED' WHEN (SELECT max(tms) FROM e) - 21600000 > start_ts + {states.DAY_MS}
    THEN 'WATCH_TIMEOUT' ELSE 'IN_PROGRESS' END AS status FROM watched""")
def _(t):
    rows = states.timed(t.ordered_stream("events", epoch_ms("ts"))).withColumn("at", F.timestamp_millis("tms"))
    kind = F.col("event_type")
    view = bounded.stream_watch(
        rows, *_dirs(t, "native"), ["user_id"], "at", kind == "signup", kind == "purchase", "1 day", "6 hours")[1]()
    return view.select("user_id", F.unix_millis("start_ts").alias("start_ts"), F.unix_millis("completed_ts").alias("completed_ts"), "status")


@case("s4_stream_metric_keys", """WITH m AS (SELECT event_id // 10 AS b, event_type AS id FROM events)
  SELECT DISTINCT 'id' AS side, concat('c', b) AS cluster_id, id FROM m WHERE b % 10 <> 3
  UNION ALL SELECT DISTINCT 'rejected', concat('c', b), NULL FROM m WHERE b % 10 = 3""")
def _(t):
    rows = _metric_payloads(t).withColumn("payload", F.when(F.col("batch") % 10 == 3, F.left("payload", F.lit(9))).otherwise(
        F.col("payload"))).select("cluster_id", "payload", F.timestamp_seconds(F.col("batch") * 60 + 1_700_000_000).alias("ts"))
    table, checkpoint = _dirs(t, "metric-keys")
    rows.unionByName(rows).repartition(4, F.rand(1)).write.parquet(f"{table}/landed")  # each payload comes twice
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{table}/landed")
    _, view, rejected = bounded.stream_metric_keys(stream, table, checkpoint, ["cluster_id"], delay="3650 days")
    side = lambda df, name, col: df.select(F.lit(name).alias("side"), "cluster_id", col.alias("id"))
    return side(view(), "id", F.col("id")).unionByName(side(rejected(), "rejected", F.lit(None).cast("string")))


METRICS = """m AS (SELECT event_id, concat('n.', event_type) AS raw_key,
    ts >= TIMESTAMP '2024-01-15' AND event_type IN ('view', 'signup') AS dot, value FROM events),
  k AS (SELECT raw_key, bool_or(dot) AS double_key FROM m GROUP BY raw_key)"""


def _metric_stream(t):
    # the numbers of two metrics have a dot from the second half on
    value = F.when((F.col("ts") >= F.lit("2024-01-15").cast("timestamp")) & F.col("event_type").isin("view", "signup"),
                   F.col("value").cast("string")).otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
    key = F.concat(F.lit("n."), "event_type")
    rows = t.ordered_stream("events", F.col("event_id")).select("event_id", F.create_map(key, value).alias("metrics"))
    return metric_registry.stream_metrics(rows, *_dirs(t, "metrics"))


@case("p1_stream_typed_metrics", f"""WITH {METRICS} SELECT event_id, replace(raw_key, '.', '') AS field_name,
  CASE WHEN NOT double_key THEN CAST(round(value * 100) AS BIGINT) END AS long_value,
  CASE WHEN double_key THEN CASE WHEN dot THEN value ELSE round(value * 100) END END AS double_value FROM m JOIN k USING (raw_key)""")
def _(t):
    return _metric_stream(t)[1]().select("event_id", "field_name", "long_value", "double_value")


@case("p2_stream_registry", f"""WITH {METRICS} SELECT raw_key, replace(raw_key, '.', '') AS field_name,
  CASE WHEN double_key THEN 'double' ELSE 'bigint' END AS field_type FROM k""")
def _(t):
    return registry_at(_metric_stream(t)[2]()).drop("version")


@case("a8_stream_upserts", """SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id""")
def _(t):
    combine = [F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")]
    put = {"n": F.col("new.n"), "last_event": F.col("new.last_event")}
    updates = {"n": F.col("n") + F.col("new.n"), "last_event": F.greatest("last_event", "new.last_event")}
    schema = "user_id BIGINT, n BIGINT, last_event BIGINT"
    return runs.stream_upserts(t.stream("events"), *_dirs(t, "upserts"), schema, ["user_id"], combine, put, updates)[1]()


@case("t10_stream_usage", f"WITH {states.USAGE} SELECT scope, k, seq, cpu FROM used")
def _(t):
    views = t.stream("events").filter("event_type = 'view'").select(
        (F.col("user_id") % 10).alias("scope"), F.col("user_id").alias("k"), F.col("event_id").alias("seq"),
        F.col("value").alias("cpu"))
    return runs.stream_usage(changelog(t.stream("events")), views, *_dirs(t, "usage"), ["scope"], ["k"])[1]()
