"""Filters, sorting, paging and joins over jobs."""

from pyspark.sql import functions as F

from fleetlens.functions import keys as K
from fleetlens.operators import aggregates, changes, cursor, joins, query
from fleetlens.operators.query import JobFilter, PageRequest
from fleetlens.plans.registry import case
from fleetlens.plans.roles import JOBS, STATE_ORDER, jobs, text

COLS = "cluster_id, namespace, job_id, job_name, state, start_ts"
FLAGSHIP = JobFilter(name_contains="job-3", states=frozenset(["FINISHED"]))
ORDERS = (("startTs", "desc"), ("jobName", "asc"))


def placed(df):
    """Add `place`, the place of each row in the order in which the rows of `df` come out."""
    return query.with_place(df.withColumn("_id", F.monotonically_increasing_id()), ["_id"]).drop("_id")


@case("f1_select_jobs", f"""WITH {JOBS} SELECT {COLS} FROM jobs
  WHERE contains(job_name, 'job-3') AND state IN ('FINISHED', 'RUNNING') AND namespace IN ('1-URGENT', '5-LOW')
    AND (cluster_id, namespace) IN (('c1', '1-URGENT'), ('c2', '5-LOW'), ('c3', '5-LOW'))
    AND start_ts >= 820454400000 AND start_ts < 946684800000""")
def _(t):
    flt = JobFilter(
        clusters=frozenset([("c1", "1-URGENT"), ("c2", "5-LOW"), ("c3", "5-LOW")]),
        name_contains="job-3",
        states=frozenset(["FINISHED", "RUNNING"]),
        begin=820454400000,
        end=946684800000,
    )
    return query.select_jobs(jobs(t), flt)


@case("f1_select_jobs_without_clauses", f"WITH {JOBS} SELECT {COLS} FROM jobs")
def _(t):
    return query.select_jobs(jobs(t), JobFilter())


@case("f2_in_set", f"""WITH {JOBS} SELECT {COLS} FROM jobs
  WHERE state IN ('RUNNING', 'RESTARTING')
    AND EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND job_id = c_custkey)""")
def _(t):
    wanted = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("job_id"))
    hits = jobs(t).filter(query.in_set(["state"], {"RUNNING", "RESTARTING"}))
    return query.keep_keys(hits, wanted, ["job_id"])


@case("f3_contains", "SELECT page_id, url FROM pages WHERE contains(url, '?page=2')")
def _(t):
    return t.pages.filter(query.contains_text("url", "?page=2")).select("page_id", "url")


@case("f4_ts_range", """SELECT event_id, user_id FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'""")
def _(t):
    week = query.ts_range("ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    return t.events.filter(week).select("event_id", "user_id")


@case("f5_remove_where", """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)
  WHERE coalesce(quality, 1) <> 0""")
def _(t):
    labelled = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return query.remove_where(labelled, F.col("quality") == 0).select("doc_id", "quality")


@case("f6_under_cluster", f"WITH {JOBS} SELECT {COLS} FROM jobs WHERE cluster_id = 'c7' AND namespace = '2-HIGH'")
def _(t):
    return K.under_cluster(jobs(t), "c7", "2-HIGH")


@case("f7_quarantine", """SELECT doc_id, CASE WHEN quality IS NULL THEN 'bad' ELSE 'good' END AS side
  FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    labelled = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    good, bad = query.quarantine(labelled, {"quality": F.col("quality").isNotNull()})
    side = lambda df, name: df.select("doc_id", F.lit(name).alias("side"))
    return side(good, "good").unionByName(side(bad, "bad"))


@case("q1_select_page", f"""WITH {JOBS} SELECT {COLS} FROM jobs
  WHERE contains(job_name, 'job-3') AND state = 'FINISHED'
  ORDER BY start_ts DESC, job_name, cluster_id, namespace, job_id LIMIT 20 OFFSET 20""")
def q1(t):
    return query.select_page(jobs(t), FLAGSHIP, PageRequest(2, 20, ORDERS))[0]


@case("q1_select_page_deep", f"""WITH {JOBS}, p AS (SELECT {COLS},
    row_number() OVER (ORDER BY {STATE_ORDER} DESC, start_ts, cluster_id, namespace, job_id) - 1000 AS place FROM jobs)
  SELECT * FROM p WHERE place BETWEEN 1 AND 500""")
def _(t):
    orders = query.order_columns((("jobState", "desc"), ("startTs", "asc")))
    return placed(query.page(jobs(t), PageRequest(3, 500), orders))


@case("q2_select_all", f"""WITH {JOBS} SELECT {COLS},
    row_number() OVER (ORDER BY start_ts DESC, job_name, cluster_id, namespace, job_id) AS place
  FROM jobs WHERE state = 'RESTARTING'""")
def _(t):
    return placed(query.select_all(jobs(t), JobFilter(states=frozenset(["RESTARTING"])), ORDERS))


@case("q3s_sort_by", f"""WITH {JOBS} SELECT {COLS},
    row_number() OVER (ORDER BY {STATE_ORDER} DESC, job_name, cluster_id, namespace, job_id) AS place FROM jobs""")
def _(t):
    return placed(query.sort_by(jobs(t), (("jobState", "desc"), ("jobName", "asc"))))


@case("q4_page_envelope", f"""WITH {JOBS}, n AS (
  SELECT count(*) AS c FROM jobs WHERE contains(job_name, 'job-3') AND state = 'FINISHED')
  SELECT c AS total_ele, CAST(ceil(c / 20.0) AS BIGINT) AS total_page,
         CAST(least(20, greatest(0, c - 20)) AS BIGINT) AS size,
         CAST(2 AS BIGINT) AS pag_num, CAST(20 AS BIGINT) AS pag_size, 2 < ceil(c / 20.0) AS has_next,
         true AS has_prev FROM n""")
def _(t):
    return query.select_page(jobs(t), FLAGSHIP, PageRequest(2, 20, ORDERS))[1]


@case("q5_safe_page", f"WITH {JOBS} SELECT {COLS} FROM jobs ORDER BY cluster_id, namespace, job_id LIMIT 10")
def _(t):
    return query.page(jobs(t), PageRequest(0, -5), query.order_columns(()))


@case("q6_canonical_order", f"""WITH {JOBS}, d AS (SELECT DISTINCT cluster_id, namespace FROM jobs)
  SELECT *, row_number() OVER (ORDER BY namespace, cluster_id) AS place FROM d""")
def _(t):
    return placed(query.canonical_order(jobs(t).select("cluster_id", "namespace").distinct(), "k8s_ref"))


@case("q7_list_all", f"""WITH {JOBS} SELECT {COLS},
  row_number() OVER (ORDER BY cluster_id, namespace, job_id) AS place FROM jobs""")
def _(t):
    return placed(query.list_all(jobs(t)))


@case("q8_states_of", f"WITH {JOBS} SELECT job_id, state FROM jobs WHERE cluster_id = 'c3' AND namespace = '5-LOW'")
def _(t):
    return query.states_of(jobs(t), "c3", "5-LOW")


def _tracked(t):
    return t.supplier.filter("s_acctbal > 0").select(
        text("c", F.col("s_suppkey") % 50).alias("cluster_id"), F.lit("1-URGENT").alias("namespace")
    ).distinct()


TRACKED = """tracked AS (SELECT DISTINCT concat('c', s_suppkey % 50) AS cluster_id, '1-URGENT' AS namespace
  FROM supplier WHERE s_acctbal > 0)"""


@case("j1_tracked_state", f"WITH {JOBS}, {TRACKED} SELECT {COLS} FROM jobs JOIN tracked USING (cluster_id, namespace)")
def _(t):
    return joins.tracked_state(_tracked(t), jobs(t))


@case("j2_index_then_fetch", f"""WITH {JOBS} SELECT {COLS} FROM jobs WHERE state = 'RUNNING' AND job_name = 'job-5'""")
def _(t):
    index = jobs(t).select(*K.JOB, "job_name", "state", "start_ts")
    hit = (F.col("state") == "RUNNING") & (F.col("job_name") == "job-5")
    return joins.index_then_fetch(index, jobs(t), hit)


@case("j3_with_container_resources", """WITH spec AS (
    SELECT p_partkey % 500 AS pod, concat('ct-', p_size % 5) AS container,
           arg_max(p_brand, p_partkey) AS cpu_limit, arg_max(p_type, p_partkey) AS memory_limit
    FROM part GROUP BY ALL),
  st AS (SELECT l_orderkey % 500 AS pod, concat('ct-', l_linenumber) AS container, l_orderkey, l_linenumber,
                l_extendedprice FROM lineitem)
  SELECT pod, container, l_orderkey, l_linenumber, l_extendedprice, cpu_limit, memory_limit
  FROM st LEFT JOIN spec USING (pod, container)""")
def _(t):
    spec = t.part.select(
        (F.col("p_partkey") % 500).alias("pod"), text("ct-", F.col("p_size") % 5).alias("container"),
        F.col("p_partkey").alias("position"), F.col("p_brand").alias("cpu_limit"),
        F.col("p_type").alias("memory_limit"),
    )
    status = t.lineitem.select(
        (F.col("l_orderkey") % 500).alias("pod"), text("ct-", F.col("l_linenumber")).alias("container"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )
    return joins.with_container_resources(status, spec, cols=("cpu_limit", "memory_limit"))


def _requests(t):
    return t.customer.select(
        F.col("c_custkey").alias("request"), (F.col("c_custkey") % 120).alias("cluster"),
        F.concat(F.lit("/jobs/"), F.col("c_nationkey").cast("string")).alias("path"),
    )


def _endpoints(t):
    return t.supplier.filter("s_acctbal < 6000").select(
        F.col("s_suppkey").alias("cluster"), F.concat("s_name", F.lit("-rest.ns")).alias("host"),
        (8000 + F.col("s_suppkey") % 100).alias("port"),
    )


REQUESTS = """requests AS (SELECT c_custkey AS request, c_custkey % 120 AS cluster, concat('/jobs/', c_nationkey) AS path
  FROM customer),
  ends AS (SELECT s_suppkey AS cluster, concat(s_name, '-rest.ns') AS host, 8000 + s_suppkey % 100 AS port
  FROM supplier WHERE s_acctbal < 6000)"""


@case("j4_route_lookup", f"""WITH {REQUESTS}, opened AS (SELECT s_suppkey AS cluster FROM supplier WHERE s_acctbal > 2000)
  SELECT r.cluster, request, path, e.host AS forward_host, e.port AS forward_port,
         CASE WHEN e.host IS NULL THEN 'NOT_FOUND' ELSE 'FORWARD' END AS route
  FROM requests r LEFT JOIN (SELECT * FROM ends WHERE cluster IN (SELECT cluster FROM opened)) e USING (cluster)""")
def _(t):
    opened = t.supplier.filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("cluster"))
    return joins.route_lookup(_requests(t), opened, _endpoints(t), ["cluster"])


@case("j5_require_tracked", f"""WITH {REQUESTS} SELECT request, cluster,
  CASE WHEN cluster IN (SELECT s_suppkey FROM supplier) THEN 'accepted' ELSE 'CLUSTER_NOT_TRACKED' END AS outcome
  FROM requests""")
def _(t):
    tracked = t.supplier.select(F.col("s_suppkey").alias("cluster"))
    ok, bad = joins.require_tracked(_requests(t), tracked, ["cluster"])
    rows = lambda df, outcome: df.select("request", "cluster", F.lit(outcome).alias("outcome"))
    return rows(ok, "accepted").unionByName(rows(bad, "CLUSTER_NOT_TRACKED"))


@case("j6_lookup_with_fallback", f"""WITH {REQUESTS}, src AS (
    SELECT s_suppkey AS cluster, s_name AS host, 8081 AS port FROM supplier WHERE s_acctbal > 1000)
  SELECT request, r.cluster, path, coalesce(e.host, s.host) AS host,
         CAST(coalesce(e.port, s.port) AS BIGINT) AS port,
         CASE WHEN e.host IS NOT NULL THEN 'cache' WHEN s.host IS NOT NULL THEN 'source' END AS found_in
  FROM requests r LEFT JOIN ends e ON r.cluster = e.cluster LEFT JOIN src s ON r.cluster = s.cluster""")
def _(t):
    source = t.supplier.filter("s_acctbal > 1000").select(
        F.col("s_suppkey").alias("cluster"), F.col("s_name").alias("host"), F.lit(8081).cast("bigint").alias("port")
    )
    return joins.lookup_with_fallback(_requests(t), _endpoints(t), source, ["cluster"], ["host", "port"])


OBJECTS = """o AS (
    SELECT concat('c', o_custkey % 200) AS cluster_id, concat('d-', o_orderkey) AS name, 'deployment' AS kind FROM orders
      WHERE o_orderstatus = 'F'
    UNION ALL SELECT concat('c', s_suppkey), s_name, 'service' FROM supplier
    UNION ALL SELECT concat('c', o_custkey % 200), concat('p-', o_orderkey), 'pod' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT concat('c', p_partkey % 150), concat(p_name, '-', p_partkey), 'config_map' FROM part)"""


def cluster_objects(t):
    """Rows of each kind with cluster_id, name and some details."""
    orders = t.orders.withColumn("cluster_id", text("c", F.col("o_custkey") % 200))
    pick = lambda letter, status: orders.filter(F.col("o_orderstatus") == status).select(
        "cluster_id", text(letter, F.col("o_orderkey")).alias("name"), "o_orderpriority", "o_custkey")
    return {
        "deployment": pick("d-", "F"),
        "service": t.supplier.select(text("c", F.col("s_suppkey")).alias("cluster_id"), F.col("s_name").alias("name"),
                                     F.col("s_nationkey")),
        "pod": pick("p-", "O"),
        "config_map": t.part.select(
            text("c", F.col("p_partkey") % 150).alias("cluster_id"),
            F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), "p_size"),
    }


def named_objects(t):
    rows = [df.select("cluster_id", "name", F.lit(kind).alias("kind")) for kind, df in cluster_objects(t).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@case("j8_assemble_snapshot", f"WITH {OBJECTS} SELECT cluster_id, kind, name FROM o")
def _(t):
    return joins.assemble_snapshot(named_objects(t), ["cluster_id"])


@case("j8_snapshot_counts", f"""WITH {OBJECTS} SELECT cluster_id, count(*) FILTER (kind = 'deployment') AS deployment,
    count(*) FILTER (kind = 'service') AS service, count(*) FILTER (kind = 'pod') AS pod,
    count(*) FILTER (kind = 'config_map') AS config_map FROM o GROUP BY 1""")
def _(t):
    return joins.snapshot_counts(named_objects(t), ["cluster_id"])


@case("j8_full_snapshot", """SELECT concat('c', o_custkey % 200) AS cluster_id,
    CASE o_orderstatus WHEN 'F' THEN 'deployment' ELSE 'pod' END AS kind,
    concat(CASE o_orderstatus WHEN 'F' THEN 'd-' ELSE 'p-' END, o_orderkey) AS name,
    CAST(to_json({'o_orderpriority': o_orderpriority, 'o_custkey': o_custkey}) AS VARCHAR) AS detail
    FROM orders WHERE o_orderstatus IN ('F', 'O')
  UNION ALL SELECT concat('c', s_suppkey), 'service', s_name,
    CAST(to_json({'s_nationkey': s_nationkey}) AS VARCHAR) FROM supplier
  UNION ALL SELECT concat('c', p_partkey % 150), 'config_map', concat(p_name, '-', p_partkey),
    CAST(to_json({'p_size': p_size}) AS VARCHAR) FROM part""")
def _(t):
    return joins.full_snapshot(cluster_objects(t), ["cluster_id"])


@case("j9_fetch_many", f"""WITH {JOBS} SELECT {COLS} FROM jobs
  WHERE job_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def _(t):
    wanted = t.lineitem.filter("l_quantity = 50").select(F.col("l_orderkey").alias("job_id")).distinct()
    return joins.fetch_many(jobs(t), wanted, ["job_id"], K.JOB)


@case("j10_container_names", "SELECT concat('ct-', l_linenumber) AS container FROM lineitem WHERE l_orderkey = 77")
def _(t):
    pods = t.lineitem.select(
        text("pod-", F.col("l_orderkey")).alias("name"),
        F.array(F.struct(text("ct-", F.col("l_linenumber")).alias("name"))).alias("containers"),
    )
    return joins.container_names(pods, "pod-77")


@case("j11_first_job_of_cluster", """WITH c AS (SELECT DISTINCT c_custkey AS cluster_id FROM customer),
  f AS (SELECT o_custkey AS cluster_id, min(o_orderkey) AS job_id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT cluster_id, job_id, CASE WHEN job_id IS NULL THEN 'EMPTY_JOB_IN_CLUSTER' END AS error
  FROM c LEFT JOIN f USING (cluster_id)""")
def _(t):
    clusters = t.customer.select(F.col("c_custkey").alias("cluster_id"))
    rows = t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("job_id")
    )
    return joins.first_job_of_cluster(clusters, rows, ["cluster_id"])


@case("w5_first_of", """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
  FROM events GROUP BY user_id""")
def _(t):
    return changes.first_of(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@case("a5_keys_by_cluster", f"WITH {JOBS} SELECT DISTINCT cluster_id, namespace, job_id FROM jobs")
def _(t):
    return aggregates.keys_by_cluster(jobs(t))


@case("a5_key_counts", f"WITH {JOBS} SELECT cluster_id, namespace, count(DISTINCT job_id) AS keys FROM jobs GROUP BY 1, 2")
def _(t):
    return aggregates.key_counts(jobs(t))


@case("a10_state_counts", f"""WITH {JOBS} SELECT cluster_id, namespace,
  count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'RESTARTING') AS restarting,
  count(*) FILTER (state = 'FINISHED') AS finished, count(*) FILTER (state = 'FAILED') AS failed
  FROM jobs GROUP BY 1, 2""")
def _(t):
    return aggregates.state_counts(jobs(t), states=("RUNNING", "RESTARTING", "FINISHED", "FAILED"))


@case("a10_task_counts", """SELECT l_orderkey AS job_id, count(*) AS total,
  count(*) FILTER (l_linestatus = 'O') AS running, count(*) FILTER (l_linestatus = 'F') AS finished
  FROM lineitem GROUP BY 1""")
def _(t):
    state = F.when(F.col("l_linestatus") == "O", "RUNNING").otherwise("FINISHED")
    tasks = t.lineitem.select(F.col("l_orderkey").alias("job_id"), state.alias("state"))
    return aggregates.task_counts(tasks, ["job_id"], states=("RUNNING", "FINISHED"))


@case("a11_random_member", f"""WITH {JOBS} SELECT cluster_id, namespace,
    arg_min(job_id, md5(concat(CAST(job_id AS VARCHAR), '#42'))) AS job_id FROM jobs GROUP BY 1, 2""")
def _(t):
    return aggregates.random_member(jobs(t), ["cluster_id", "namespace"], "job_id", 42)


@case("a11_random_members_are_members", f"WITH {JOBS} SELECT DISTINCT cluster_id, namespace, true AS found FROM jobs")
def _(t):
    picked = aggregates.random_member(jobs(t), ["cluster_id", "namespace"], "job_id", 42)
    found = jobs(t).select(*K.JOB, F.lit(True).alias("found"))
    return picked.join(found, K.JOB, "left").drop("job_id")


@case("w3_page", f"""WITH {JOBS}, p AS (SELECT {COLS},
    row_number() OVER (ORDER BY job_name DESC, start_ts DESC, cluster_id, namespace, job_id) - 50 AS place FROM jobs)
  SELECT * FROM p WHERE place BETWEEN 1 AND 25""")
def _(t):
    orders = query.order_columns((("jobName", "desc"), ("startTs", "desc")))
    return placed(query.page(jobs(t), PageRequest(3, 25), orders))


CURSOR_ORDERS = [("state", "asc"), ("priority", "desc")]


@case("w3_cursor_pages", """WITH o AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END AS state,
    CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders)
  SELECT state, priority, CAST((row_number() OVER (ORDER BY state NULLS FIRST, priority DESC NULLS LAST) - 1)
    // greatest(1, (SELECT count(*) // 6 FROM o)) AS INTEGER) AS page FROM o""")
def _(t):
    # six full pages and the rest, each from where the one before it ended; nulls and many equal rows
    rows = t.orders.select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")).alias("state"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    total = rows.count()
    size, at, pages = max(1, total // 6), None, []
    for number in range(-(-total // size)):
        pages.append(cursor.cursor_page(rows, CURSOR_ORDERS, size, at).withColumn("page", F.lit(number)))
        at = cursor.next_cursor(pages[-1].drop("page"), CURSOR_ORDERS, at)
    out = pages[0]
    for part in pages[1:]:
        out = out.unionByName(part)
    return out
