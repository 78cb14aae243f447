"""Keyed state, changelogs, snapshots and changes over events."""

from pyspark.sql import functions as F

from fleetlens.operators import changes, state, usage, watch
from fleetlens.plans.registry import case
from fleetlens.plans.roles import CHANGELOG, changelog, epoch_ms, set_ops

LAST = """last AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id)"""


def _events(t):
    return t.events.select("user_id", "event_id", "event_type", "value")


def _last(t):
    return state.latest_per_key(_events(t), ["user_id"], ["event_id"])


@case("a1_latest_per_key", f"WITH {LAST} SELECT user_id, event_id, event_type, value FROM last")
def _(t):
    return _last(t)


MEMBERS = """ops AS (SELECT user_id % 10 AS scope, user_id AS k, event_id AS seq,
    CASE WHEN event_id % 997 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op FROM events),
  clears AS (SELECT scope, max(seq) AS cleared FROM ops WHERE op = 'clear' GROUP BY scope),
  members AS (SELECT scope, k FROM ops LEFT JOIN clears USING (scope)
    WHERE op <> 'clear' AND (cleared IS NULL OR seq > cleared) GROUP BY scope, k HAVING arg_max(op, seq) = 'add')"""


@case("a2_live_members", f"WITH {MEMBERS} SELECT scope, k FROM members")
def _(t):
    return state.live_members(set_ops(t.events), ["scope", "k"], ["seq"], scope=["scope"])


@case("a2_live_members_one_set", """WITH ops AS (SELECT user_id AS k, event_id AS seq, event_type AS op FROM events)
  SELECT k FROM ops WHERE op IN ('signup', 'error')
    AND seq > (SELECT max(event_id) FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-10')
  GROUP BY k HAVING arg_max(op, seq) = 'signup'""")
def _(t):
    kind = F.col("event_type")
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    op = F.when((kind == "click") & early, "clear").when(kind == "error", "remove").when(
        kind == "signup", "add")
    ops = t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"))
    return state.live_members(ops, ["k"], ["seq"])


@case("a3_size", f"WITH {MEMBERS} SELECT count(*) AS size FROM members")
def _(t):
    return state.size(state.live_members(set_ops(t.events), ["scope", "k"], ["seq"], scope=["scope"]), ["scope", "k"])


@case("a3_contains", """SELECT c_custkey AS user_id,
  c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS contained FROM customer""")
def _(t):
    wanted = t.customer.select(F.col("c_custkey").alias("user_id"))
    return state.contains(t.events.filter("event_type = 'purchase'"), wanted, ["user_id"])


@case("a4_distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return state.distinct_keys(t.events, ["user_id", "event_type"])


@case("a7_update_existing", f"""WITH {LAST}, up AS (
    SELECT c_custkey AS user_id, c_acctbal AS value FROM customer WHERE c_acctbal > 3000)
  SELECT user_id, event_id, event_type, CASE WHEN up.value IS NOT NULL THEN last.value + up.value ELSE last.value END AS value
  FROM last LEFT JOIN up USING (user_id)""")
def _(t):
    up = t.customer.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return state.update_existing(_last(t), up, ["user_id"], {"value": F.col("value") + F.col("new.value")})


@case("a8_upsert", f"""WITH {LAST}, up AS (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer
    WHERE c_acctbal > 5000)
  SELECT coalesce(last.user_id, up.user_id) AS user_id,
         CASE WHEN last.user_id IS NULL THEN -1 ELSE event_id END AS event_id,
         CASE WHEN last.user_id IS NULL THEN 'new' ELSE event_type END AS event_type,
         CASE WHEN last.user_id IS NULL THEN up.value WHEN up.user_id IS NULL THEN last.value
              ELSE greatest(last.value, up.value) END AS value
  FROM last FULL JOIN up ON last.user_id = up.user_id""")
def _(t):
    up = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    put = {"event_id": F.lit(-1).cast("bigint"), "event_type": F.lit("new"), "value": F.col("new.value")}
    return state.upsert(_last(t), up, ["user_id"], put, {"value": F.greatest(F.col("value"), F.col("new.value"))})


@case("u1_state_query", f"WITH {LAST} SELECT user_id, value FROM last WHERE value > 20 OR value < 3")
def _(t):
    return state.state_query(_last(t), (F.col("value") > 20) | (F.col("value") < 3)).select("user_id", "value")


@case("u2_state_update", f"""WITH {LAST} SELECT user_id, last.value + sum(c_nationkey) AS value
  FROM last JOIN customer ON user_id = c_custkey % 200 GROUP BY user_id, last.value
  UNION ALL SELECT user_id, value FROM last WHERE user_id NOT IN (SELECT c_custkey % 200 FROM customer)""")
def _(t):
    increments = t.customer.select((F.col("c_custkey") % 200).alias("user_id"), F.col("c_nationkey").alias("value"))
    return state.apply_increments(_last(t).select("user_id", "value"), increments, ["user_id"], "value")


@case("u2_state_update_all", f"WITH {LAST} SELECT user_id, event_id + 10 AS event_id FROM last")
def _(t):
    return state.state_update(_last(t), ["user_id"], {"event_id": F.col("event_id") + 10}).select("user_id", "event_id")


@case("u3_set_hooks", f"WITH {MEMBERS} SELECT scope, k FROM members WHERE k > 5 AND scope < 8")
def _(t):
    members = state.live_members(set_ops(t.events), ["scope", "k"], ["seq"], scope=["scope"])
    return state.state_query(members, (F.col("k") > 5) & (F.col("scope") < 8))


@case("o1_snapshot_diff", """WITH old AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events
    WHERE ts < TIMESTAMP '2024-01-15' AND event_type IN ('signup', 'view') GROUP BY 1),
  new AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events
    WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-16' AND event_type <> 'error' GROUP BY 1)
  SELECT coalesce(o.user_id, n.user_id) AS user_id, o.event_type AS old_type, n.event_type AS new_type,
    CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed'
         WHEN o.event_type = n.event_type THEN 'same' ELSE 'changed' END AS change
  FROM old o FULL JOIN new n ON o.user_id = n.user_id""")
def _(t):
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    last = lambda rows: state.latest_per_key(rows.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])
    old = t.events.filter(F.col("ts") < day("2024-01-15")).filter("event_type IN ('signup', 'view')")
    new = t.events.filter((F.col("ts") >= day("2024-01-13")) & (F.col("ts") < day("2024-01-16"))).filter("event_type <> 'error'")
    diff = state.snapshot_diff(last(old), last(new), ["user_id"], ["event_type"])
    return diff.select(
        "user_id", F.col("old.event_type").alias("old_type"), F.col("new.event_type").alias("new_type"), "change"
    )


# the first half of each user's events, by number
HALVES = """h AS (SELECT user_id, event_id, event_type, event_id * 2 <= min(event_id) OVER (PARTITION BY user_id)
    + max(event_id) OVER (PARTITION BY user_id) AS early FROM events)"""


def _halves(t):
    ends = t.events.groupBy("user_id").agg((F.min("event_id") + F.max("event_id")).alias("ends"))
    rows = t.events.select("user_id", "event_id", "event_type").join(ends, "user_id")
    return rows.withColumn("early", F.col("event_id") * 2 <= F.col("ends")).drop("ends")


@case("o1_snapshot_diff_halves", f"""WITH {HALVES}, old AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM h
    WHERE early AND event_type <> 'error' AND user_id % 11 <> 0 GROUP BY 1),
  new AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM h WHERE user_id % 7 <> 0 GROUP BY 1)
  SELECT coalesce(o.user_id, n.user_id) AS user_id, o.event_type AS old_type, n.event_type AS new_type,
    CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed'
         WHEN o.event_type = n.event_type THEN 'same' ELSE 'changed' END AS change
  FROM old o FULL JOIN new n ON o.user_id = n.user_id""")
def _(t):
    rows = _halves(t)
    last = lambda df: state.latest_per_key(df.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])
    old = last(rows.filter("early AND event_type <> 'error' AND user_id % 11 <> 0"))
    diff = state.snapshot_diff(old, last(rows.filter("user_id % 7 <> 0")), ["user_id"], ["event_type"])
    return diff.select(
        "user_id", F.col("old.event_type").alias("old_type"), F.col("new.event_type").alias("new_type"), "change")


@case("j7_reconcile_halves", f"""WITH {HALVES}, {LAST} SELECT user_id, event_id, event_type, value FROM last
  WHERE user_id IN (SELECT user_id FROM h WHERE NOT early AND event_type IN ('signup', 'purchase'))""")
def _(t):
    listing = _halves(t).filter("NOT early AND event_type IN ('signup', 'purchase')").select("user_id").distinct()
    return state.reconcile(_last(t), listing, ["user_id"])


@case("a2_live_members_ties", """WITH ops AS (SELECT user_id AS k, event_id // 3 AS seq,
    CASE WHEN event_id % 97 = 0 AND event_id * 10 <= (SELECT max(event_id) FROM events) THEN 'clear' WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'add' END AS op FROM events)
  SELECT k FROM ops WHERE op <> 'clear' AND seq > coalesce((SELECT max(seq) FROM ops WHERE op = 'clear'), -1)
  GROUP BY k HAVING max(seq) FILTER (op = 'add') >= coalesce(max(seq) FILTER (op = 'remove'), -1)""")
def _(t):
    # several events have one number: an add wins
    kind = F.col("event_type")
    early = F.col("event_id") * 10 <= t.events.agg(F.max("event_id")).scalar()
    op = F.when((F.col("event_id") % 97 == 0) & early, "clear").when(kind.isin("error", "view"), "remove").otherwise("add")
    seq = F.floor(F.col("event_id") / 3).alias("seq")
    return state.live_members(t.events.select(F.col("user_id").alias("k"), seq, op.alias("op")), ["k"], ["seq"])


@case("o2_keys_minus", """SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN
  (SELECT user_id FROM events WHERE event_type = 'error' AND value > 80)""")
def _(t):
    a, b = t.events.filter("event_type = 'signup'"), t.events.filter("event_type = 'error' AND value > 80")
    return state.keys_minus(a, b, ["user_id"])


@case("o3_union_all", """SELECT event_id, user_id FROM events WHERE event_type = 'view'
  UNION ALL SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click')""")
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    frames = [rows.filter("event_type = 'view'"), rows.filter("event_type IN ('view', 'click')")]
    return state.union_all(frames).drop("event_type")


@case("o4_put_all_remove_all", """WITH s AS (SELECT user_id, max(event_id) AS event_id FROM events
    WHERE event_type IN ('signup', 'view') GROUP BY 1)
  SELECT user_id, event_id FROM s WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)""")
def _(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    keyed = lambda kind: rows.filter(F.col("event_type") == kind).drop("event_type")
    put = state.put_all(keyed("signup"), keyed("view"), ["user_id"], ["event_id"])
    gone = t.customer.filter("c_acctbal < 1000").select(F.col("c_custkey").alias("user_id"))
    return state.remove_all(put, gone, ["user_id"])


@case("j7_reconcile", f"""WITH {LAST} SELECT user_id, event_id, event_type, value FROM last
  WHERE user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')""")
def _(t):
    listing = t.events.filter(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).select("user_id").distinct()
    return state.reconcile(_last(t), listing, ["user_id"])


@case("t1_materialize_changelog", f"WITH {CHANGELOG} SELECT scope, k, seq, op, event_type, value FROM live")
def _(t):
    return state.materialize_changelog(changelog(t.events), ["scope"], ["k"])


def snapshots(events):
    return events.select(
        (F.col("user_id") % 10).alias("scope"), F.floor(F.col("event_id") / 500).alias("batch_seq"),
        "event_id", "user_id", "event_type",
    )


SNAPSHOTS = """snaps AS (SELECT user_id % 10 AS scope, event_id // 500 AS batch_seq, event_id, user_id, event_type
  FROM events), newest AS (SELECT * FROM snaps
  QUALIFY batch_seq = max(batch_seq) OVER (PARTITION BY scope))"""


@case("t2_replace_snapshot", f"WITH {SNAPSHOTS} SELECT scope, batch_seq, event_id, user_id, event_type FROM newest")
def _(t):
    return state.replace_snapshot(snapshots(t.events), ["scope"])


def polls(events):
    return snapshots(events).filter("event_type <> 'error'").select(
        "scope", F.col("user_id").alias("k"), F.col("batch_seq").alias("seq")
    )


def poll_records(events):
    return snapshots(events).filter("event_type = 'purchase'").select(
        "scope", F.col("user_id").alias("k"), F.col("batch_seq").alias("seq")
    ).distinct()


RECONCILED = """p AS (SELECT DISTINCT user_id % 10 AS scope, user_id AS k, event_id // 500 AS seq FROM events
    WHERE event_type <> 'error'),
  polls AS (SELECT DISTINCT scope, seq FROM p),
  r AS (SELECT user_id % 10 AS scope, user_id AS k, max(event_id // 500) AS seq FROM events
    WHERE event_type = 'purchase' GROUP BY 1, 2),
  kept AS (SELECT r.scope, r.k, r.seq FROM r WHERE
    (SELECT count(*) FROM polls q WHERE q.scope = r.scope AND q.seq > r.seq) =
    (SELECT count(*) FROM p WHERE p.scope = r.scope AND p.k = r.k AND p.seq > r.seq))"""


@case("t3_reconcile_and_upsert", f"WITH {RECONCILED} SELECT scope, k, seq FROM kept")
def _(t):
    return state.reconcile_and_upsert(polls(t.events), poll_records(t.events), ["scope"], ["k"])


DAY_MS = 86_400_000


def timed(events):
    return events.select("user_id", epoch_ms("ts").alias("tms"), "event_type")


WATCHED = f"""e AS (SELECT user_id, epoch_us(ts) // 1000 AS tms, event_type FROM events),
  s AS (SELECT user_id, min(tms) AS start_ts FROM e WHERE event_type = 'signup' GROUP BY 1),
  d AS (SELECT user_id, min(tms) AS completed_ts FROM e JOIN s USING (user_id)
    WHERE event_type = 'purchase' AND tms >= start_ts AND tms <= start_ts + {DAY_MS} GROUP BY 1),
  watched AS (SELECT user_id, start_ts, completed_ts, CASE WHEN completed_ts IS NOT NULL THEN 'COMPLETED'
    WHEN (SELECT max(tms) FROM e) > start_ts + {DAY_MS} THEN 'WATCH_TIMEOUT' ELSE 'IN_PROGRESS' END AS status
    FROM s LEFT JOIN d USING (user_id))"""


@case("t5_watch_until_complete", f"WITH {WATCHED} SELECT user_id, start_ts, completed_ts, status FROM watched")
def _(t):
    kind = F.col("event_type")
    return watch.watch_until_complete(
        timed(t.events), ["user_id"], "tms", kind == "signup", kind == "purchase", DAY_MS
    )


def tracking(events):
    op = F.when(F.col("event_type") == "signup", "Start").when(F.col("event_type") == "error", "Stop")
    return events.select("user_id", F.col("event_id").alias("seq"), op.alias("op")).filter("op IS NOT NULL")


GATED = """stops AS (SELECT user_id, max(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY 1),
  starts AS (SELECT e.user_id, min(event_id) AS start FROM events e LEFT JOIN stops USING (user_id)
    WHERE event_type = 'signup' AND (stop IS NULL OR event_id > stop) GROUP BY 1),
  gated AS (SELECT e.user_id, event_id AS seq, value FROM events e JOIN starts USING (user_id)
    WHERE event_type = 'view' AND event_id >= start)"""


@case("t6_gate_by_tracking", f"WITH {GATED} SELECT user_id, seq, value FROM gated")
def _(t):
    rows = t.events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("seq"), "value")
    return state.gate_by_tracking(rows, tracking(t.events), ["user_id"], "seq")


USAGE = f"""{CHANGELOG},
  pods AS (SELECT scope, k, max(seq) AS last_seq, max(seq) FILTER (op = 'Deleted') AS del FROM changelog
    WHERE op <> 'Reseted' GROUP BY 1, 2),
  alive AS (SELECT scope, k, del, reset_seq FROM pods LEFT JOIN resets USING (scope)
    WHERE (del IS NULL OR last_seq > del) AND (reset_seq IS NULL OR last_seq > reset_seq)),
  u AS (SELECT user_id % 10 AS scope, user_id AS k, max(event_id) AS seq, arg_max(value, event_id) AS cpu FROM events
    WHERE event_type = 'view' GROUP BY 1, 2),
  used AS (SELECT u.scope, u.k, u.seq, cpu FROM u JOIN alive USING (scope, k)
    WHERE (del IS NULL OR u.seq > del) AND (reset_seq IS NULL OR u.seq > reset_seq))"""


@case("t10_usage_by_live_pods", f"WITH {USAGE} SELECT scope, k, seq, cpu FROM used")
def _(t):
    views = t.events.filter("event_type = 'view'").select(
        (F.col("user_id") % 10).alias("scope"), F.col("user_id").alias("k"), F.col("event_id").alias("seq"),
        F.col("value").alias("cpu"),
    )
    return usage.usage_by_live_pods(changelog(t.events), views, ["scope"], ["k"])


CHANGED = """changed AS (SELECT user_id, event_id, event_type FROM (
    SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE rn = 1 OR prev IS DISTINCT FROM event_type)"""


@case("w1_only_changes", f"WITH {CHANGED} SELECT user_id, event_id, event_type FROM changed")
def _(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return changes.only_changes(rows, ["user_id"], ["event_id"], ["event_type"])


@case("w1_only_changes_hot_keys", f"WITH {CHANGED} SELECT user_id, event_id, event_type FROM changed")
def _(t):
    # every user counts as hot here, so all of them are cut into slices
    rows = t.events.select("user_id", "event_id", "event_type")
    return changes.only_changes(rows, ["user_id"], ["event_id"], ["event_type"], rows=20)


SETS = """s AS (SELECT user_id % 50 AS grp, event_id // 500 AS batch,
    string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS members, count(DISTINCT event_type) AS n
  FROM events GROUP BY 1, 2)"""


@case("w1_only_set_changes", f"""WITH {SETS} SELECT grp, batch, n AS members FROM (
  SELECT *, lag(members) OVER (PARTITION BY grp ORDER BY batch) AS prev FROM s) WHERE prev IS DISTINCT FROM members""")
def _(t):
    rows = t.events.select(
        (F.col("user_id") % 50).alias("grp"), F.floor(F.col("event_id") / 500).alias("batch"), "event_type"
    )
    return changes.only_set_changes(rows, ["grp"], ["batch"], ["event_type"]).select("grp", "batch", "members")


MULTISETS = """s AS (SELECT user_id % 50 AS grp, event_id // 500 AS batch, count(*) AS members,
    string_agg(event_type, ',' ORDER BY event_type) AS rows FROM events GROUP BY 1, 2)
  SELECT grp, batch, members FROM (SELECT *, lag(rows) OVER (PARTITION BY grp ORDER BY batch) AS prev FROM s)
  WHERE prev IS DISTINCT FROM rows"""


def kinds(events):
    return events.select((F.col("user_id") % 50).alias("grp"), F.floor(F.col("event_id") / 500).alias("batch"), "event_type")


@case("w1_only_multiset_changes", f"WITH {MULTISETS}")
def _(t):
    return changes.only_multiset_changes(kinds(t.events), ["grp"], ["batch"], ["event_type"]).select("grp", "batch", "members")


@case("a9_multiset_fingerprint", """WITH s AS (SELECT user_id % 50 AS grp, event_id // 500 AS batch, count(*) AS members,
    string_agg(event_type, ',' ORDER BY event_type) AS rows FROM events GROUP BY 1, 2)
  SELECT grp, batch, members, count(*) OVER (PARTITION BY batch, rows) AS twins FROM s""")
def _(t):
    # two parts that were made separately add up to the fingerprint of the whole
    rows, group = kinds(t.events).withColumn("half", F.xxhash64("event_type", "grp") % 2), ["grp", "batch"]
    half = lambda h: changes.multiset_fingerprint(rows.filter(F.col("half") == h if h == 0 else F.col("half") != 0), group, ["event_type"])
    prints = changes.merge_fingerprints(half(0).unionByName(half(1)), group)
    twins = prints.groupBy("batch", "hash1", "hash2", "members").agg(F.count(F.lit(1)).alias("twins"))
    return prints.join(twins, ["batch", "hash1", "hash2", "members"]).select("grp", "batch", "members", "twins")


@case("a9_set_fingerprint", f"""WITH {SETS} SELECT a.grp, a.batch, a.n AS members,
  (SELECT count(*) FROM s b WHERE b.batch = a.batch AND b.members = a.members) AS twins FROM s a""")
def _(t):
    rows = t.events.select(
        (F.col("user_id") % 50).alias("grp"), F.floor(F.col("event_id") / 500).alias("batch"), "event_type"
    )
    prints = changes.set_fingerprint(rows, ["grp", "batch"], ["event_type"])
    same = ["batch", "hash1", "hash2", "members"]
    twins = prints.groupBy(*same).agg(F.count(F.lit(1)).alias("twins"))
    return prints.join(twins, same).select("grp", "batch", "members", "twins")


ERRORS = """errs AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS message FROM events
    WHERE event_type = 'error'),
  firsts AS (SELECT user_id, event_id, message FROM (
    SELECT *, lag(message) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM errs)
    WHERE prev IS DISTINCT FROM message)"""


def outcomes(events):
    message = F.get_json_object("props", "$.k").cast("bigint") % 3
    return events.select("user_id", "event_id", "event_type", message.alias("message"))


@case("w2_first_of_error_runs", f"WITH {ERRORS} SELECT user_id, event_id, message FROM firsts")
def _(t):
    out = changes.first_of_error_runs(
        outcomes(t.events), ["user_id"], ["event_id"], F.col("event_type") == "error", "message"
    )
    return out.drop("event_type")
