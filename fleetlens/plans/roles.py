"""Roles that the sample tables play, in DataFrame form and as SQL fragments."""

from pyspark.sql import functions as F


def epoch_ms(col):
    return F.unix_millis(F.col(col).cast("timestamp"))


def text(prefix, col):
    return F.concat(F.lit(prefix), col.cast("string"))


def jobs(t):
    """Orders as job overviews."""
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "RESTARTING")
    return _jobs(t.orders, state)


def _jobs(orders, state):
    return orders.select(
        text("c", F.col("o_custkey") % 50).alias("cluster_id"),
        F.col("o_orderpriority").alias("namespace"),
        F.col("o_orderkey").alias("job_id"),
        text("job-", F.col("o_orderkey") % 7).alias("job_name"),
        state.otherwise("FINISHED").alias("state"),
        epoch_ms("o_orderdate").alias("start_ts"),
    )


JOBS = """jobs AS (
  SELECT concat('c', o_custkey % 50) AS cluster_id, o_orderpriority AS namespace, o_orderkey AS job_id,
         concat('job-', o_orderkey % 7) AS job_name,
         CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'RESTARTING' ELSE 'FINISHED' END AS state,
         epoch_ms(o_orderdate) AS start_ts
  FROM orders)"""

STATE_ORDER = """CASE state WHEN 'RUNNING' THEN 2 WHEN 'FINISHED' THEN 7 WHEN 'RESTARTING' THEN 8 END"""


def op_of(kinds):
    """Operation names by event type; `kinds` gives (reset, add, change, remove)."""
    reset, add, change, remove = kinds
    kind = F.col("event_type")
    return (
        F.when(F.col("event_id") % 997 == 0, reset)
        .when(kind == "signup", add)
        .when(kind == "error", remove)
        .otherwise(change)
    )


def changelog(events):
    """Events as change events of users in scopes."""
    return events.select(
        (F.col("user_id") % 10).alias("scope"),
        F.col("user_id").alias("k"),
        F.col("event_id").alias("seq"),
        op_of(("Reseted", "Added", "Modified", "Deleted")).alias("op"),
        "event_type",
        "value",
    )


CHANGELOG = """changelog AS (
  SELECT user_id % 10 AS scope, user_id AS k, event_id AS seq, event_type, value,
         CASE WHEN event_id % 997 = 0 THEN 'Reseted' WHEN event_type = 'signup' THEN 'Added'
              WHEN event_type = 'error' THEN 'Deleted' ELSE 'Modified' END AS op
  FROM events),
resets AS (SELECT scope, max(seq) AS reset_seq FROM changelog WHERE op = 'Reseted' GROUP BY scope),
valid AS (
  SELECT c.* FROM changelog c LEFT JOIN resets r USING (scope)
  WHERE op <> 'Reseted' AND (reset_seq IS NULL OR seq > reset_seq)),
live AS (
  SELECT scope, k, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(event_type, seq) AS event_type,
         arg_max(value, seq) AS value
  FROM valid GROUP BY scope, k HAVING arg_max(op, seq) <> 'Deleted')"""


def set_ops(events):
    """Events as add / remove / clear operations."""
    return events.select(
        (F.col("user_id") % 10).alias("scope"),
        F.col("user_id").alias("k"),
        F.col("event_id").alias("seq"),
        op_of(("clear", "add", "add", "remove")).alias("op"),
    )


def cents(col):
    return F.round(F.col(col) * 100).cast("bigint")
