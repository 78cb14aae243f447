"""Streams whose tables stay bounded: what can no longer change a result is folded or released.

Each of these operators knows from a bound on lateness (`delay`, in the unit of the order column; for event time an interval)
up to where its input is complete. Rows up to there are folded at a compaction: polls into one row per key that tells the
last gap, Start and Stop rows into the open interval of a key, gated rows outside of all intervals are released. Rows
that come later than the delay allows are put aside in a table of late rows, never dropped. Without a delay nothing is
folded and every row may come at any time.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.keys import JOB
from fleetlens.operators import state
from fleetlens.operators.spread import spread_join, with_rank
from fleetlens.sources import payloads, tables
from fleetlens.streaming import runs

# kinds of rows of a table of polls
_POLL, _KEY, _SCOPE = "poll", "key", "scope"


def fold_polls(table, scope, key, seq="seq", delay=None):
    """The rows of a table of polls with those older than the newest poll of the scope less `delay` folded.

    A `poll` row is a listed key of a poll (a null key: the poll listed nothing). Folded are a `scope` row (`seq`: its last
    folded poll, `upto`: what is folded) and a `key` row for each key that this last poll listed (`seq`: the last poll before
    that didn't list it, null if there is none). A key without a row wasn't listed by the last folded poll.
    """
    raw = table.filter(F.col("kind") == _POLL).distinct()
    if delay is None:
        return raw.unionByName(table.filter(F.col("kind") != _POLL))
    head = table.filter(F.col("kind") == _SCOPE).select(*scope, F.col(seq).alias("_last"), F.col("upto").alias("_before"))
    bound = raw.groupBy(*scope).agg((F.max(seq) - delay).alias("_bound"))
    bound = bound.join(head, list(scope), "full").withColumn("_bound", F.greatest("_bound", "_before"))
    marked = raw.join(bound.select(*scope, "_bound"), list(scope))
    recent = marked.filter(F.col(seq) > F.col("_bound")).select(*table.columns)
    old = marked.filter(F.col(seq) <= F.col("_bound"))
    polls = old.select(*scope, seq).distinct()
    place = Window.partitionBy(*scope).orderBy(F.desc(seq))
    polls = polls.withColumn("_place", F.row_number().over(place))
    newest = polls.groupBy(*scope).agg(F.max(seq).alias("_new"))
    listed = old.filter(F.col(key[0]).isNotNull()).select(*scope, *key, seq).join(polls, [*scope, seq])
    own = Window.partitionBy(*scope, *key).orderBy(F.desc(seq))
    listed = listed.withColumn("_n", F.row_number().over(own))
    # from the newest poll back, a key is listed without a gap as long as its rows and the polls are numbered alike
    run = listed.groupBy(*scope, *key).agg(F.coalesce(F.max(F.when(F.col("_n") == F.col("_place"), F.col("_n"))), F.lit(0)).alias("_run"))
    held = table.filter(F.col("kind") == _KEY).select(*scope, *key, F.col(seq).alias("_gap"), F.lit(True).alias("_held"))
    both = run.join(held, [*scope, *key], "full").withColumn("_place", F.coalesce("_run", F.lit(0)) + 1)
    both = both.join(polls.withColumnRenamed(seq, "_missed"), [*scope, "_place"], "left").join(bound, list(scope), "left")
    both = both.join(newest, list(scope), "left").withColumn("_last_new", F.coalesce("_new", "_last"))
    gap = F.coalesce("_missed", F.when(F.col("_held"), F.col("_gap")).otherwise(F.col("_last")))
    keys = both.withColumn(seq, gap).filter(F.col(seq).isNull() | (F.col(seq) < F.col("_last_new")))
    none = lambda c: F.lit(None).cast(table.schema[c].dataType).alias(c)
    keys = keys.select(*scope, *key, seq, F.lit(_KEY).alias("kind"), none("upto"))
    scopes = bound.join(newest, list(scope), "left").select(
        *scope, *[none(k) for k in key], F.coalesce("_new", "_last").alias(seq), F.lit(_SCOPE).alias("kind"), F.col("_bound").alias("upto"))
    out = lambda df: df.select(*[F.col(c).cast(table.schema[c].dataType) for c in table.columns])
    return out(recent).unionByName(out(keys)).unionByName(out(scopes))


def reconcile_folded(table, records, scope, key, seq="seq", rows=None):
    """Latest record per key, kept only while every poll since that record listed the key; see `fold_polls`."""
    raw = table.filter(F.col("kind") == _POLL).select(*scope, *key, seq)
    numbered = with_rank(raw.select(*scope, seq).distinct(), list(scope), [seq], "_poll", rows)
    newest = numbered.groupBy(*scope).agg(F.max("_poll").alias("_polls"))
    last = state.latest_per_key(records, [*scope, *key], [seq])
    since = last.select(*scope, *key, F.col(seq).alias("_since"))
    listed = spread_join(raw.filter(F.col(key[0]).isNotNull()), since, [*scope, *key], [seq], "inner", rows)
    listed = listed.filter(F.col(seq) > F.col("_since")).groupBy(*scope, *key).agg(F.count_distinct(seq).alias("_seen"))
    head = table.filter(F.col("kind") == _SCOPE).select(*scope, F.col(seq).alias("_last"), F.col("upto").alias("_upto"))
    held = table.filter(F.col("kind") == _KEY).select(*scope, *key, F.col(seq).alias("_gap"), F.lit(True).alias("_held"))
    at = last.join(numbered, [*scope, seq], "left").join(newest, list(scope), "left").join(listed, [*scope, *key], "left")
    at = at.join(head, list(scope), "left").join(held, [*scope, *key], "left")
    own = F.coalesce("_poll", F.when(F.col(seq) <= F.col("_upto"), F.lit(0)))
    missed = F.coalesce("_polls", F.lit(0)) - own - F.coalesce("_seen", F.lit(0))
    gap = F.when(F.col("_held"), F.col("_gap")).otherwise(F.col("_last"))
    return at.filter((missed == 0) & (gap.isNull() | (gap <= F.col(seq)))).select(*records.columns)


def stream_reconciled(listings, records, path, checkpoint, scope, key, seq="seq", delay=None, compact_every=None, **options):
    """Two streams, polls and records; the view keeps records that every later poll listed. Gives (queries, view, late).

    With `delay` the table of polls is folded by `fold_polls` at each compaction.
    """
    spark = listings.sparkSession
    shape = listings.select(*scope, *key, seq).withColumns({"kind": F.lit(_POLL), "upto": F.col(seq)})
    polls = tables.BatchTable(spark, f"{path}/polls", shape.schema)
    late = tables.BatchTable(spark, f"{path}/late", listings.select(*scope, *key, seq).schema)
    held = tables.BatchTable(spark, f"{path}/records", records.schema)

    def each(b, i):
        b = b.select(*scope, *key, seq).distinct()
        if delay is not None:
            folded = polls.read(before=i).filter(F.col("kind") == _SCOPE).select(*scope, F.col("upto").alias("_upto"))
            b = b.join(folded, list(scope), "left").persist()
            late.write(b.filter(F.col(seq) <= F.col("_upto")).drop("_upto"), i)
            b = b.filter(F.col("_upto").isNull() | (F.col(seq) > F.col("_upto"))).drop("_upto")
        polls.write(b.withColumns({"kind": F.lit(_POLL), "upto": F.lit(None)}), i)
        if i and i % (compact_every or runs.COMPACT_EVERY) == 0:
            polls.compact(i, lambda df: fold_polls(df, scope, key, seq, delay))

    newest = lambda df: state.latest_per_key(df, [*scope, *key], [seq])
    one = runs.run(listings, f"{checkpoint}/polls", each, **options)
    two = runs.run(records, f"{checkpoint}/records", lambda b, i: runs._put(held, newest(b), i, newest), **options)
    return (one, two), lambda: reconcile_folded(polls.read(), held.read(), scope, key, seq), late.read


def fold_tracking(tracking, keys, seq="seq", op="op", upto=None, start="Start", stop="Stop"):
    """The Start and Stop rows that can still count: the last Stop of a key, and of the Starts after it the first of
    those up to `upto` (where the rows are complete) and all later ones."""
    stops = tracking.filter(F.col(op) == stop).groupBy(*keys).agg(F.max(seq).alias("_stop"))
    starts = tracking.filter(F.col(op) == start).select(*keys, seq).distinct().join(stops, list(keys), "left")
    starts = starts.filter(F.col("_stop").isNull() | (F.col(seq) > F.col("_stop"))).select(*keys, seq)
    if upto is not None:
        first = starts.filter(F.col(seq) <= upto).groupBy(*keys).agg(F.min(seq).alias(seq))
        starts = starts.filter(F.col(seq) > upto).unionByName(first)
    rows = starts.withColumn(op, F.lit(start)).unionByName(stops.withColumnRenamed("_stop", seq).withColumn(op, F.lit(stop)))
    return rows.select(*tracking.columns)


def release_untracked(df, tracking, keys, seq="seq", op="op", upto=None, rows=None, start="Start", stop="Stop"):
    """The rows that can still be within tracking: not before the last Stop of their key, and of those up to `upto`, where
    the Start and Stop rows are complete, only the ones that a Start comes before."""
    stops = tracking.filter(F.col(op) == stop).groupBy(*keys).agg(F.max(seq).alias("_stop"))
    starts = tracking.filter(F.col(op) == start).select(*keys, F.col(seq).alias("_start")).join(stops, list(keys), "left")
    first = starts.filter(F.col("_stop").isNull() | (F.col("_start") > F.col("_stop"))).groupBy(*keys).agg(F.min("_start").alias("_start"))
    open_from = stops.join(first, list(keys), "full")
    out = spread_join(df, open_from, list(keys), [seq], "left", rows)
    out = out.filter(F.col("_stop").isNull() | (F.col(seq) >= F.col("_stop")))
    if upto is not None:
        out = out.filter((F.col(seq) > upto) | (F.col(seq) >= F.col("_start")))
    return out.select(*df.columns)


def stream_gated(stream, tracking, path, checkpoint, keys, seq="seq", op="op", delay=None, rows=None, compact_every=None,
                 **options):
    """Rows of tracked keys, from a stream of rows and one of Start / Stop rows. Gives (queries, view, late).

    Rows may come before the Start that covers them. At a compaction the rows that no Start can cover any more are
    released, and the Start and Stop rows are folded; with `delay`, Start and Stop rows are complete up to the newest one
    less `delay`, and those that come later still go to `late`.
    """
    spark = stream.sparkSession
    table = tables.BatchTable(spark, f"{path}/rows", stream.schema)
    known = tables.BatchTable(spark, f"{path}/tracking", tracking.select(*keys, seq, op).schema)
    bounds = tables.BatchTable(spark, f"{path}/bounds", "upto BIGINT")
    late = tables.BatchTable(spark, f"{path}/late", tracking.select(*keys, seq, op).schema)
    folded = lambda before=None: bounds.read(before).agg(F.max("upto")).first()[0]

    def track(b, i):
        b = b.select(*keys, seq, op)
        upto = folded(i)
        if upto is not None:
            late.write(b.filter(F.col(seq) <= upto), i)
            b = b.filter(F.col(seq) > upto)
        known.write(b.distinct(), i)
        if i and i % (compact_every or runs.COMPACT_EVERY) == 0:
            newest = known.read(before=i + 1).agg(F.max(seq)).first()[0]
            upto = None if delay is None or newest is None else newest - delay
            known.compact(i, lambda df: fold_tracking(df, keys, seq, op, upto))
            if upto is not None:
                bounds.write(spark.createDataFrame([(int(upto),)], "upto BIGINT"), i)

    def each(b, i):
        table.write(b, i)
        if i and i % (compact_every or runs.COMPACT_EVERY) == 0:
            table.compact(i, lambda df: release_untracked(df, known.read(), keys, seq, op, folded(), rows))

    one = runs.run(tracking, f"{checkpoint}/tracking", track, **options)
    two = runs.run(stream, f"{checkpoint}/rows", each, **options)
    return (one, two), lambda: state.gate_by_tracking(table.read(), known.read(), keys, seq, op, rows=rows), late.read


def stream_watch(stream, path, checkpoint, keys, ts, is_start, is_done, timeout, delay, **options):
    """Async operations until complete or timed out, by Spark's event time. Gives (queries, view).

    `ts` is a timestamp column, `timeout` and `delay` intervals ("1 day"). Starts and completions meet in a stream-stream
    outer join within the timeout, whose state Spark drops when the watermark (the newest event less `delay`) has passed;
    that is when an operation without a completion comes out as timed out. The table has the first start of each key and its
    first completion. An operation that has not come out is in progress. Events later than the delay are dropped by Spark.
    """
    spark = stream.sparkSession
    marked = stream.withWatermark(ts, delay)
    # the condition reads the event time, so that it is not moved below the watermark, which is that of all events
    of = lambda kind: marked.filter(F.when(F.col(ts).isNotNull(), kind).otherwise(F.lit(False)))
    starts = of(is_start).select(*keys, F.col(ts).alias("start_ts"))
    done = of(is_done).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(ts).alias("completed_ts"))
    on = F.expr(f"completed_ts >= start_ts AND completed_ts <= start_ts + INTERVAL {timeout}")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    ended = starts.join(done, on, "left").select(*keys, "start_ts", "completed_ts")
    began = tables.BatchTable(spark, f"{path}/starts", starts.schema)
    out = tables.BatchTable(spark, f"{path}/ended", ended.schema)
    first = lambda df: df.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"))
    known = stream.filter(is_start).select(*keys, F.col(ts).alias("start_ts"))

    def least(df):
        # of each start the first completion; only those of the first start that came out matter
        rank = F.struct(F.col("start_ts"), F.col("completed_ts").isNull(), "completed_ts")
        return df.groupBy(*keys, "start_ts").agg(F.min_by("completed_ts", rank).alias("completed_ts"))

    one = runs.run(known, f"{checkpoint}/starts", lambda b, i: runs._put(began, first(b), i, first), **options)
    two = runs.run(ended, f"{checkpoint}/ended", lambda b, i: runs._put(out, least(b), i, least), **options)

    def view():
        found = least(out.read()).withColumn("_out", F.lit(True))
        status = (F.when(F.col("completed_ts").isNotNull(), "COMPLETED").when(F.col("_out"), "WATCH_TIMEOUT")
                  .otherwise("IN_PROGRESS"))
        return first(began.read()).join(found, [*keys, "start_ts"], "left").withColumn("status", status).drop("_out")

    return (one, two), view


def stream_metric_keys(stream, path, checkpoint, keys=tuple(JOB), payload="payload", ts="ts", delay="1 hour", **options):
    """Distinct metric ids of a stream of metric payloads. Gives (query, view, rejected).

    An id that comes again while the watermark has not passed its first time by `delay` is left out by Spark, whose state
    is dropped behind the watermark; the table, reduced by each compaction, keeps one row per key and id. Payloads that can't
    be read are kept in `rejected` with their keys and time. `ts` is a timestamp.
    """
    spark = stream.sparkSession
    marked = stream.withWatermark(ts, delay)
    parsed = payloads.parsed(marked, S.METRICS, payload)
    bad = F.col(payload).isNotNull() & F.col("_p").isNull()
    both = parsed.select(*keys, ts, F.when(bad, F.col(payload)).alias("bad_payload"), F.explode_outer("_p.id").alias("id"))
    both = both.filter("id IS NOT NULL OR bad_payload IS NOT NULL")
    once = both.dropDuplicatesWithinWatermark([*keys, "id", "bad_payload"])
    found = tables.BatchTable(spark, f"{path}/ids", both.select(*keys, "id").schema)
    rejected = tables.BatchTable(spark, f"{path}/rejected", both.select(*keys, ts, "bad_payload").schema)
    distinct = lambda df: df.distinct()

    def each(b, i):
        rows = b.persist()
        rejected.write(rows.filter("bad_payload IS NOT NULL").select(*keys, ts, "bad_payload"), i)
        runs._put(found, distinct(rows.filter("id IS NOT NULL").select(*keys, "id")), i, distinct)
        rows.unpersist()

    query = runs.run(once, checkpoint, each, **options)
    return query, lambda: distinct(found.read()), rejected.read
