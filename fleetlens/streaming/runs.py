"""Structured Streaming forms.

Each stream reduces its micro-batch with the batch operator (map-side first) and writes the reduced rows as one batch
of a `BatchTable`; the view over the table is the batch operator again. The operators are associative, so the view
equals the batch result over all rows, late rows included, and a repeated micro-batch changes nothing. Only operators
that emit rows by comparing with earlier ones (changes, errors, watches) read the table while streaming.
"""

from functools import partial

from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.keys import CLUSTER, JOB
from fleetlens.operators import changes, state, watch
from fleetlens.operators.spread import hashable, newest_rows, spread_join
from fleetlens.operators.usage import usage_by_live_pods
from fleetlens.sources import payloads, tables
from fleetlens.sources.objects import endpoint_table

# Batches between two compactions of a table that is read while streaming.
COMPACT_EVERY = 50

# Size of a row group of tables whose rows may hold whole payloads.
ROW_GROUP = 16 << 20


def run(stream, checkpoint, each_batch, available_now=True, interval="10 seconds"):
    """Start a stream of micro-batches; with `available_now` it ends when all input is done."""
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def _fold(i, fold):
    """Merge the batches of a table that only grows every now and then, and the merged ones at longer intervals."""
    if i and i % COMPACT_EVERY == 0:
        fold(i, level=1)
        if i % COMPACT_EVERY ** 2 == 0:
            fold(i, level=2)


def _schema(df, cols=None):
    return df.select(*cols).schema if cols else df.schema


def _put(table, rows, i, reduce):
    """Write a reduced batch; every now and then fold the batches into one with the same rule."""
    table.write(rows, i)
    if i and i % COMPACT_EVERY == 0:
        table.compact(i, reduce)


def stream_latest(stream, table_path, checkpoint, keys, order, **options):
    """Last row per key. View: `latest_per_key` over the table."""
    table = tables.BatchTable(stream.sparkSession, table_path, stream.schema)
    reduce = lambda df: state.latest_per_key(df, keys, order)
    query = run(stream, checkpoint, lambda b, i: _put(table, reduce(b), i, reduce), **options)
    return query, lambda: reduce(table.read())


def stream_changelog(stream, table_path, checkpoint, scope, key, seq="seq", op="op", **options):
    """Keyed view of a changelog. Deletes and resets stay as marker rows, so that late events revive nothing."""
    table = tables.BatchTable(stream.sparkSession, table_path, stream.schema)
    reduce = lambda df: state.reduce_changelog(df, scope, key, seq, op)
    query = run(stream, checkpoint, lambda b, i: _put(table, reduce(b), i, reduce), **options)
    return query, lambda: state.materialize_changelog(table.read(), scope, key, seq, op)


def stream_members(stream, table_path, checkpoint, keys, order, scope=(), **options):
    """Members of sets with add / remove / clear."""
    table = tables.BatchTable(stream.sparkSession, table_path, stream.schema)

    def reduce(b):
        # an add wins a tie, so adds rank above removes of the same order value
        ranked = b.withColumn("_add", (F.col("op") == "add").cast("int"))
        last = state.latest_per_key(ranked.filter("op != 'clear'"), keys, [*order, "_add"])
        clears = ranked.filter("op = 'clear'")
        clears = state.latest_per_key(clears, list(scope), order) if scope else clears.orderBy(
            *[F.desc(c) for c in order]).limit(1)
        return last.unionByName(clears.select(*last.columns)).drop("_add")

    query = run(stream, checkpoint, lambda b, i: _put(table, reduce(b), i, reduce), **options)
    return query, lambda: state.live_members(table.read(), keys, order, scope=scope)


def stream_snapshots(stream, table_path, checkpoint, scope, seq="batch_seq", cols=None, **options):
    """Newest full snapshot per scope; with `cols` a narrow index of it."""
    narrow = stream.select(*cols) if cols else stream
    table = tables.BatchTable(stream.sparkSession, table_path, narrow.schema)
    reduce = lambda df: state.replace_snapshot(df, scope, seq)
    query = run(narrow, checkpoint, lambda b, i: _put(table, reduce(b), i, reduce), **options)
    return query, lambda: state.replace_snapshot(table.read(), scope, seq)


def maintain_index(stream, table_path, checkpoint, seq="batch_seq", cols=("job_name", "state", "start_ts"), **options):
    """Job index (name, state, start) of the newest snapshot of each cluster."""
    return stream_snapshots(stream, table_path, checkpoint, CLUSTER, seq, [*JOB, *cols, seq], **options)


def stream_reconciled(listings, records, path, checkpoint, scope, key, seq="seq", **options):
    """Two streams, polls and records; the view keeps records that every later poll listed."""
    spark = listings.sparkSession
    polls = tables.BatchTable(spark, f"{path}/polls", listings.schema)
    held = tables.BatchTable(spark, f"{path}/records", records.schema)
    distinct = lambda b: b.distinct()
    one = run(listings, f"{checkpoint}/polls", lambda b, i: _put(polls, distinct(b), i, distinct), **options)
    reduce = lambda b: state.latest_per_key(b, [*scope, *key], [seq])
    two = run(records, f"{checkpoint}/records", lambda b, i: _put(held, reduce(b), i, reduce), **options)
    return (one, two), lambda: state.reconcile_and_upsert(polls.read(), held.read(), scope, key, seq)


def stream_gated(stream, tracking, table_path, checkpoint, keys, seq, **options):
    """Rows of tracked clusters. `tracking` gives the Start / Stop rows when the view is asked for.

    All rows are kept, as a Start may come later than the rows that it covers.
    """
    table = tables.BatchTable(stream.sparkSession, table_path, stream.schema)
    query = run(stream, checkpoint, lambda b, i: _put(table, b, i, lambda df: df), **options)
    return query, lambda: state.gate_by_tracking(table.read(), tracking(), keys, seq)


def stream_endpoints(services, table_path, checkpoint, seq="seq", op="op", **options):
    """Endpoint per cluster from service change events (typed rows with op and seq); a reset clears endpoints."""
    query, view = stream_changelog(services, table_path, checkpoint, CLUSTER, ["name"], seq, op, **options)
    return query, lambda: endpoint_table(view())


def stream_both(stream, current_path, history_path, checkpoint, **options):
    """One micro-batch goes into the current and the history table, both under its batch id."""
    spark = stream.sparkSession
    current, history = tables.current_table(spark, current_path), tables.history_table(spark, history_path)

    def each(b, i):
        rows = b.persist()
        tables.write_current(rows, current, i)
        tables.write_history(rows, history, i)
        rows.unpersist()
        _fold(i, partial(tables.fold_history, history))
        if i and i % COMPACT_EVERY == 0:
            tables.compact_current(current, i)

    query = run(stream, checkpoint, each, **options)
    return query, lambda: tables.read_current(current), lambda: history.read().dropDuplicates([*JOB, "ts"])


def ingest_overviews(payload_stream, path, checkpoint, **options):
    """Landed job payloads into current, history and rejected rows, one parse and one read per micro-batch.

    Gives (query, current, history, rejected). Unreadable payloads and unknown states are rejected with the rules that
    they break; the index of jobs is a projection of the current rows.
    """
    spark = payload_stream.sparkSession
    checked = payloads.checked_job_overview(payload_stream)
    current, history = tables.current_table(spark, f"{path}/current"), tables.history_table(spark, f"{path}/history")
    rejected = tables.BatchTable(spark, f"{path}/rejected", checked.drop("tasks").schema)

    def each(b, i):
        rows = b.persist()
        good = rows.filter(F.size("broken_rules") == 0).drop("broken_rules", "bad_payload")
        tables.write_current(good, current, i)
        tables.write_history(good, history, i)
        rejected.write(rows.filter(F.size("broken_rules") > 0).drop("tasks"), i)
        rows.unpersist()
        _fold(i, partial(tables.fold_history, history))
        _fold(i, rejected.fold)
        if i and i % COMPACT_EVERY == 0:
            tables.compact_current(current, i)

    query = run(checked, checkpoint, each, **options)
    return query, lambda: tables.read_current(current), lambda: tables.newest_by_key(history.read(), [*JOB, "ts"], ()), rejected.read


def stream_changes(stream, path, checkpoint, keys, order, cols, rows=None, where=None, prepare=None, lateness=None,
                   **options):
    """Rows that differ from the row before of their key, over all micro-batches; with `where` among those rows only.
    `prepare` turns each micro-batch into the rows to compare. Gives (query, view, log, late).

    Late rows are taken in their place: a late row is compared with the row before it, and the row after it with the late
    one. What that changes is written to the log as rows with `weight` 1 (from now on a change) or -1 (no longer one); the
    view is the sum of the log. Rows of a key with equal `order` follow each other by a hash of the row.

    All rows are kept to compare with, unless `lateness` (in the unit of the numeric first order column) is given: then a
    compaction leaves only the last row per key of those that are older than the newest row less `lateness`, and rows that
    come after it and are older than that bound go to `late`. Keys must not be null.

    Rows are compared by `keys`, `order`, `cols` and the hash, which is kept with them: columns besides these (payloads)
    are read for the rows of the log only, once these are known.
    """
    source = stream if where is None else stream.filter(where)
    spark = stream.sparkSession
    prepare = prepare or (lambda b: b)
    shape = prepare(spark.createDataFrame([], source.schema))
    fields, total = shape.columns, [*keys, *order, "_hash"]
    compared = list(dict.fromkeys([*total, *cols]))
    rest = [c for c in fields if c not in compared]
    told = lambda df: df.withColumn("_hash", F.xxhash64(*hashable(df.select(*fields))))
    table = lambda name, schema: tables.BatchTable(spark, f"{path}/{name}", schema, row_group=ROW_GROUP)
    log = table("out", told(shape).withColumn("weight", F.lit(1)).schema)
    seen = table("seen", told(shape).schema)
    bounds = tables.BatchTable(spark, f"{path}/bounds", "bound DOUBLE")
    late = table("late", shape.schema)
    at = F.struct(*order)
    # a table that was written without the hash gets it at its next compaction
    hashed = told if not seen.read().filter("_hash IS NULL").isEmpty() else (lambda df: df)

    def net(df, names=tuple(fields)):
        row = F.any_value(F.struct(*[c for c in names if c not in total])).alias("_rest")
        out = df.groupBy(*total).agg(row, F.sum("weight").cast("int").alias("weight")).filter("weight <> 0")
        cols = [F.col(c) if c in total else F.col(f"_rest.{c}") for c in names if c != "_hash"]
        return out.select(*cols, "_hash", "weight")

    def changed(df, weight):
        found = changes.only_changes(df, keys, [*order, "_hash"], cols, rows).filter("_compared").drop("_compared")
        return found.withColumn("weight", F.lit(weight))

    def whole(df, held):
        """Rows of the log with the columns that weren't compared, from the rows that were held."""
        key = F.struct(*total).alias("_key")  # as one value, so that null equals null
        found = held.select(key, F.struct(*rest).alias("_rest"))
        both = df.select(key, F.struct(*[c for c in compared if c not in total], "weight").alias("_row")).join(found, "_key")
        both = both.groupBy("_key").agg(F.any_value("_row").alias("_row"), F.any_value("_rest").alias("_rest"))
        side = lambda c: "_key" if c in total else "_rest" if c in rest else "_row"
        return both.select(*[F.col(f"{side(c)}.{c}").alias(c) for c in [*fields, "_hash", "weight"]])

    def each(b, i):
        b = prepare(b)
        bound = bounds.read(before=i).agg(F.max("bound")).first()[0]
        if bound is not None:
            late.write(b.filter(F.col(order[0]) < bound), i)
            b = b.filter(F.col(order[0]) >= bound)
        # what follows reads the written rows, and of them only the columns that it needs
        seen.write(told(b), i)
        b, held = seen.read_batch(i), hashed(seen.read(before=i))
        new = b.select(*compared)
        low = new.groupBy(*keys).agg(F.min(at).alias("_low"))
        # of the rows before this batch those that follow its first row of a key, and the one before that
        old = spread_join(held.select(*compared), low, list(keys), order, "inner", rows)
        after = old.filter(at >= F.col("_low")).drop("_low").withColumn("_compared", F.lit(True))
        before = newest_rows(old.filter(at < F.col("_low")).drop("_low"), keys, [*order, "_hash"], 1, rows)
        known = after.unionByName(before.withColumn("_compared", F.lit(False))).persist()
        now = changed(known.unionByName(new.withColumn("_compared", F.lit(True))), 1)
        found = net(now.unionByName(changed(known, -1)), compared)
        log.write(whole(found, held.unionByName(b)) if rest else found, i)
        known.unpersist()
        if i and i % COMPACT_EVERY == 0:
            log.compact(i, net)
            seen.compact(i, lambda df: fold(hashed(df), i))

    def fold(df, i):
        if lateness is None:
            return df
        newest = df.agg(F.max(order[0])).first()[0]
        if newest is None:
            return df
        bounds.write(spark.createDataFrame([(float(newest - lateness),)], "bound DOUBLE"), i)
        recent = F.col(order[0]) >= newest - lateness
        last = newest_rows(df.filter(~recent), keys, [*order, "_hash"], 1, rows)
        return df.filter(recent).unionByName(last)

    query = run(source, checkpoint, each, **options)
    deltas = lambda: log.read().drop("_hash")
    return query, lambda: net(log.read()).filter("weight > 0").select(*fields), deltas, late.read


def jobs_fingerprint(payload):
    """Order-free 64-bit fingerprint of the jobs of an overview payload, without the time of the poll; null if the payload
    can't be read. It is made in the row: a poll comes whole, in one payload."""
    p = F.from_json(payload, f"{S.JOB_OVERVIEW}, _corrupt_record STRING")
    jobs = F.array_sort(F.transform(p["jobs"], lambda j: F.xxhash64(j)))
    jobs = F.coalesce(jobs, F.array().cast("array<bigint>"))
    # through an array of one, so that the jobs aren't parsed once more for their number; a row without fields is parsed fast
    jobs_print = F.transform(F.array(jobs), lambda j: F.xxhash64(F.size(j), j))[0]
    some = F.from_json(payload, "_corrupt_record STRING").isNotNull()
    return F.when(some & p["_corrupt_record"].isNull(), jobs_print)


def ingest_changed_overviews(payload_stream, path, checkpoint, lateness=None, **options):
    """History without the polls that repeat the one before: typed rows of the polls of a cluster whose set of jobs, in any
    order, differs from that of the poll before by `ts`. Gives (query, view, late).

    Late polls are taken in their place, and `lateness` bounds what is kept, as in `stream_changes`. A poll without jobs
    counts as one. A payload that can't be read is no poll and changes nothing (`ingest_overviews` keeps it as rejected),
    nor is one without cluster, namespace or time.
    """
    poll = [*CLUSTER, "ts", "payload"]

    def prepare(b):
        rows = b.select(*poll, jobs_fingerprint(F.col("payload")).alias("jobs_print"))
        # through a generator, so that the payload isn't parsed once more for the filter
        rows = rows.select(*poll, F.explode(F.array("jobs_print")).alias("jobs_print"))
        return rows.dropna(subset=[*CLUSTER, "ts", "jobs_print"])

    query, view, _, late = stream_changes(
        payload_stream, path, checkpoint, CLUSTER, ["ts"], ["jobs_print"], prepare=prepare, lateness=lateness, **options)
    return query, lambda: payloads.payload_job_overview(view()), late


def stream_set_changes(stream, path, checkpoint, keys, order, cols, **options):
    """Snapshots whose set of rows differs from the snapshot before. A snapshot may come in several micro-batches.

    The table holds the distinct row hashes of each snapshot; the view makes their fingerprints and compares them.
    """
    hashed = changes.row_hashes(stream, [*keys, *order], cols)
    table = tables.BatchTable(stream.sparkSession, path, hashed.schema)
    distinct = lambda df: df.distinct()
    query = run(hashed, checkpoint, lambda b, i: _put(table, distinct(b), i, distinct), **options)
    return query, lambda: changes.changed_prints(changes.fingerprint_of(table.read(), [*keys, *order]), keys, order)


def stream_multiset_changes(stream, path, checkpoint, keys, order, cols, key=None, **options):
    """Snapshots whose rows, repeated ones counted, differ from the snapshot before. A snapshot may come in several
    micro-batches, in any order: its fingerprint is a sum, so the table has one row per snapshot after a compaction.

    With `key`, rows that repeat the key of a snapshot within a micro-batch count once.
    """
    group = [*keys, *order]
    prints = lambda df: changes.multiset_fingerprint(df, group, cols, key)
    merged = lambda df: changes.merge_fingerprints(df, group)
    table = tables.BatchTable(stream.sparkSession, path, prints(stream.sparkSession.createDataFrame([], stream.schema)).schema)
    query = run(stream, checkpoint, lambda b, i: _put(table, prints(b), i, merged), **options)
    return query, lambda: changes.changed_prints(merged(table.read()), keys, order)


def stream_upserts(stream, table_path, checkpoint, schema, keys, combine, put, updates, insert=True, **options):
    """State rows that are inserted (`put`) or updated (`updates`) per key; with insert=False only updated.

    `combine` are the aggregates that merge the updates of one key within a micro-batch, for example a sum; `put` and
    `updates` see them as `new.<col>`. `schema` is that of the state. Each batch writes the rows that it touched.
    """
    table = tables.BatchTable(stream.sparkSession, table_path, f"{schema}, _batch BIGINT")
    reduce = lambda df: state.latest_per_key(df, keys, ["_batch"])

    def each(b, i):
        merged = b.groupBy(*keys).agg(*combine).persist()
        old = reduce(table.read(before=i).join(merged.select(*keys), list(keys), "left_semi")).drop("_batch")
        if insert:
            touched = state.upsert(old, merged, keys, put, updates)
        else:
            touched = state.update_existing(old, merged, keys, updates)
        table.write(touched.withColumn("_batch", F.lit(i)), i)
        merged.unpersist()
        if i and i % COMPACT_EVERY == 0:
            table.compact(i, reduce)

    query = run(stream, checkpoint, each, **options)
    return query, lambda: reduce(table.read()).drop("_batch")


def stream_usage(pods, readings, path, checkpoint, scope, key, seq="seq", op="op", **options):
    """Two streams, pod events and usage readings; the view keeps the newest reading of each live pod."""
    spark = pods.sparkSession
    held = tables.BatchTable(spark, f"{path}/pods", pods.schema)
    used = tables.BatchTable(spark, f"{path}/usage", readings.schema)

    def reduce(b):
        # besides the last event, the last delete of a pod counts: older usage must not come back
        deletes = state.latest_per_key(b.filter(F.col(op) == "Deleted"), [*scope, *key], [seq])
        last = state.reduce_changelog(b, scope, key, seq, op)
        return last.unionByName(deletes.select(*last.columns)).distinct()

    one = run(pods, f"{checkpoint}/pods", lambda b, i: _put(held, reduce(b), i, reduce), **options)
    newest = lambda b: state.latest_per_key(b, [*scope, *key], [seq])
    two = run(readings, f"{checkpoint}/usage", lambda b, i: _put(used, newest(b), i, newest), **options)
    return (one, two), lambda: usage_by_live_pods(held.read(), used.read(), scope, key, seq, op)


def stream_first_errors(stream, path, checkpoint, keys, order, is_error, message, **options):
    """First error of each run of equal errors, per key; successes do not count. Gives (query, view)."""
    return stream_changes(stream, path, checkpoint, keys, order, [message], where=is_error, **options)[:2]


def stream_watch(stream, table_path, checkpoint, keys, ts, is_start, is_done, timeout, rows=None, **options):
    """Async operations until complete or timed out. Kept per batch: first starts, completions, and the newest event
    time. Of an operation whose start is known, only the first completion from then on is kept; the completions of one
    whose start comes later are all kept, until a compaction knows the start."""
    spark = stream.sparkSession
    schema = stream.select(*keys, ts, F.lit("").alias("kind")).schema
    table = tables.BatchTable(spark, table_path, schema)

    def each(b, i):
        kinds = F.when(is_start, "start").when(is_done, "done")
        own = b.select(*keys, ts, kinds.alias("kind")).filter("kind IS NOT NULL")
        both = b.filter(is_start & is_done).select(*keys, ts, F.lit("done").alias("kind"))
        tick = b.agg(F.max(ts).alias(ts)).select(*[F.lit(None).alias(k) for k in keys], ts, F.lit("tick").alias("kind"))
        _put(table, reduce(own.unionByName(both)).unionByName(tick), i, reduce)

    def reduce(df):
        starts = df.filter("kind = 'start'").groupBy(*keys).agg(F.min(ts).alias(ts))
        done = df.filter("kind = 'done'").select(*keys, F.col(ts).alias("_done")).distinct()
        done = spread_join(done, starts.withColumnRenamed(ts, "_start"), keys, ["_done"], "left", rows)
        late = done.filter(F.col("_done") >= F.col("_start")).groupBy(*keys).agg(F.min("_done").alias(ts))
        early = done.filter(F.col("_start").isNull()).select(*keys, F.col("_done").alias(ts))
        tick = df.filter("kind = 'tick'").groupBy("kind").agg(F.max(ts).alias(ts))
        tick = tick.select(*[F.lit(None).alias(k) for k in keys], ts, "kind")
        marked = lambda x, name: x.withColumn("kind", F.lit(name))
        return marked(starts, "start").unionByName(marked(late.unionByName(early), "done")).unionByName(tick)

    query = run(stream, checkpoint, each, **options)
    kind = F.col("kind")
    return query, lambda: watch.watch_until_complete(
        table.read(), keys, ts, kind == "start", kind == "done", timeout, rows=rows
    )
