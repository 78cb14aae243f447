"""Keyed state built from ordered operations: last write wins, sets with clear, changelogs, snapshots.

All rules are associative: applying an operator to the reduced rows of earlier batches plus the new rows gives the
result over all rows. The streaming forms rely on that.
"""

from pyspark.sql import functions as F

from fleetlens.operators.spread import spread_join, with_rank


def _rest(df, keys):
    return [c for c in df.columns if c not in keys]


def latest_per_key(df, keys, order):
    """Last row per key. The aggregate combines map-side, so a hot key is reduced before the shuffle."""
    rest = _rest(df, keys)
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def live_members(ops, keys, order, op="op", scope=(), add="add", remove="remove", clear="clear"):
    """Members of sets after add / remove / clear operations; an add wins a tie.

    `scope` are the columns that name the set (a subset of `keys`); a clear row empties its whole set.
    """
    is_add = F.col(op) == add
    rank = F.struct(*order, is_add.cast("int"))
    last = ops.filter(F.col(op).isin(add, remove)).groupBy(*keys).agg(
        F.max_by(is_add, rank).alias("_live"), F.max(F.struct(*order)).alias("_seq")
    )
    cleared = ops.filter(F.col(op) == clear).groupBy(*scope).agg(F.max(F.struct(*order)).alias("_cleared"))
    return _after_reset(last, cleared, scope, keys, F.col("_seq")).filter("_live").select(*keys)


def _after_reset(rows, resets, scope, keys, seq):
    """Rows newer than the last reset of their scope. `resets` has one row per scope with `_cleared`."""
    if scope:
        # one row per scope: adaptive execution makes it a broadcast if it is small and splits hot scopes if not
        joined = rows.join(resets, list(scope), "left")
        return joined.filter(F.col("_cleared").isNull() | (seq > F.col("_cleared")))
    newest = resets.select("_cleared").scalar()
    return rows.withColumn("_cleared", newest).filter(F.col("_cleared").isNull() | (seq > F.col("_cleared")))


def reduce_changelog(events, scope, key, seq="seq", op="op", reset="Reseted"):
    """The rows of a changelog that still matter: last row per key (deletes too) and last reset per scope."""
    keyed = latest_per_key(events.filter(F.col(op) != reset), [*scope, *key], [seq])
    resets = latest_per_key(events.filter(F.col(op) == reset), list(scope), [seq])
    return keyed.unionByName(resets.select(*keyed.columns))


def materialize_changelog(events, scope, key, seq="seq", op="op", reset="Reseted", deleted="Deleted"):
    """Live rows of a changelog: a reset clears its scope, added / modified put, deleted removes.

    Events are first reduced to one row per key; only those rows meet the one row per reset scope.
    """
    keyed = latest_per_key(events.filter(F.col(op) != reset), [*scope, *key], [seq])
    resets = events.filter(F.col(op) == reset).groupBy(*scope).agg(F.max(seq).alias("_cleared"))
    live = _after_reset(keyed, resets, scope, [*scope, *key], F.col(seq))
    return live.filter(F.col(op) != deleted).drop("_cleared")


def replace_snapshot(rows, scope, seq="batch_seq"):
    """Rows of the newest full snapshot of each scope.

    The newest number of each scope, one row, meets the rows in a semi-join, whose large side adaptive execution splits.
    """
    newest = rows.groupBy(*scope).agg(F.max(seq).alias(seq))
    return rows.join(newest, [*scope, seq], "left_semi").select(*rows.columns)


def reconcile(state, listing, keys):
    """State rows whose key is in the newest listing."""
    return state.join(listing.select(*keys), list(keys), "left_semi")


def reconcile_and_upsert(listings, records, scope, key, seq="seq", rows=None):
    """Latest record per key, kept only while every poll since that record listed the key.

    `listings` has one row per (scope, poll, key); a poll that listed nothing has one row with a null key.
    """
    polls = listings.select(*scope, seq).distinct()
    numbered = with_rank(polls, list(scope), [seq], "_poll", rows)
    newest = numbered.groupBy(*scope).agg(F.max("_poll").alias("_polls"))
    last = latest_per_key(records, [*scope, *key], [seq])
    since = last.select(*scope, *key, F.col(seq).alias("_since"))
    listed = listings.filter(F.col(key[0]).isNotNull()).select(*scope, *key, seq)
    listed = spread_join(listed, since, [*scope, *key], [seq], "inner", rows).filter(F.col(seq) > F.col("_since"))
    listed = listed.groupBy(*scope, *key).agg(F.count_distinct(seq).alias("_seen"))
    # a record belongs to the poll with its own number
    at = last.join(numbered, [*scope, seq], "left")
    at = at.join(newest, list(scope), "left").join(listed, [*scope, *key], "left")
    missed = F.col("_polls") - F.col("_poll") - F.coalesce("_seen", F.lit(0))
    return at.filter(missed == 0).select(*records.columns)


def size(df, keys):
    """Number of distinct keys as one row; a missing table counts as empty."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("size"))


def contains(df, wanted, keys):
    """The wanted keys with a flag that tells whether the state holds them."""
    held = df.select(*keys).distinct().withColumn("_held", F.lit(True))
    flag = F.coalesce("_held", F.lit(False))
    return wanted.join(held, list(keys), "left").withColumn("contained", flag).drop("_held")


def distinct_keys(df, keys):
    return df.select(*keys).distinct()


def update_existing(state, updates, keys, changes):
    """Apply `changes` (column to new value) where the key has an update; other rows stay.

    `updates` has one row per key; its columns are seen by the changes as `new.<col>`.
    """
    new = updates.select(*keys, F.struct(*updates.columns).alias("new"))
    joined = state.join(new, list(keys), "left")
    cols = {c: F.when(F.col("new").isNotNull(), v).otherwise(F.col(c)) for c, v in changes.items()}
    return joined.withColumns(cols).select(*state.columns)


def upsert(state, updates, keys, put, changes):
    """Insert `put` for new keys, apply `changes` to old ones. Both map a column to its new value.

    Both sides hold one row per key, so no key can be hot.
    """
    old = state.withColumn("_old", F.lit(True))
    new = updates.select(*keys, F.struct(*updates.columns).alias("new"))
    joined = old.join(new, list(keys), "full")
    cols = {
        c: F.when(F.col("_old").isNull(), put.get(c, F.lit(None)))
        .when(F.col("new").isNotNull(), changes.get(c, F.col(c)))
        .otherwise(F.col(c))
        for c in _rest(state, keys)
    }
    return joined.withColumns(cols).select(*state.columns)


def state_query(df, predicate):
    """User read hook: any boolean column."""
    return df.filter(predicate)


def state_update(df, keys, changes):
    """User update hook on every row; `changes` maps a column to its new value."""
    bad = set(changes) & set(keys)
    if bad:
        raise ValueError(f"keys cannot be updated: {sorted(bad)}")
    return df.withColumns(changes)


def apply_increments(state, increments, keys, col):
    """Repeated increments are summed per key (map-side first) and added to existing keys only."""
    total = increments.groupBy(*keys).agg(F.sum(col).alias(col))
    return update_existing(state, total, keys, {col: F.col(col) + F.col(f"new.{col}")})


def snapshot_diff(old, new, keys, cols=None):
    """added / removed / changed / same per key, with the old and new values as structs.

    Both snapshots go through one grouping; `cols` leaves out columns such as the ingest time.
    """
    cols = cols or _rest(new, keys)
    tag = lambda df, side: df.select(*keys, F.struct(*cols).alias("_row"), F.lit(side).alias("_side"))
    pick = lambda side: F.max(F.when(F.col("_side") == side, F.col("_row"))).alias(side)
    both = tag(old, "old").unionByName(tag(new, "new")).groupBy(*keys).agg(pick("old"), pick("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "same")
        .otherwise("changed")
    )
    return both.withColumn("change", change)


def keys_minus(a, b, keys):
    """Keys of a that b does not hold."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def union_all(frames):
    """All rows of several tables with the same columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def put_all(state, rows, keys, order):
    """Bulk put: the newest row per key wins."""
    return latest_per_key(state.unionByName(rows), keys, order)


def remove_all(state, gone, keys):
    """Bulk remove."""
    return state.join(gone.select(*keys), list(keys), "left_anti")


def gate_by_tracking(df, tracking, keys, seq, op="op", start="Start", stop="Stop", rows=None):
    """Rows of tracked clusters only. A stop drops all that came before it, also after a new start."""
    stops = tracking.filter(F.col(op) == stop).groupBy(*keys).agg(F.max(seq).alias("_stop"))
    starts = tracking.filter(F.col(op) == start).select(*keys, F.col(seq).alias("_start"))
    since = (
        spread_join(starts, stops, list(keys), ["_start"], "left", rows)
        .filter(F.col("_stop").isNull() | (F.col("_start") > F.col("_stop")))
        .groupBy(*keys)
        .agg(F.min("_start").alias("_start"))
    )
    return spread_join(df, since, list(keys), [seq], "inner", rows).filter(F.col(seq) >= F.col("_start")).select(*df.columns)
