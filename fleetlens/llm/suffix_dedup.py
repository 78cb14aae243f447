"""Removal of repeated byte strings by sorting sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. Sorting every suffix would take many times
the input, so the suffixes are sampled by their content: every window of `length` bytes has an anchor, the place of the
smallest hash among the short strings that start in it. Equal windows have equal anchors at the same offset, so only
windows with anchors of equal leading bytes need to be compared, and nothing is missed.

1. The anchored suffixes are range-partitioned by sampled splitters, over leading bytes, hash of the anchor, hash of the
   window run around it, document and place. So a frequent anchor spreads over many partitions. Sorted neighbours are
   compared, also across the boundaries of partitions. Runs that occur twice are settled.
2. What shares its anchor with others but not the run around it is compared by bytes: buckets of equal anchors sort the
   suffixes of their windows by a multikey sort, eight bytes at a time, which drops a suffix once it is alone.
3. Anchors with too many different runs for one bucket are compared by counted window hashes (128 bits) instead.
"""

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from fleetlens.llm.common import signed, text_bytes, written

LENGTH = 200
ANCHOR = 40
# different window runs around one anchor that a bucket sorts; beyond it, window hashes are counted
BUCKET_RUNS = 4096

_PIECE = 1 << 17
_BITS = 18
_CHUNK_BYTES = 2 << 20
# bytes of the rows that Spark sends to Python at a time, one row at least; the JVM holds several times that off its heap
_BATCH_BYTES = 4 << 20
# anchors that are gathered for a batch, beyond those of one document
_BATCH_ANCHORS = 1 << 16
_WORDS = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)

# kinds of anchors
_ALONE, _OPEN, _SETTLED, _SHOWN = 0, 1, 2, 3  # _SHOWN: settled, and compared with the open ones of its anchor


def _join(a, b):
    """Hash of two adjacent strings from their hashes."""
    n = min(a.size, b.size)
    out = a[:n] * _MIX + b[:n]
    out ^= out >> np.uint64(29)
    return out


def _string_hashes(data, size):
    """Hash of the `size` bytes at each place, from hashes of strings of doubled length."""
    power, out, offset = _WORDS[data], None, 0
    width = 1
    while True:
        if size & width:
            out = power if out is None else _join(out, power[offset:])
            offset += width
        width *= 2
        if width > size:
            return out[: data.size - size + 1]
        power = _join(power, power[width // 2 :])


def _window_minima(values, width):
    """Smallest value of each run of `width` values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: values.size - rest], values[rest:]) if rest else values


def anchors(data, length=LENGTH, size=ANCHOR):
    """(place, first window, last window, hash) of the anchors of a text, in order; each window belongs to one."""
    places, firsts, lasts, hashes = [], [], [], []
    for low in range(0, len(data) - length + 1, _PIECE):
        high = min(low + _PIECE, len(data) - length + 1)
        part = np.frombuffer(data, np.uint8, high - low + length - 1, low)
        own = _string_hashes(part, size)
        marked = (own >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(own.size, dtype=np.uint64)
        best = (_window_minima(marked, length - size + 1) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        end = np.append(start[1:], best.size) - 1
        places.append(best[start] + low)
        firsts.append(start + low)
        lasts.append(end + low)
        hashes.append(own[best[start]])
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    places, firsts, lasts = map(np.concatenate, (places, firsts, lasts))
    hashes = np.concatenate(hashes)
    # an anchor whose windows reach into the next piece
    new = np.append(True, places[1:] != places[:-1])
    lasts = np.maximum.reduceat(lasts, np.flatnonzero(new))
    return places[new], firsts[new], lasts, hashes[new]


def _packed(place, first, last):
    return place << 16 | (place - first) << 8 | (place - last)


def _unpacked(pack):
    place = pack >> 16
    return place, place - (pack >> 8 & 255), place - (pack & 255)


def _anchor_rows(batches, length, size):
    """key1: leading bytes and hash of the anchor; key2: hash of the window run around it; row, pack."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts, n = [], 0
        for row, data in zip(batch.column("row").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if not data or len(data) < length:
                continue
            place, first, last, own = anchors(data, length, size)
            raw = np.frombuffer(data, np.uint8)
            lead = np.zeros(place.size, np.uint64)
            for i in range(4):
                lead = lead << np.uint64(8) | raw[place + i]
            mixed = own * _MIX
            key1 = lead << np.uint64(32) | mixed >> np.uint64(32)
            runs = zip(first.tolist(), (last + length).tolist(), (place - first).tolist(), strict=True)
            key2 = np.array([digest(data[a:b], offset) for a, b, offset in runs], np.uint64)
            parts.append((key1, key2, np.full(place.size, row, np.int64), _packed(place, first, last)))
            n += place.size
            if n > _BATCH_ANCHORS:
                yield _rows_of(parts)
                parts, n = [], 0
        yield _rows_of(parts)


def _rows_of(parts):
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    names = ["key1", "key2", "row", "pack"]
    # the order of the signed number is that of the leading bytes
    flip = np.uint64(1 << 63)
    columns[0] = (columns[0].view(np.uint64) ^ flip).view(np.int64)
    columns[1] = columns[1].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _compared(batches):
    """Kinds of the anchors of a sorted partition; its first and last row come with the number of the partition."""
    part = TaskContext.get().partitionId()
    before, held = None, None  # last row that is done; rows that wait for their next one
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in ("key1", "key2", "row", "pack")]
        if not own[0].size:
            continue
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        if held[0].size > 1:
            yield _kinds([c[:-1] for c in held], before, [c[-1] for c in held], part)
            before, held = [c[-2] for c in held], [c[-1:] for c in held]
    if held is not None:
        yield _kinds(held, before, None, part)


def _kinds(rows, before, after, part):
    key1, key2, row, pack = rows
    n = key1.size
    one = np.zeros(n + 1, bool)  # equal anchor of row i-1 and row i
    two = np.zeros(n + 1, bool)  # equal run too
    one[1:n] = key1[1:] == key1[:-1]
    two[1:n] = one[1:n] & (key2[1:] == key2[:-1])
    for at, other, mine in ((0, before, 0), (n, after, n - 1)):
        if other is not None:
            one[at] = key1[mine] == other[0]
            two[at] = one[at] and key2[mine] == other[1]
    settled = two[:-1] | two[1:]
    kind = np.where(settled, _SETTLED, np.where(one[:-1] | one[1:], _OPEN, _ALONE))
    # the first of equal runs is compared with other runs of its anchor: if there is one before or behind, or maybe one
    first = np.flatnonzero(~two[:-1])
    end = np.append(first[1:], n)
    others = one[first] | one[end] | (end == n) | (first == 0)
    kind[first[others & settled[first]]] = _SHOWN
    edge = np.zeros(n, bool)
    edge[0], edge[-1] = before is None, after is None
    keep = (kind != _ALONE) | edge
    number = pa.array(np.full(n, part, np.int32)[keep], mask=~edge[keep])
    columns = [pa.array(c[keep]) for c in (key1, key2, row, pack)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(kind[keep].astype(np.int32)), number], names=["key1", "key2", "row", "pack", "kind", "part"]
    )


_KINDS = "key1 long, key2 long, row long, pack long, kind int, part int"


def _across(edges):
    """The first and last rows of the partitions after comparing each with its neighbour across the boundary."""
    rows = sorted(edges, key=lambda r: (r["part"], r["key1"], r["key2"], r["row"], r["pack"]))
    kinds = [r["kind"] for r in rows]
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1]
        if a["part"] != b["part"] and a["key1"] == b["key1"]:
            if a["key2"] == b["key2"]:
                kinds[i] = kinds[i] if kinds[i] >= _SETTLED else _SHOWN
                kinds[i + 1] = max(kinds[i + 1], _SETTLED)
            else:
                kinds[i], kinds[i + 1] = max(kinds[i], _OPEN), max(kinds[i + 1], _OPEN)
    return [(r["key1"], r["row"], r["pack"], k) for r, k in zip(rows, kinds, strict=True) if k != _ALONE]


def _listed(column, names):
    """The fields of a column of lists of structs as one array each, and the bounds of each list in them (null: empty)."""
    bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
    values = column.flatten()
    return bounds.tolist(), [pc.struct_field(values, name).to_numpy(zero_copy_only=False) for name in names]


def _runs(batches, length):
    """Bytes of the asked window runs, or hashes of their windows where the anchor is too frequent for a bucket."""
    for batch in batches:
        out = []
        bounds, asked = _listed(batch.column("asked"), ("key1", "pack", "kind", "frequent"))
        rows = batch.column("row").to_pylist()
        for i, (row, data) in enumerate(zip(rows, text_bytes(batch.column("text")), strict=True)):
            own = (c[bounds[i] : bounds[i + 1]].tolist() for c in asked)
            for key1, pack, kind, frequent in zip(*own, strict=True):
                place, first, last = _unpacked(pack)
                if not frequent:
                    out.append((key1, place - first, data[first : last + length], row, first, kind, None, None))
                    if len(out) >= 20_000:
                        yield _run_batch(out)
                        out = []
                    continue
                for p in range(first, last + 1):
                    h = xxhash.xxh3_128_intdigest(data[p : p + length])
                    halves = signed([h >> 64, h & (1 << 64) - 1]).tolist()
                    out.append((key1, place - p, None, row, p, kind, *halves))
                    if len(out) >= 20_000:
                        yield _run_batch(out)
                        out = []
        yield _run_batch(out)


_RUNS = pa.schema([("key1", pa.int64()), ("offset", pa.int64()), ("bytes", pa.binary()), ("row", pa.int64()),
                   ("first", pa.int64()), ("kind", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])


def _run_batch(rows):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_RUNS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _RUNS, strict=True)], schema=_RUNS
    )


def multikey_groups(data, starts, groups, length):
    """Of the strings of `length` bytes at `starts` in `data`, those that are equal to another one of their group.

    Strings are sorted and split by eight bytes at a time, outer ones first, as windows differ there; a string that is
    alone in its class is dropped.
    """
    alive = np.arange(starts.size)
    # the eight bytes at each place, without a copy
    eight = np.ndarray(max(data.size - 7, 0), np.uint64, np.ascontiguousarray(data), strides=(1,))
    words = list(range(0, length - 7, 8)) + ([length - 8] if length % 8 else [])
    half = (len(words) + 1) // 2
    order = [w for pair in zip(words[:half], words[::-1][:half], strict=True) for w in pair]
    groups = groups.astype(np.int64)
    for word in [None, *dict.fromkeys(order)]:
        if not alive.size:
            break
        if word is None:
            sort = np.argsort(groups, kind="stable")
            key = None
        else:
            key = eight[starts[alive] + word]
            sort = np.lexsort((key, groups))
        alive, groups = alive[sort], groups[sort]
        new = np.append(True, groups[1:] != groups[:-1])
        if key is not None:
            key = key[sort]
            new[1:] |= key[1:] != key[:-1]
        groups = np.cumsum(new) - 1
        more = np.bincount(groups)[groups] > 1
        alive, groups = alive[more], groups[more]
    return np.sort(alive)


def _bucket_rows(batches, length):
    """Repeated windows (row, first, last) of open runs; rows are sorted by anchor, whose rows stay together."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key1", "offset", "bytes", "row", "first", "kind")), strict=True):
            if size > _CHUNK_BYTES and rows[-1][0] != row[0]:
                yield _bucket(rows, length)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    yield _bucket(rows, length)


def _bucket(rows, length):
    if not rows:
        return _ranges(*[np.zeros(0, np.int64)] * 3)
    key1, offset, runs, row, first, kind = zip(*rows, strict=True)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    data = np.frombuffer(b"".join(runs), np.uint8)
    base = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(runs)), windows)
    step = np.arange(owner.size) - np.repeat(np.cumsum(windows) - windows, windows)
    # equal windows have their anchor at the same offset
    anchor = np.unique(np.array(key1), return_inverse=True)[1]
    groups = anchor[owner] * 256 + (np.array(offset)[owner] - step)
    found = multikey_groups(data, base[owner] + step, groups, length)
    found = found[np.array(kind)[owner[found]] == _OPEN]
    owner, step = owner[found], step[found]
    new = np.append(True, (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)) if found.size else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.append(start[1:], found.size)[: start.size] - 1
    places = np.array(first)[owner]
    return _ranges(np.array(row)[owner[start]], places[start] + step[start], places[end] + step[end])


def _ranges(row, first, last):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c, np.int64)) for c in (row, first, last)], names=["row", "first", "last"]
    )


def repeated_windows(docs, length=LENGTH, anchor=ANCHOR, bucket_runs=BUCKET_RUNS):
    """Ranges row, first, last of the starts of all strings of `length` bytes that start elsewhere too.

    `docs` has row (a long that is not null and not repeated) and text. Ranges of a row may overlap.
    """
    if length - anchor > 255:
        raise ValueError("a window may have 255 places for its anchor")
    rows = docs.mapInArrow(lambda b: _anchor_rows(b, length, anchor), "key1 long, key2 long, row long, pack long")
    order = ["key1", "key2", "row", "pack"]
    kinds = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, _KINDS)
    kinds = written(kinds, "suffix-kinds")
    across = _across(kinds.where("part IS NOT NULL").collect())  # two rows per partition
    columns = ["key1", "row", "pack", "kind"]
    kinds = kinds.where("part IS NULL").select(*columns).union(
        docs.sparkSession.createDataFrame(across, "key1 long, row long, pack long, kind int")
    )

    open_ = kinds.where(f"kind IN ({_OPEN}, {_SHOWN})")
    frequent = open_.groupBy("key1").agg(F.count("*").alias("runs")).where(F.col("runs") > bucket_runs)
    frequent = written(frequent, "suffix-frequent").select("key1", F.lit(True).alias("frequent"))
    open_ = open_.join(frequent, "key1", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    asked = open_.groupBy("row").agg(  # of one document
        F.collect_list(F.struct("key1", "pack", "kind", "frequent")).alias("asked")
    )
    runs = docs.join(asked, "row").select("row", "text", "asked").mapInArrow(
        lambda b: _runs(b, length),
        "key1 long, offset long, bytes binary, row long, first long, kind int, high long, low long",
    )
    runs = written(runs, "suffix-runs")
    buckets = runs.where("bytes IS NOT NULL").select("key1", "offset", "bytes", "row", "first", "kind")
    buckets = buckets.repartitionByRange("key1").sortWithinPartitions("key1")
    found = buckets.mapInArrow(lambda b: _bucket_rows(b, length), "row long, first long, last long")

    hashes = runs.where("bytes IS NULL").select("high", "low", "row", "first", "kind")
    twice = hashes.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1")
    twice = written(twice, "suffix-hashes").select("high", "low")
    counted = hashes.where(f"kind = {_OPEN}").join(twice, ["high", "low"], "left_semi")
    found = found.union(counted.select("row", "first", F.col("first").alias("last")))

    place, high, low = F.shiftright("pack", 16), F.shiftright("pack", 8).bitwiseAND(255), F.col("pack").bitwiseAND(255)
    settled = kinds.where(f"kind IN ({_SETTLED}, {_SHOWN})").select(
        "row", (place - high).alias("first"), (place - low).alias("last")
    )
    return found.union(settled)


def _numbered(docs, id_col, text_col):
    """doc_id, text and `row`: the id itself if it is a long without nulls and repeats, else a number of its own."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
        if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
            return docs.withColumn("row", F.col("doc_id").cast("long"))
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "suffix-rows")


@contextmanager
def _small_batches(spark, size=_BATCH_BYTES):
    """What starts inside sends batches of about `size` bytes to Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(size))
        yield
    finally:
        spark.conf.set(name, before)


def removed_spans(first, last, length=LENGTH):
    """Starts and ends of the maximal runs of bytes covered by windows that start in the ranges (first, last)."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])[: start.size])
    return start[new], end[np.append(new[1:], start.size)[: new.size] - 1]


def _cut(batches, length, with_bytes):
    """Figures, digest and, if asked for, bytes of what is left of each text without its ranges."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        out = [[], [], [], [], []]
        bounds, (first, last) = _listed(batch.column("ranges"), ("first", "last"))
        for i, data in enumerate(text_bytes(batch.column("text"))):
            data = memoryview(data or b"")
            own = slice(bounds[i], bounds[i + 1])
            starts, ends = removed_spans(first[own], last[own], length)
            left = zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)
            kept = [data[a:b] for a, b in left]
            digest = hashlib.sha256()
            for part in kept:
                digest.update(part)
            values = len(data), int((ends - starts).sum()), starts.size, digest.hexdigest()
            for column, value in zip(out, (*values, b"".join(kept) if with_bytes else None), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def dedup_substrings(docs, id_col="doc_id", text_col="text", length=LENGTH, anchor=ANCHOR, bucket_runs=BUCKET_RUNS,
                     with_bytes=False):
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and `kept` (the bytes left) if asked for.

    Texts are judged as UTF-8 bytes, null as empty; texts shorter than `length` stay as they are. Strings are judged on
    the input, copies of a row included, so of equal texts nothing stays. Other columns are not read.

    The rows are written before they are returned: while that runs, a setting of the session limits the bytes that go to
    Python at a time, and then gets its value back.
    """
    docs = _numbered(docs, id_col, text_col)
    with _small_batches(docs.sparkSession):
        ranges = repeated_windows(docs, length, anchor, bucket_runs)
        ranges = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # of one document
        rows = docs.join(ranges, "row", "left").select("doc_id", "text", "ranges")

        kind = rows.schema["doc_id"].dataType.simpleString()
        done = rows.mapInArrow(
            lambda b: _cut(b, length, with_bytes),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
        )
        return written(done if with_bytes else done.drop("kept"), "suffix-left")
