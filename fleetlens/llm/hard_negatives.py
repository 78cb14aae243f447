"""Hard negatives by slot-decomposed selection.

A positive of an anchor opens a window of scores for its negatives. The upper limits of the windows of an anchor cut the
scores into disjoint slots, so that a row falls into one slot whatever the number of windows. Each task scores its rows
against a block of anchors and keeps the best k rows per anchor and slot; what the tasks keep is combined. A window, from
its upper limit down, is then a suffix of the slots: merging the slots from there on in descending order gives its best k.

Rows stay where they are. Anchors come to them in blocks of bounded size, one pass over the rows for the positives of a
block and one for the negatives.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.llm.common import numbered, written
from fleetlens.session import run_dir

POSITIVES = 5
NEGATIVES = 10
# percent of the score of the positive between which a negative is hard, but no copy
LOW, HIGH = 30, 90
SCALE = 256
# a block of anchors is broadcast, so its vectors (8 bytes a component) are bounded
BLOCK_BYTES = 16 << 20
# rows that one task works on at most; fewer tasks keep fewer rows per anchor and slot
TASK_ROWS = 1 << 20

_TILE_ROWS, _TILE_ANCHORS = 2048, 1024
_PENDING = 1 << 20
_NO_ID = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min
_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
           "positive_rank int")


def usable_rows(rows, anchors, id_col="vec_id", vector_col="embedding", label_col="label"):
    """uid, id, label (text), vector, anchor (boolean) of the rows that take part."""
    own = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    finite = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('infinity'))"
    return own.where("label IS NOT NULL AND vector IS NOT NULL").where(finite).withColumn("uid", F.monotonically_increasing_id())


def _matrix(lists, dimensions, scale):
    """Whole numbers of an Arrow column of vectors as float64; missing components are 0."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.all(sizes == dimensions):
        return values.reshape(-1, dimensions)
    out = np.zeros((len(lists), dimensions))
    row = np.repeat(np.arange(sizes.size), sizes)
    out[row, np.arange(values.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(rows, anchors):
    """Inner products as int64, exact; what passes 64 bits counts as the largest or smallest number."""
    most = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * rows.shape[1]
    if most < 2.0**53:
        return (rows @ anchors.T).astype(np.int64)  # all partial sums are whole numbers that float64 holds
    if most < 2.0**62:
        return rows.astype(np.int64) @ anchors.T.astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(rows) @ whole(anchors).T, _LEAST, _NO_ID).astype(np.int64)


class Best:
    """The best `k` rows (score descending, id, uid) of each group number; takes candidates in any order."""

    def __init__(self, groups, k):
        self.k, self.floor = k, np.full(groups, _LEAST)
        self.parts, self.size, self.kept = [], 0, 0

    def add(self, group, score, ids, uids):
        if group.size:
            self.parts.append((group, score, ids, uids))
            self.size += group.size
            if self.size > _PENDING + 2 * self.kept:
                self.rows()

    def rows(self):
        """(group, score, id, uid) of what is kept; raises the floor of the groups that are full."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        group, score, ids, uids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((uids, ids, ~score, group))  # ~score descends where score ascends
        group, score, ids, uids = group[order], score[order], ids[order], uids[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(group.size) - np.repeat(start, np.diff(np.append(start, group.size)))
        last = place == self.k - 1
        self.floor[group[last]] = score[last]
        keep = place < self.k
        out = group[keep], score[keep], ids[keep], uids[keep]
        self.parts, self.size, self.kept = [out], out[0].size, out[0].size
        return out


class _Block:
    """A block of anchors: uids, labels and vectors, then also the limits of their positives."""

    def __init__(self, rows, dimensions, scale):
        self.uids = np.array([r["uid"] for r in rows], np.int64)
        names = sorted({r["label"] for r in rows})
        self.codes = {name: i for i, name in enumerate(names)}
        self.labels = np.array([self.codes[r["label"]] for r in rows], np.int64)
        self.vectors = _matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), dimensions, scale)
        self.dimensions, self.scale = dimensions, scale

    def limit(self, rows, positives, low, high):
        """`upper` and `least` scores per anchor and positive, best positive first; a missing one has an empty window."""
        at = {uid: i for i, uid in enumerate(self.uids.tolist())}
        self.upper = np.full((self.uids.size, positives), _LEAST)
        self.least = np.full((self.uids.size, positives), _NO_ID)
        for r in rows:
            place = at[r["anchor_uid"]], r["positive_rank"] - 1
            self.upper[place] = r["positive_score"] * high // 100
            self.least[place] = -(-r["positive_score"] * low // 100)

    def tiles(self, batches):
        """(ids, uids, label codes, vectors) of the rows of a task, some thousand at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE_ROWS):
                part = batch.slice(at, _TILE_ROWS)
                found = part.column("label").dictionary_encode()
                code = np.array([self.codes.get(x, -1) for x in found.dictionary.to_pylist()], np.int64)
                ids = part.column("id").fill_null(_NO_ID).to_numpy()
                yield (ids, part.column("uid").to_numpy(), code[found.indices.to_numpy()],
                       _matrix(part.column("vector"), self.dimensions, self.scale))


def _positives(batches, block, k):
    """The best k rows of an anchor's label among the rows of a task, per anchor."""
    best = Best(block.uids.size, k)
    for ids, uids, codes, vectors in block.tiles(batches):
        for code in np.unique(codes[codes >= 0]):
            own = np.flatnonzero(codes == code)
            group = np.flatnonzero(block.labels == code)
            for at in range(0, group.size, _TILE_ANCHORS):
                some = group[at : at + _TILE_ANCHORS]
                scores = products(vectors[own], block.vectors[some])
                row, col = np.nonzero((scores >= best.floor[some]) & (uids[own][:, None] != block.uids[some]))
                best.add(some[col], scores[row, col], ids[own[row]], uids[own[row]])
    group, score, ids, uids = best.rows()
    yield _batch(["anchor_uid", "score", "id", "uid"], block.uids[group], score, ids, uids)


def _slots(batches, block, k):
    """The best k rows of other labels among the rows of a task, per anchor and slot."""
    slots = block.upper.shape[1]
    below = np.column_stack([block.upper[:, 1:], np.full(block.uids.size, _LEAST)])
    best = Best(block.uids.size * slots, k)
    for ids, uids, codes, vectors in block.tiles(batches):
        for at in range(0, block.uids.size, _TILE_ANCHORS):
            own = slice(at, at + _TILE_ANCHORS)
            scores = products(vectors, block.vectors[own])
            other = codes[:, None] != block.labels[own]
            floor = best.floor.reshape(-1, slots)
            for slot in range(slots):
                fits = other & (scores <= block.upper[own, slot]) & (scores > below[own, slot])
                fits &= scores >= np.maximum(block.least[own, slot], floor[own, slot])
                row, col = np.nonzero(fits)
                best.add((at + col) * slots + slot, scores[row, col], ids[row], uids[row])
    group, score, ids, uids = best.rows()
    yield _batch(["anchor_uid", "slot", "score", "id", "uid"], block.uids[group // slots], group % slots + 1, score, ids, uids)


def _batch(names, *columns):
    arrays = [pa.array(c, mask=c == _NO_ID if n == "id" else None) for n, c in zip(names, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _first(df, by, k, name):
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def _mined(spark, rows, some, settings):
    """Hard negatives of one block of anchors (a table of bounded size)."""
    positives, negatives, low, high, scale, dimensions = settings
    block = _Block(some.collect(), dimensions, scale)
    sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES
    near = rows.mapInArrow(
        lambda batches: _positives(batches, sent.value, positives), "anchor_uid long, score long, id long, uid long")
    near = _first(near, ["anchor_uid"], positives, "positive_rank").select(
        "anchor_uid", "positive_rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = written(near, "positives")
    block.limit(near.collect(), positives, low, high)  # at most `positives` rows for each anchor of the block
    limits = spark.sparkContext.broadcast(block)
    kept = rows.mapInArrow(
        lambda batches: _slots(batches, limits.value, negatives), "anchor_uid long, slot long, score long, id long, uid long")
    kept = _first(kept, ["anchor_uid", "slot"], negatives, "_place").drop("_place")
    # the slots from that of the positive on, in descending order
    window = (F.col("slot") >= F.col("positive_rank")) & (F.col("score") * 100 >= F.col("positive_score") * low)
    window &= F.col("score") * 100 <= F.col("positive_score") * high
    found = _first(kept.join(near, "anchor_uid").where(window), ["anchor_uid", "positive_rank"], negatives, "rank")
    return found.join(some.select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id")), "anchor_uid").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), "positive_rank",
    )


def mine_hard_negatives(rows, anchors, id_col="vec_id", vector_col="embedding", label_col="label", positives=POSITIVES,
                        negatives=NEGATIVES, low=LOW, high=HIGH, scale=SCALE, block_bytes=BLOCK_BYTES, task_rows=TASK_ROWS):
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, positive_rank.

    Components x become floor(scale * x), a score is an inner product of those. `anchors` is a condition that tells the
    anchors among the rows. The positives of an anchor are its first `positives` other rows of the same label, its
    negatives for one of them the first `negatives` rows of other labels whose score is `low` to `high` percent of the
    positive's; larger scores come first, ties by id (null last), then by row.

    Rows with a null label, a null vector, or a null, NaN or infinite component take no part. Shorter vectors are filled up
    with zeros. Rows that repeat an id are rows of their own. A null id (as which 2**63 - 1 counts too) comes after others.
    An anchor without a positive, and a positive without a negative, gives no row. Other columns are not read.
    """
    spark = rows.sparkSession
    if not (positives > 0 and negatives > 0 and scale > 0):
        raise ValueError("positives, negatives and scale must be positive")
    own = written(usable_rows(rows, anchors, id_col, vector_col, label_col), "vectors")
    figures = own.agg(
        F.count("*").alias("rows"), F.max(F.size("vector")).alias("dimensions"), F.count_if("anchor").alias("anchors")
    ).first()
    dimensions = max(1, figures["dimensions"] or 1)
    asked = numbered(own.where("anchor").drop("anchor"), ["uid"], "anchors")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-figures["rows"] // task_rows))
    own = own.select("uid", "id", "label", "vector").coalesce(tasks)
    size = max(1, block_bytes // (8 * dimensions))
    path, settings = run_dir(spark, "hard-negatives"), (positives, negatives, low, high, scale, dimensions)
    spark.createDataFrame([], _RESULT).write.parquet(f"{path}/block=-1")
    for number in range(-(-figures["anchors"] // size)):
        some = asked.where((F.col("number") >= number * size) & (F.col("number") < (number + 1) * size)).drop("number")
        _mined(spark, own, some, settings).write.parquet(f"{path}/block={number}")
    return spark.read.schema(_RESULT + ", block int").parquet(path).drop("block")
