"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models over the words of a text and their beginnings. Each model also gets the
probabilities of the categories before it; for training these come from models that haven't seen the row (out of fold).
"""

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm.common import ALNUM, pieces, text_bytes

#: columns of the labels, in the order of the chain; the last one decides
CATEGORIES = ("quality", "toxic")
# labelled rows that the models are fitted on, about; a larger table gives a sample by the hash of the id
TRAIN_ROWS = 8000
FOLDS = 4
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes of a word that count as a feature too, for words of open vocabulary
# a bucket gets a weight if it is in so many rows of the sample and its chi-square with the category is so large; the rest
# of the words could only learn the noise of the labels by heart
LEAST_ROWS, LEAST_CHI2 = 8, 20.0
ROUNDS, RATE, DECAY = 120, 0.2, 2e-4
THRESHOLD = 0.5


def word_buckets(data):
    """Sorted distinct hash buckets of the words of a text in UTF-8 and of how they begin."""
    found = np.zeros(0, np.int64)
    for words in pieces(data, ALNUM):
        own = set(words)
        own.update([w[:n] + b"-" for n in PREFIXES for w in own if len(w) > n])
        own = np.fromiter((crc32(w) for w in own), np.int64, len(own)) % BUCKETS
        found = np.unique(own) if not found.size else np.union1d(found, own)
    return found


class Linear:
    """Logistic regression over bucket sets and some numbers, by full-batch gradients with Adam steps."""

    def __init__(self, weights, extra, bias):
        self.weights, self.extra, self.bias = weights, extra, bias

    @classmethod
    def fit(cls, columns, lengths, extras, target):
        """`columns`: the buckets of all rows, one row after the other; `extras`: rows of numbers."""
        row = np.repeat(np.arange(lengths.size), lengths)
        used = np.flatnonzero(_telling(columns, row, target))
        place = np.full(BUCKETS, -1)
        place[used] = np.arange(used.size)
        column = place[columns]
        row, column = row[column >= 0], column[column >= 0]
        n, d, k = lengths.size, used.size, extras.shape[1]
        mean = min(max(target.mean() if n else 0.0, 1e-3), 1 - 1e-3)
        theta = np.zeros(d + k + 1)
        theta[-1] = np.log(mean / (1 - mean))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, ROUNDS + 1 if n else 0):
            margin = np.bincount(row, theta[column], n) + extras @ theta[d : d + k] + theta[-1]
            wrong = (_sigmoid(margin) - target) / n
            gradient = np.concatenate([np.bincount(column, wrong[row], d), extras.T @ wrong, [wrong.sum()]])
            gradient[:-1] += DECAY * theta[:-1]
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weights = np.zeros(BUCKETS)
        weights[used] = theta[:d]
        return cls(weights, theta[d : d + k], theta[-1])

    def predict(self, columns, lengths, extras):
        row = np.repeat(np.arange(lengths.size), lengths)
        return _sigmoid(np.bincount(row, self.weights[columns], lengths.size) + extras @ self.extra + self.bias)


def _telling(columns, row, target):
    """Which buckets say enough about the target."""
    n, often = max(1, target.size), np.bincount(columns, minlength=BUCKETS)
    surplus = np.bincount(columns, target[row], BUCKETS) - often * target.sum() / n
    spread = often * (1 - often / n) * target.sum() / n * (1 - target.sum() / n)
    return (often >= LEAST_ROWS) & (surplus**2 > LEAST_CHI2 * spread)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_chain(columns, lengths, targets, fold):
    """One model per column of `targets` (1, 0 or NaN for unknown); `fold` is the fold of each row."""
    starts = np.cumsum(lengths) - lengths

    def rows(at):
        size = lengths[at]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return columns[np.repeat(starts[at], size) + inner], size

    models, extras = [], np.zeros((lengths.size, 0))
    for target in targets.T:
        known = ~np.isnan(target)
        outside = np.full(lengths.size, 0.5)
        for f in range(FOLDS):
            train, test = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
            model = Linear.fit(*rows(train), extras[train], target[train])
            outside[test] = model.predict(*rows(test), extras[test])
        train = np.flatnonzero(known)
        models.append(Linear.fit(*rows(train), extras[train], target[train]))
        extras = np.column_stack([extras, outside])
    return models


def learn(docs, labels, categories=CATEGORIES, id_col="doc_id", text_col="text", label_id_col="doc_id",
          train_rows=TRAIN_ROWS):
    """The models of the chain as (weights, extra, bias), fitted in one task on about `train_rows` labelled rows.

    The sample is taken by the hash of the id on both sides before they are joined; a label of null is left out of the
    model of its category; null texts have no words.
    """
    count = labels.count()
    share = min(1.0, train_rows / max(1, count))

    def sampled(column):
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))

    rows = docs.where(sampled(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def hashed(batches):
        for batch in batches:
            found = [word_buckets(x or b"") for x in text_bytes(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(found, pa.list_(pa.int64()))], names=["_id", "buckets"]
            )

    kind = rows.schema["_id"].dataType.simpleString()
    rows = rows.mapInArrow(hashed, f"_id {kind}, buckets array<long>")
    own = labels.where(sampled(F.col(label_id_col))).select(
        F.col(label_id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in categories]).alias("target")
    )
    fold = F.pmod(F.xxhash64(F.concat_ws("#", F.lit("fold"), F.col("_id").cast("string"))), F.lit(FOLDS))
    # a repeated id may give more rows than the sample has ids; the bound holds all the same
    rows = rows.join(own, "_id").select(fold.alias("fold"), "buckets", "target").limit(2 * train_rows)
    # so many numbers that no sum depends on the order in which rows arrive
    rows = rows.orderBy(F.xxhash64("buckets", "target"))

    def fitted(batches):
        folds, buckets, targets = [], [], []
        for batch in batches:
            folds.append(batch.column("fold").to_numpy())
            buckets.extend(x.values.to_numpy() for x in batch.column("buckets"))
            targets.extend([np.nan if v is None else v for v in x] for x in batch.column("target").to_pylist())
        if buckets:
            columns = np.concatenate(buckets)
            lengths = np.array([x.size for x in buckets])
            models = fit_chain(columns, lengths, np.array(targets, float), np.concatenate(folds))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(models))), pa.array([m.weights for m in models], pa.list_(pa.float64())),
                 pa.array([m.extra for m in models], pa.list_(pa.float64())), pa.array([float(m.bias) for m in models])],
                names=["place", "weights", "extra", "bias"],
            )

    models = rows.coalesce(1).mapInArrow(fitted, "place long, weights array<double>, extra array<double>, bias double")
    found = sorted(models.collect(), key=lambda r: r["place"])
    return [(np.array(r["weights"]), np.array(r["extra"]), r["bias"]) for r in found]


def toxicity(docs, labels, categories=CATEGORIES, id_col="doc_id", text_col="text", label_id_col="doc_id",
             train_rows=TRAIN_ROWS, threshold=THRESHOLD):
    """One row per document: doc_id, p_<category> for each category, toxic (the last probability is over the threshold).

    Without labelled rows all probabilities are 0.5 and nothing is toxic. Null texts have no words. Repeated rows give
    repeated rows; other columns are not read.
    """
    models = learn(docs, labels, categories, id_col, text_col, label_id_col, train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(models)  # a fixed number of weights per category
    names = [f"p_{c}" for c in categories]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def predicted(batches):
        chain = [Linear(*m) for m in sent.value]
        for batch in batches:
            found = []
            for data in text_bytes(batch.column("text")):
                buckets, so_far = word_buckets(data or b""), []
                for model in chain:
                    margin = model.weights[buckets].sum() + float(np.dot(model.extra, so_far)) + model.bias
                    so_far.append(float(_sigmoid(margin)))
                found.append(so_far or [0.5] * len(names))
            columns = [pa.array(list(c), pa.float64()) for c in zip(*found, strict=True)] or [
                pa.array([], pa.float64()) for _ in names
            ]
            toxic = pa.array([x[-1] > threshold for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, toxic], names=["doc_id", *names, "toxic"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predicted, f"doc_id {kind}, {', '.join(f'{n} double' for n in names)}, toxic boolean")
