"""Substring dedup by MinHash banding of paragraphs.

Paragraphs (lines) of five-word shingles get a MinHash signature whose bands are tuned for high recall. Paragraphs that
collide in a band are compared by the exact Jaccard coefficient of their shingles; the components of the links are the
classes. In each class the first occurrence stays, the others are removed.

A bucket is not expanded into pairs. First each paragraph of a bucket is compared with the first one. Only where that
leaves a bucket in several components, the paragraphs of different components are compared too, in blocks of bounded
size. Equal paragraphs count as one up to the classes.

Passages inside longer lines, or broken over lines in another way, are found by windows of 20 words of the whole text, at
places that the words choose themselves: the place with the smallest hash of any 13 places that follow each other. Two
texts that share 32 words in a row choose a common place in them, so their windows there are equal.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, components, pieces, text_bytes, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_BANDS = 12
# default for the fewest words of a line that is compared; 1 compares every line, as op4 does
MIN_WORDS = 20
BLOCK_ROWS = 1024
SEED = 5
# words of a passage window, and places of which at least one gets a window
PASSAGE_WORDS = 20
PLACES = 13

_SEEN = 1 << 16
_BATCH_SHINGLES = 1 << 17
_PASSAGE_PIECE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(similarity=SIMILARITY, recall=RECALL, most=MOST_BANDS):
    """(bands, rows) with as many rows per band as `most` bands allow at that recall for pairs of that similarity."""
    best = None
    for rows in range(1, 33):
        bands = np.log(1 - recall) / np.log1p(-(similarity**rows)) if similarity < 1 else 1
        if bands <= most:
            best = int(np.ceil(bands)), rows
    if best is None:
        raise ValueError("the recall needs more bands")
    return best


def paragraphs(data):
    """Words (A-Z lower-cased) of each line of a text in UTF-8 that has any."""
    at = 0
    while at <= len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        words = [w for part in pieces(data[at:end], LOWER) for w in part]
        if words:
            yield words
        at = end + 1


def word_hashes(words):
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _rolled(hashes, at, size):
    """Hash of the `size` words from each place in the array `at` on."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = (out ^ hashes[at + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(words, size=SHINGLE_WORDS):
    """Hashes of the word shingles (uint64, sorted, distinct); fewer words give one shingle."""
    return _shingles(word_hashes(words), size)


def _shingles(hashes, size=SHINGLE_WORDS):
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def passages(hashes, words=PASSAGE_WORDS, places=PLACES):
    """(places, keys as int64, again) of the windows of a text given by its word hashes, in order.

    `again` tells the windows whose words stand in the text once more without overlap.
    """
    n = len(hashes) - words + 1  # places where a window fits
    chosen = []
    for start in range(0, n, _PASSAGE_PIECE):
        end = min(n, start + _PASSAGE_PIECE + places - 1)
        order = _rolled(hashes, np.arange(start, end), SHINGLE_WORDS)
        if order.size >= places:
            views = np.lib.stride_tricks.sliding_window_view(order, places)
            chosen.append(np.unique(start + np.arange(len(views)) + views.argmin(1)))
        elif start == 0:
            chosen.append(np.array([order.argmin()]))
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.unique(np.concatenate(chosen))
    keys = _rolled(hashes, at, words).view(np.int64)
    _, group = np.unique(keys, return_inverse=True)
    first, last = np.full(group.max() + 1, n), np.zeros(group.max() + 1, np.int64)
    np.minimum.at(first, group, at)
    np.maximum.at(last, group, at)
    return at, keys, (last - first >= words)[group]


class Signer:
    """Band hashes of many shingle sets at a time."""

    def __init__(self, bands, rows, seed=SEED):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64)

    def sign(self, hashes, starts, ends):
        """int64 array, one row of band hashes per range of shingle hashes; no range is empty."""
        hashes = np.append(hashes, np.uint64(0))  # so that an end may be the length
        cuts = np.column_stack([starts, ends]).ravel()
        out = np.empty((len(starts), self.factors.shape[0]), np.uint64)
        for band, (factors, terms) in enumerate(zip(self.factors, self.terms, strict=True)):
            key = np.full(len(starts), band + 1, np.uint64)
            for factor, term in zip(factors, terms, strict=True):
                # every second value is that of what lies between two ranges
                key = (key ^ np.minimum.reduceat(hashes * factor + term, cuts)[::2]) * _MIX
                key ^= key >> np.uint64(31)
            out[:, band] = key
        return out.view(np.int64)


_PARTS = "array<struct<no: int, words: long, key: long, bands: array<long>>>"
_PARTS_ARROW = pa.list_(
    pa.struct([("no", pa.int32()), ("words", pa.int64()), ("key", pa.int64()), ("bands", pa.list_(pa.int64()))])
)


_WINDOWS = "array<struct<place: long, key: long, again: boolean>>"
_WINDOWS_ARROW = pa.list_(pa.struct([("place", pa.int64()), ("key", pa.int64()), ("again", pa.bool_())]))


def _windows_column(found):
    """Arrow column of the windows of each document of a batch."""
    offsets = np.cumsum([0, *(len(at) for at, _, _ in found)])
    joined = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
    fields = [pa.array(x, f.type) for x, f in zip(joined, _WINDOWS_ARROW.value_type, strict=True)]
    values = pa.StructArray.from_arrays(fields, fields=list(_WINDOWS_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(_WINDOWS_ARROW)


def paragraph_key(words):
    """64-bit hash of a paragraph, signed."""
    value = xxhash.xxh3_64_intdigest(b" ".join(words))
    return value - (1 << 64) if value >> 63 else value


class _Parts:
    """Columns of the documents of a batch: paragraphs, words, lines that are compared, windows."""

    def __init__(self, signer, seen, min_words, with_windows):
        self.signer, self.seen, self.min_words, self.with_windows = signer, seen, min_words, with_windows
        self.counts, self.totals, self.windows, self.sizes = [], [], [], []
        self.no, self.words, self.key, self.signed, self.bands = [], [], [], [], []
        self.hashes, self.starts, self.ends, self.waiting = [], [], [], 0

    def add(self, data):
        n, own, compared = 0, [], len(self.no)
        for words in paragraphs(data or b""):
            hashes = word_hashes(words)
            own.append(hashes)
            n += 1
            if len(words) < self.min_words:
                continue
            key = paragraph_key(words)
            sign = len(words) >= SHINGLE_WORDS and key not in self.seen
            self.no.append(n - 1)
            self.words.append(len(words))
            self.key.append(key)
            self.signed.append(sign)
            if sign:
                if len(self.seen) >= _SEEN:
                    self.seen.clear()
                self.seen.add(key)
                self.starts.append(self.waiting)
                self.ends.append(self.waiting + len(words) - SHINGLE_WORDS + 1)
                self.hashes.append(hashes)
                self.waiting += len(words)
                if self.waiting > _BATCH_SHINGLES:
                    self._sign()
        hashes = np.concatenate(own) if own else np.zeros(0, np.uint64)
        self.counts.append(n)
        self.totals.append(hashes.size)
        self.windows.append(passages(hashes if self.with_windows else hashes[:0]))
        self.sizes.append(len(self.no) - compared)

    def _sign(self):
        if self.starts:
            hashes = np.concatenate(self.hashes)
            rolled = _rolled(hashes, np.arange(hashes.size - SHINGLE_WORDS + 1), SHINGLE_WORDS)
            self.bands.append(self.signer.sign(rolled, self.starts, self.ends))
        self.hashes, self.starts, self.ends, self.waiting = [], [], [], 0

    def columns(self):
        self._sign()
        width = self.signer.factors.shape[0]
        signed = np.array(self.signed, bool)
        ends = np.concatenate([[0], np.cumsum(signed * width)]).astype(np.int32)
        values = np.concatenate(self.bands).ravel() if self.bands else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()), mask=pa.array(~signed))
        fields = [pa.array(self.no, pa.int32()), pa.array(self.words, pa.int64()), pa.array(self.key, pa.int64()), bands]
        parts = pa.StructArray.from_arrays(fields, names=["no", "words", "key", "bands"])
        ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)
        parts = pa.ListArray.from_arrays(pa.array(ends), parts).cast(_PARTS_ARROW)
        return [pa.array(self.counts, pa.int64()), pa.array(self.totals, pa.int64()), parts, _windows_column(self.windows)]


def _signed_parts(batches, bands, rows, min_words, with_windows=True):
    """Per document the number of paragraphs and words, number, words, key and bands of the lines that are compared, and
    the windows of the text.

    Bands are left out where the task has met the paragraph before, so that a frequent one comes a few times per task,
    and for lines of less than a shingle, which are near only to equal ones, and these share the key.
    """
    signer, seen = Signer(bands, rows), set()
    for batch in batches:
        parts = _Parts(signer, seen, min_words, with_windows)
        for data in text_bytes(batch.column("text")):
            parts.add(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("doc_id"), batch.column("at"), *parts.columns()],
            names=["uid", "doc_id", "at", "n_paragraphs", "n_words", "parts", "windows"],
        )


def _stars(batches):
    """band, a, b: the first key of each bucket with each other one; the rows are sorted by band and key."""
    band = first = last = None
    for batch in batches:
        bands, keys = batch.column("band").to_numpy(), batch.column("key").to_numpy()
        if not bands.size:
            continue
        new = np.append(bands[0] != band, bands[1:] != bands[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(bands.size), -1))
        center = np.where(start >= 0, keys[start], first if first is not None else 0)
        before = np.append(last if last is not None else 0, keys[:-1])
        other = ~new & (keys != before)
        band, first, last = bands[-1], center[-1], keys[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bands[other]), pa.array(center[other]), pa.array(keys[other])], names=["band", "a", "b"]
        )


def _sets(batches):
    """key and shingles of the paragraphs of a text that are asked for."""
    for batch in batches:
        keys, found = [], []
        for data, asked in zip(text_bytes(batch.column("text")), batch.column("keys").to_pylist(), strict=True):
            asked = set(asked)
            for words in paragraphs(data or b""):
                if not asked:
                    break
                key = paragraph_key(words)
                if key in asked:
                    asked.remove(key)
                    keys.append(key)
                    found.append(shingles(words).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "shingles"]
        )


def _block_links(batches, similarity):
    """Links between paragraphs of different components within each (band, i, j), whose rows follow each other."""
    group, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = row["band"], row["i"], row["j"]
            if own != group:
                yield _compared(rows, similarity)
                group, rows = own, []
            rows.append(row)
    yield _compared(rows, similarity)


def _compared(rows, similarity):
    a, b, posts, sizes = [], [], {}, []
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for r, row in enumerate(rows):
        own, common = row["shingles"], {}
        sizes.append(len(own))
        for s in own:
            for other in posts.setdefault(s, []):
                common[other] = common.get(other, 0) + 1
            posts[s].append(r)
        for other, n in common.items():
            mine, its = root(row["component"]), root(rows[other]["component"])
            if mine != its and n >= similarity * (sizes[r] + sizes[other] - n):
                parent[mine] = its
                a.append(row["key"])
                b.append(rows[other]["key"])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def star_links(docs, parts, similarity=SIMILARITY):
    """(stars, sets, links): the first key of each band with each other one, the shingles of these keys, and the links a, b
    of those pairs that are near. `docs` and `parts` are those of paragraph_links."""
    banded = parts.where("bands IS NOT NULL").select("key", F.explode("bands").alias("band"))
    stars = banded.repartition("band").sortWithinPartitions("band", "key").mapInArrow(_stars, "band long, a long, b long")
    stars = written(stars, "paragraph-stars")
    asked = stars.select(F.col("a").alias("key")).union(stars.select("b")).distinct()
    # each paragraph is read from one text, which its hash and id tell, whatever ids are null or repeated
    at = parts.join(asked, "key", "left_semi").groupBy("key").agg(F.min(F.struct("at", "doc_id")).alias("where"))
    at = at.groupBy(F.col("where.at").alias("_at"), F.col("where.doc_id").alias("_id")).agg(F.collect_list("key").alias("keys"))
    here = (F.xxhash64("text") == at["_at"]) & docs["doc_id"].eqNullSafe(at["_id"])
    sets = docs.join(at, here).select("text", "keys").mapInArrow(_sets, "key long, shingles array<long>")
    # a repeated document id may give a paragraph twice
    sets = written(sets.dropDuplicates(["key"]), "paragraph-sets")

    pairs = stars.select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    near = common >= similarity * (F.size("x") + F.size("y") - common)
    links = written(both.where(near).select("a", "b"), "paragraph-links")

    return stars, sets, links


def paragraph_links(docs, parts, similarity=SIMILARITY, block_rows=BLOCK_ROWS):
    """Links a, b between the keys of different paragraphs, enough for the components of all verified pairs.

    `docs` has doc_id and text; `parts` the rows doc_id, at (hash of the text), no, key, bands.
    """
    stars, sets, links = star_links(docs, parts, similarity)
    roots = components(links, "paragraphs")
    members = stars.select("band", F.col("b").alias("key")).union(stars.select("band", "a")).distinct()
    members = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "key", F.coalesce("root", "key").alias("component")
    )
    members = written(members, "paragraph-members")
    split = members.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")
    )
    split = split.where("least <> most").select("band", F.ceil(F.col("n") / block_rows).alias("blocks"))
    rows = members.join(written(split, "paragraph-split"), "band").join(sets, "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    rows = rows.select("*", block.alias("own"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    rows = rows.select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "component", "shingles"
    )
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return links.union(rows.mapInArrow(lambda batches: _block_links(batches, similarity), "a long, b long"))


def paragraph_classes(docs, id_col="doc_id", text_col="text", similarity=SIMILARITY, recall=RECALL, min_words=MIN_WORDS,
                      block_rows=BLOCK_ROWS):
    """(documents, parts): documents have uid, doc_id, n_paragraphs, n_words, windows; parts are the repeated paragraphs, one row
    each with uid, doc_id, no, words, class_id, class_rows, first_doc_id and `stays`, which is true for the first of each class."""
    bands, rows = tune_bands(similarity, recall)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    kind = own.schema["doc_id"].dataType.simpleString()
    table = own.withColumns({"uid": F.monotonically_increasing_id(), "at": F.xxhash64("text")}).mapInArrow(
        lambda batches: _signed_parts(batches, bands, rows, min_words),
        f"uid long, doc_id {kind}, at long, n_paragraphs long, n_words long, parts {_PARTS}, windows {_WINDOWS}",
    )
    table = written(table, "paragraph-parts")
    parts = table.select("uid", "doc_id", "at", F.explode("parts").alias("part")).select("uid", "doc_id", "at", "part.*")
    links = paragraph_links(own, parts.select("doc_id", "at", "no", "key", "bands"), similarity, block_rows)
    roots = components(links, "paragraph-classes").select(F.col("node").alias("key"), "root")
    parts = parts.drop("bands", "at").join(roots, "key", "left").withColumn("class_id", F.coalesce("root", "key")).drop("root")
    parts = written(parts, "paragraph-keys")
    classes = parts.groupBy("class_id").agg(
        F.count("*").alias("class_rows"), F.min(F.struct("doc_id", "no", "uid")).alias("first")
    )
    classes = written(classes.where("class_rows > 1"), "paragraph-classes")
    stays = (F.col("first.uid") == F.col("uid")) & (F.col("first.no") == F.col("no"))
    parts = parts.join(classes, "class_id").select(
        "uid", "doc_id", "no", "words", "class_id", "class_rows", F.col("first.doc_id").alias("first_doc_id"), stays.alias("stays")
    )
    return table.drop("parts"), parts


def shared_passages(table):
    """One row per document with repeated windows: uid, n_passage_words (words that stand in such a window),
    passage_doc_ids (the first document of each), passage_ids (keys of the windows)."""
    rows = table.select("uid", "doc_id", F.explode("windows").alias("window")).select("uid", "doc_id", "window.*")
    found = rows.groupBy("key").agg(
        F.min("uid").alias("least"), F.max("uid").alias("most"), F.max(F.col("again").cast("int")).alias("again"),
        F.min(F.struct("doc_id")).alias("first"),
    )
    found = written(found.where("least <> most OR again = 1").select("key", "first"), "passage-keys")
    # nothing is grouped by key after this join, so adaptive execution splits a key with very many rows
    rows = rows.select("uid", "place", "key").join(found, "key")
    own = rows.groupBy("uid").agg(  # of one document
        F.sort_array(F.collect_list("place")).alias("places"), F.collect_set("first.doc_id").alias("passage_doc_ids"),
        F.collect_set("key").alias("passage_ids"),
    )
    n = F.expr(
        f"aggregate(places, struct(0L AS n, 0L AS end), (s, p) -> struct(s.n + p + {PASSAGE_WORDS} - greatest(s.end, p) AS n,"
        f" p + {PASSAGE_WORDS} AS end), s -> s.n)"
    )
    return own.select("uid", n.alias("n_passage_words"), "passage_doc_ids", "passage_ids")


def repeated_paragraphs(docs, id_col="doc_id", text_col="text", similarity=SIMILARITY, recall=RECALL, min_words=MIN_WORDS,
                        block_rows=BLOCK_ROWS):
    """One row per document: doc_id, n_paragraphs, n_repeated, n_removed, repeated, first_doc_ids, class_ids, n_words,
    n_repeated_words, n_passage_words.

    `n_repeated` counts the paragraphs of at least `min_words` words that stand elsewhere too, `n_repeated_words` their
    words, which against `n_words` (of the whole text) tells copied text from a few common short lines; `n_removed` those
    of them that aren't the first by (doc_id, place). `n_passage_words` counts the words in windows that stand elsewhere
    too, wherever lines end; every 32 words in a row that two documents share have such a window. `repeated` tells whether
    there is a repeated paragraph or window. `first_doc_ids` are the documents of the first ones, `class_ids` the classes
    (of a window its key). Null and empty texts have no paragraphs. Repeated rows are documents of their own; a null id
    comes first and is left out of `first_doc_ids`. Other columns are not read.
    """
    table, parts = paragraph_classes(docs, id_col, text_col, similarity, recall, min_words, block_rows)
    own = parts.groupBy("uid").agg(  # of one document
        F.count("*").alias("n_repeated"), F.sum("words").alias("n_repeated_words"),
        F.count(F.when(~F.col("stays"), 1)).alias("n_removed"),
        F.collect_set("first_doc_id").alias("first_doc_ids"), F.collect_set("class_id").alias("class_ids"),
    )
    rows = table.drop("windows", "at").join(own, "uid", "left").join(shared_passages(table), "uid", "left")
    count = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    both = lambda a, b, kind: F.sort_array(
        F.array_union(*[F.coalesce(x, F.array().cast(f"array<{kind}>")) for x in (a, b)]))
    return rows.select(
        "doc_id", "n_paragraphs", count("n_repeated").alias("n_repeated"), count("n_removed").alias("n_removed"),
        ((count("n_repeated") > 0) | (count("n_passage_words") > 0)).alias("repeated"),
        both("first_doc_ids", "passage_doc_ids", table.schema["doc_id"].dataType.simpleString()).alias("first_doc_ids"),
        both("class_ids", "passage_ids", "long").alias("class_ids"),
        "n_words", count("n_repeated_words").alias("n_repeated_words"), count("n_passage_words").alias("n_passage_words"),
    )


def near_documents(docs, id_col="doc_id", text_col="text", similarity=SIMILARITY, recall=0.95, most=20):
    """doc_id and class_id of each document with words: whole texts as one paragraph each, in the same bands.

    Bands are long, so that only near texts meet; each text is compared with the first one of each of its bands. That finds
    a pair of the given similarity with the given probability, unless another text stands before both in all their
    common bands and is near to neither.
    """
    bands, rows = tune_bands(similarity, recall, most)
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(" "))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    table = own.withColumns({"uid": F.lit(0).cast("long"), "at": F.xxhash64("text")}).mapInArrow(
        lambda batches: _signed_parts(batches, bands, rows, 1, with_windows=False),
        f"uid long, doc_id {kind}, at long, n_paragraphs long, n_words long, parts {_PARTS}, windows {_WINDOWS}",
    )
    parts = written(table.select("doc_id", "at", F.explode("parts").alias("part")).select("doc_id", "at", "part.*"), "document-parts")
    _, _, links = star_links(own, parts.select("doc_id", "at", "no", "key", "bands"), similarity)
    roots = components(links, "documents").select(F.col("node").alias("key"), "root")
    return parts.join(roots, "key", "left").select("doc_id", F.coalesce("root", "key").alias("class_id"))
