"""Phrase collocations by relational set mining (SETM).

Occurrences of words are a relation (piece, place, word) that is persisted in buckets by piece, sorted by piece and place. The
occurrences of phrases of one more word come from a merge join of the relation with itself on equal pieces and adjacent
places, which needs no shuffle. They are counted by phrase; those of frequent phrases (semi-join) are persisted in the same
way and are extended next. A phrase that is frequent consists of frequent ones, so nothing is lost.

A piece is a text, or a part of a long one, whose punctuation marks and line ends take places of their own, so that words on two
sides of a mark are not adjacent. A word stands in the relation as a 64-bit hash of language and word. The hashes of all words
are compared, and another seed is taken if two words share one, so a hash is as good as the word.
"""

import re
from collections import Counter
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, PIECE_BYTES, discard, text_bytes, written
from fleetlens.session import run_dir

MIN_COUNT = 10
MAX_WORDS = 3
CONTAINED_PERCENT = 50
TOP = 2000
UNKNOWN = "und"
# words of the relation in one bucket, besides at least one bucket per shuffle partition
BUCKET_WORDS = 4_000_000
# up to so many frequent phrases (a few longs each) go to all tasks for the semi-join; more are joined by a shuffle
BROADCAST_ROWS = 1 << 20
# distinct words that a task counts at a time
DISTINCT_WORDS = 200_000

_SALTS = 16
_SEEDS = 16
# bytes.translate table: A-Z become a-z, a tab a blank, what ends a piece a full stop
_PLAIN = bytes(46 if b in b".,;:!?\n\x0b\f\r" else 32 if b == 9 else LOWER[b] for b in range(256))
_BLANKS = re.compile(b"  +")
# Buckets by piece serve a join on piece and place, and a bucket of one sorted file needs no sort
_MERGE_SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


@contextmanager
def _settings(spark, values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _cut(data, size):
    """Parts of about `size` bytes of a text whose marks are full stops, cut at marks; what has no mark stays whole."""
    at = 0
    while len(data) - at > size:
        end = data.rfind(b".", at, at + size)
        if end < 0:
            end = data.find(b".", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:]


def _spaced(size):
    def spaced(batches):
        for batch in batches:
            langs, parts, held = [], [], 0
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for part in _cut((text or b"").translate(_PLAIN), size):
                    part = _BLANKS.sub(b" ", part.replace(b".", b" . ")).strip(b" ")
                    langs.append(lang)
                    parts.append(part)
                    held += len(part)
                    if held > size:
                        yield _batch(langs, parts)
                        langs, parts, held = [], [], 0
            yield _batch(langs, parts)

    return spaced


def _batch(langs, parts):
    texts = pa.array(parts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), texts], names=["lang", "piece_text"])


def _texts(docs, text_col, lang_col):
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col))


def pieces_of(docs, text_col="text", lang_col="lang", piece_bytes=PIECE_BYTES):
    """piece (a number), lang, piece_text: texts of words (A-Z lower-cased) and marks with one blank between them.

    A full stop stands for every punctuation mark and line end. A text of over `piece_bytes` bytes is cut at marks.
    """
    rows = _texts(docs, text_col, lang_col).mapInArrow(_spaced(piece_bytes), "lang string, piece_text string")
    return rows.where("piece_text <> ''").withColumn("piece", F.monotonically_increasing_id())


def words_of(pieces):
    """piece, lang, place, word: one row per word of each piece. A mark takes a place too, so words beside it aren't adjacent."""
    rows = pieces.select("piece", "lang", F.posexplode(F.split("piece_text", " ")).alias("place", "word"))
    return rows.where(F.col("word") != ".")


def word_hash(seed):
    return F.xxhash64(F.lit(seed), F.col("lang"), F.col("word"))


def _counted(size, distinct):
    def rows(counts):
        for lang, found in counts.items():
            words = pa.array(found, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(found)), words, pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    def counted(batches):
        counts, held = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for part in _cut((text or b"").translate(_PLAIN), size):
                    found = counts.setdefault(lang, Counter())
                    held -= len(found)
                    found.update(part.replace(b".", b" ").split())
                    held += len(found)
                    if held > distinct:
                        yield from rows(counts)
                        counts, held = {}, 0
        yield from rows(counts)

    return counted


def count_words(docs, text_col="text", lang_col="lang", piece_bytes=PIECE_BYTES, distinct=DISTINCT_WORDS):
    """(table lang, word, n, h of all words, seed): h tells the words apart.

    Tasks hand on the counts of about `distinct` words at a time, Spark adds them up.
    """
    counts = _texts(docs, text_col, lang_col).mapInArrow(_counted(piece_bytes, distinct), "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    for seed in range(_SEEDS):
        hashed = counts.withColumn("h", word_hash(seed))
        if hashed.groupBy("h").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            return hashed, seed
    raise ValueError("no seed tells the words apart")


class _Relation:
    """Occurrences of phrases (piece, place, h1, h2, ...), persisted in sorted buckets."""

    def __init__(self, rows, width, buckets):
        self.spark, self.width, self.buckets = rows.sparkSession, width, buckets
        self.path = run_dir(self.spark, f"occurrences-{width}")
        self.name = "occurrences_" + self.path.rpartition("-")[2]
        writer = rows.write.bucketBy(buckets, "piece").sortBy("piece", "place").format("parquet").option("path", self.path)
        # words repeat, so a large dictionary makes small files
        writer.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).saveAsTable(self.name)

    def extended(self):
        """Occurrences of phrases of one more word: each with the one that begins a place later in its piece."""
        rows, last = self.spark.table(self.name), f"h{self.width}"
        later = rows.select("piece", F.col("place").alias("_later"), F.col(last).alias(f"h{self.width + 1}")).hint("merge")
        here = rows.withColumn("_later", F.col("place") + 1)
        return here.join(later, ["piece", "_later"]).drop("_later")

    def drop(self):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def _items(width):
    return [f"h{i + 1}" for i in range(width)]


def _semi_join(rows, frequent, keys, broadcast_rows):
    """(rows of frequent phrases, whether rows stayed in place). The size of the broadcast side is counted first."""
    small = frequent.count() <= broadcast_rows
    return rows.join(F.broadcast(frequent) if small else frequent, keys, "left_semi"), small


def frequent_phrases(docs, words, seed, text_col="text", lang_col="lang", min_count=MIN_COUNT, max_words=MAX_WORDS,
                     bucket_words=BUCKET_WORDS, broadcast_rows=BROADCAST_ROWS):
    """items (array of word hashes), n: all phrases of 1 to `max_words` words that occur at least `min_count` times."""
    spark = docs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_words))
    singles = written(words.where(F.col("n") >= min_count).select(F.col("h").alias("h1"), "n"), "phrases-1")
    found = [singles]
    with _settings(spark, _MERGE_SETTINGS):
        # pieces are dealt to buckets before they become words; many words follow one piece
        rows = words_of(pieces_of(docs, text_col, lang_col).repartition(buckets, "piece"))
        rows = rows.select("piece", "place", word_hash(seed).alias("h1"))
        rows, stayed = _semi_join(rows, singles.select("h1"), ["h1"], broadcast_rows)
        relation = _Relation(rows if stayed else rows.repartition(buckets, "piece"), 1, buckets)
        for width in range(2, max_words + 1):
            longer = relation.extended()
            counts = longer.groupBy(*_items(width)).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
            found.append(written(counts, f"phrases-{width}"))
            if width == max_words:
                break
            rows, stayed = _semi_join(longer, found[-1].select(_items(width)), _items(width), broadcast_rows)
            rows = rows.select("piece", "place", *_items(width))
            before, relation = relation, _Relation(rows if stayed else rows.repartition(buckets, "piece"), width, buckets)
            before.drop()
        relation.drop()
    arrays = [f.select(F.array(*_items(i)).alias("items"), "n") for i, f in enumerate(found, 1)]
    return reduce(lambda a, b: a.unionByName(b), arrays)


def _keyed(rows, items="items", key="key"):
    """With a hash of the items: rows are sorted by it, which is a lot faster than by the items alone."""
    return rows.withColumn(key, F.xxhash64(items))


def score_phrases(phrases, wanted=None):
    """items, a, k, l, r, score of the phrases of two words and more: the cut after k words with the lowest score.

    `wanted`: those of `phrases` to score, if not all.
    """
    whole = (phrases if wanted is None else wanted).where(F.size("items") > 1).withColumnRenamed("n", "a")
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.size("items") - 1)).alias("k")).select(
        "*", F.slice("items", F.lit(1), F.col("k")).alias("first"),
        F.slice("items", F.col("k") + 1, F.size("items") - F.col("k")).alias("rest"),
    )
    side = lambda part, count: _keyed(phrases.select(F.col("items").alias(part), F.col("n").alias(count)), part)
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = _keyed(cuts, part).join(side(part, count), ["key", part]).drop("key")
    wide = lambda name: f"CAST({name} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = _keyed(cuts).groupBy("key", "items", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("items", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def free_phrases(phrases, percent=CONTAINED_PERCENT):
    """items, n of the phrases of two words and more that stand in no longer one with at least `percent` percent of their count."""
    whole = phrases.where(F.size("items") > 1).select("items", "n", F.lit(None).cast("long").alias("longer"))
    inner = phrases.where(F.size("items") > 2).select(F.explode(F.expr(
        "flatten(transform(sequence(2, size(items) - 1), m -> transform(sequence(1, size(items) - m + 1), i -> slice(items, i, m))))"
    )).alias("items"), F.lit(None).cast("long").alias("n"), F.col("n").alias("longer"))
    # what stands in a frequent phrase is frequent, so each inner phrase meets its own row
    both = whole.unionByName(inner).groupBy("items").agg(F.max("n").alias("n"), F.max("longer").alias("longer"))
    return both.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * percent)).drop("longer")


def named(phrases, words):
    """The phrases with phrase (their words joined by a blank)."""
    at = phrases.select("items", F.posexplode("items").alias("i", "h")).join(words.select("h", "word"), "h")
    names = _keyed(at).groupBy("key", "items").agg(  # of one phrase
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    return _keyed(phrases).join(names, ["key", "items"]).drop("key")


def _first(rows, order, by, top, number=F.row_number):
    """The first `top` rows within parts of each language, so that no task gets all phrases of one."""
    part = Window.partitionBy("lang", F.pmod(F.xxhash64(by), F.lit(_SALTS))).orderBy(*order)
    return rows.withColumn("rank", number().over(part)).where(F.col("rank") <= top).drop("rank")


def collocations(docs, text_col="text", lang_col="lang", min_count=MIN_COUNT, max_words=MAX_WORDS,
                 contained_percent=CONTAINED_PERCENT, top=TOP, bucket_words=BUCKET_WORDS, broadcast_rows=BROADCAST_ROWS):
    """One row per language and phrase: lang, rank, phrase, a, l, r, n, score, words, cut.

    A text (A-Z lower-cased) is cut into pieces at punctuation marks and line ends, a piece into words at blanks and tabs; a
    phrase lies within a piece. `n` counts the words of the language, `a` the occurrences of the phrase, which is of 2 to
    `max_words` words and occurs at least `min_count` times, `l` and `r` those of the parts before and after the cut (after
    `cut` words) with the lowest score, floor(1,000,000 * a * a / (l * r)); of equal cuts the first counts. A phrase inside a
    longer one that has at least `contained_percent` percent of its occurrences is dropped. Of each language the first
    `top` phrases by score, then a (both descending), then phrase in byte order, are returned.

    Null and empty texts have no words; a null language is `und`. Repeated rows count once each. Counts are exact up to
    10**15. Other columns are not read.
    """
    if max_words < 2:
        raise ValueError("phrases have two words at least")
    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    words, seed = count_words(own)
    phrases = frequent_phrases(own, words, seed, "text", "lang", min_count, max_words, bucket_words, broadcast_rows)
    scored = score_phrases(phrases, free_phrases(phrases, contained_percent)).withColumn("h", F.col("items")[0])
    frequent = words.where(F.col("n") >= min_count)
    scored = written(scored.join(frequent.select("h", "lang"), "h").drop("h"), "collocations")
    # only what may be among the first needs its words; with equal scores and counts all do
    order = [F.desc("score"), F.desc("a")]
    rows = named(written(_first(scored, order, "items", top, F.rank), "first-collocations"), frequent)
    order.append(F.asc("phrase"))
    rows = _first(rows, order, "phrase", top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"),
        F.size("items").alias("words"), F.col("k").alias("cut"),
    )
