"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1, made from a seeded hash of the letter. A trigram is the product of its
letters' vectors, each rotated by its place; a text is the sum of its trigrams, a language the sum of its texts. A text
gets the language whose profile, less what all profiles have in common, has the largest cosine with it.

All sums are of whole numbers that floating point holds exactly, so a score doesn't depend on how texts are batched.
"""

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm.common import text_bytes

DIMENSIONS = 1024
SEED = 11
UNKNOWN = "und"
# cosine below which the pipeline rejects a text. Short clean texts come down to 0.05, so only what has no letter or
# points away from every profile goes.
MIN_SCORE = 0.02

_BITS = 21  # of a symbol; three symbols make a trigram of 63 bits
_MASK = (1 << _BITS) - 1
_FREQUENT = 128  # symbols below are a-z and the small letters of Latin-1
_RARE = sum((_MASK ^ (_FREQUENT - 1)) << (_BITS * i) for i in range(3))  # bits of trigrams with another letter
_PIECE = 1 << 20
_CACHE_ROWS = 16_384
_BLOCK = 8192
_BATCH_DOCS, _BATCH_SYMBOLS = 256, 1 << 20  # a fold stays below 2**24 trigrams, up to which float32 counts exactly
_SCALE = 1 << 20


@lru_cache(maxsize=1)
def _symbol_of():
    """Symbol of each code point: 0 for what is no letter; a-z, the small letters of Latin-1, then one for each letter."""
    table = np.zeros(0x110000, np.int32)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = _FREQUENT + letters
    table[97:123] = np.arange(1, 27)
    latin = np.array([c for c in range(0xDF, 0x100) if chr(c).isalpha()])
    table[latin] = 27 + np.arange(latin.size)
    return table


def trigram_pieces(data):
    """Trigram numbers of a whole text in UTF-8, in pieces of bounded size; runs of non-letters are one blank."""
    text = data.decode("utf-8", "replace")
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), _PIECE):
        points = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = _symbol_of()[points].astype(np.int64)
        if at + _PIECE >= len(text):
            codes = np.append(codes, 0)
        codes = np.concatenate([tail, codes])
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
        tail = codes[-2:]
        yield (codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:]


def _packed(trigrams):
    """Trigrams of frequent letters as numbers below 2**21."""
    return (trigrams >> 2 * _BITS << 14) | (trigrams >> _BITS & 127) << 7 | (trigrams & 127)


def _unpacked(numbers):
    return (numbers >> 14 << 2 * _BITS) | (numbers >> 7 & 127) << _BITS | (numbers & 127)


def distinct(trigrams):
    """(distinct trigrams in ascending order, place of each given one among them)."""
    plain = (trigrams & _RARE) == 0
    numbers = _packed(trigrams[plain])
    seen = np.zeros(1 << 21 if numbers.size > 4096 else 0, bool)
    if seen.size:
        seen[numbers] = True
        own = np.flatnonzero(seen)
        place = np.empty(seen.size, np.int64)
        place[own] = np.arange(own.size)
        place = place[numbers]
    else:
        own, place = np.unique(numbers, return_inverse=True)
    if numbers.size == trigrams.size:
        return _unpacked(own), place
    rare, rare_place = np.unique(trigrams[~plain], return_inverse=True)
    both = np.concatenate([_unpacked(own), rare])
    order = np.argsort(both)
    rank = np.empty(order.size, np.int64)
    rank[order] = np.arange(order.size)
    at = np.empty(trigrams.size, np.int64)
    at[plain], at[~plain] = rank[place], rank[own.size + rare_place]
    return both[order], at


class Vectors:
    """Trigram vectors; keeps those of the last letters and trigrams that came up."""

    def __init__(self, dimensions=DIMENSIONS, seed=SEED):
        self.dimensions, self.seed, self.known = dimensions, seed, {}
        self.row_of, self.rows = np.full(1 << 21, -1, np.int32), 0
        self.cache = np.empty((_CACHE_ROWS, dimensions), np.float32)

    def letter(self, symbol):
        found = self.known.get(symbol)
        if found is None:
            if len(self.known) >= _CACHE_ROWS:
                self.known.clear()
            data = hashlib.shake_256(f"{self.seed}:{symbol}".encode()).digest(-(-self.dimensions // 8))
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: self.dimensions]
            found = self.known[symbol] = bits.astype(np.int8) * 2 - 1
        return found

    def bind(self, trigrams):
        places = [trigrams >> 2 * _BITS, trigrams >> _BITS & _MASK, trigrams & _MASK]
        symbols, at = np.unique(np.concatenate(places), return_inverse=True)
        letters = np.stack([self.letter(s) for s in symbols.tolist()]) if symbols.size else np.zeros((0, self.dimensions), np.int8)
        first, second, third = np.split(at, 3)
        return np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]

    def of(self, trigrams):
        """float32 rows of up to `_BLOCK` distinct trigrams."""
        plain = (trigrams & _RARE) == 0
        if not plain.all():
            out = np.empty((trigrams.size, self.dimensions), np.float32)
            out[plain], out[~plain] = self.of(trigrams[plain]), self.bind(trigrams[~plain])
            return out
        numbers = _packed(trigrams)
        new = self.row_of[numbers] < 0
        if self.rows + np.count_nonzero(new) > _CACHE_ROWS:
            self.row_of[:], self.rows, new = -1, 0, np.ones(numbers.size, bool)
        n = np.count_nonzero(new)
        self.cache[self.rows : self.rows + n] = self.bind(trigrams[new])
        self.row_of[numbers[new]] = np.arange(self.rows, self.rows + n)
        self.rows += n
        return self.cache[self.row_of[numbers]]


def _held_out(id_col):
    left = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    return F.coalesce(left == 0, F.lit(True))


def learn(docs, text_col="text", lang_col="lang", dimensions=DIMENSIONS, seed=SEED):
    """(languages, centred profiles as unit rows) from all texts with a language.

    Trigrams are counted by language in Spark; their vectors are summed by 16 tasks, so that what comes to the driver
    has 16 vectors per language at most, however many documents there are.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")

    def counted(batches):
        for batch in batches:
            waiting, size = {}, {}
            for lang, data in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
                own = waiting.setdefault(lang, [])
                for piece in trigram_pieces(data):
                    own.append(piece)
                    size[lang] = size.get(lang, 0) + piece.size
                    if size[lang] > 2 * _PIECE:
                        yield _count_rows(lang, own)
                        own.clear()
                        size[lang] = 0
            for lang, own in waiting.items():
                yield _count_rows(lang, own)

    counts = rows.mapInArrow(counted, "lang string, trigram long, n long")
    counts = counts.groupBy("lang", "trigram").agg(F.sum("n").alias("n")).repartition(16, "trigram")

    def bundled(batches):
        vectors, total = Vectors(dimensions, seed), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            trigrams, n = batch.column("trigram").to_numpy(), batch.column("n").to_numpy()
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                for some in np.array_split(at, at.size // 4096 + 1):
                    part = n[some].astype(np.float64) @ vectors.bind(trigrams[some]).astype(np.float64)
                    total[lang] = total.get(lang, 0) + part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))],
            names=["lang", "profile"],
        )

    profiles = {}
    for row in counts.mapInArrow(bundled, "lang string, profile array<double>").toLocalIterator():
        profiles[row["lang"]] = profiles.get(row["lang"], 0) + np.array(row["profile"])
    names = sorted(x for x, v in profiles.items() if np.any(v))
    if not names:
        return [], np.zeros((0, dimensions))
    unit = np.stack([profiles[x] / np.linalg.norm(profiles[x]) for x in names])
    if len(names) > 1:
        unit = unit - unit.mean(0)
        unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return names, unit


def _count_rows(lang, pieces):
    trigrams, at = distinct(np.concatenate(pieces)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * trigrams.size, pa.string()), pa.array(trigrams), pa.array(np.bincount(at, minlength=trigrams.size))],
        names=["lang", "trigram", "n"],
    )


class Identifier:
    """Languages and scores of texts.

    Bundles of texts and the profiles (rounded to whole numbers at a norm of 2**20) are whole numbers, so their products
    are exact for texts of up to 2**28 letters, and a score is the same in every batch.
    """

    def __init__(self, names, profiles, dimensions=DIMENSIONS, seed=SEED):
        self.names, self.vectors = names, Vectors(dimensions, seed)
        self.profiles = np.rint(np.asarray(profiles, np.float64).reshape(len(names), dimensions) * _SCALE)
        self.norms = np.sqrt([math.fsum(p * p) for p in self.profiles])

    def identify(self, texts):
        """(language, score) of each text (bytes or None); the texts are taken in batches of bounded size."""
        rows, size, parts = 0, 0, []
        self._clear()
        for data in texts:
            for piece in trigram_pieces(data or b""):
                parts.append((rows, piece))
                size += piece.size
                if size > _BATCH_SYMBOLS:
                    self._fold(parts)
                    size, parts = 0, []
            rows += 1
            if rows == _BATCH_DOCS:
                self._fold(parts)
                yield from self._scores(rows)
                rows, size, parts = 0, 0, []
                self._clear()
        self._fold(parts)
        yield from self._scores(rows)

    def _clear(self):
        self.sums, self.letters = np.zeros((_BATCH_DOCS, self.vectors.dimensions)), np.zeros(_BATCH_DOCS, np.int64)

    def _fold(self, parts):
        """Add the trigrams of (text, trigrams) parts to the bundles of the texts."""
        if not parts:
            return
        text = np.repeat([row for row, _ in parts], [piece.size for _, piece in parts])
        trigrams = np.concatenate([piece for _, piece in parts])
        self.letters += np.bincount(text[trigrams != 0], minlength=_BATCH_DOCS)
        if not self.names:
            return
        low, n = parts[0][0], parts[-1][0] - parts[0][0] + 1
        used, at = distinct(trigrams)
        for start in range(0, used.size, _BLOCK):
            block = used[start : start + _BLOCK]
            own, row = at - start, text - low
            if used.size > _BLOCK:
                here = (own >= 0) & (own < block.size)
                own, row = own[here], row[here]
            table = np.bincount(row * block.size + own, minlength=n * block.size).reshape(n, block.size)
            self.sums[low : low + n] += table.astype(np.float32) @ self.vectors.of(block)

    def _scores(self, rows):
        if not self.names:
            return [(UNKNOWN, 0.0)] * rows
        sums = self.sums[:rows]
        if np.abs(sums).max(initial=0) < 1 << 26:
            squares = (sums.astype(np.int64) ** 2).sum(1).astype(np.float64)
        else:
            squares = np.array([math.fsum(v * v) for v in sums])
        near = (sums @ self.profiles.T) / np.maximum(np.sqrt(squares)[:, None] * self.norms, 1e-9)
        best = near.argmax(1)
        return [
            (self.names[b], min(1.0, max(0.0, float(near[i, b])))) if self.letters[i] else (UNKNOWN, 0.0)
            for i, b in enumerate(best)
        ]


def identify_languages(docs, id_col="doc_id", text_col="text", lang_col="lang", dimensions=DIMENSIONS, seed=SEED):
    """One row per document: doc_id, held_out, lang_pred, score.

    Profiles come from the texts with a language whose crc32(id as text) mod 5 is not 0; the others, and those with a null
    id, are held out. Null texts and texts without a letter are `und` with score 0, as are all if nothing can be learned.
    The score is the cosine, or 0 if it is negative; of equal cosines the first language by name counts. Repeated rows give
    repeated rows; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        _held_out(id_col).alias("held_out"),
    )
    names, profiles = learn(rows.where("NOT held_out"), dimensions=dimensions, seed=seed)
    sent = docs.sparkSession.sparkContext.broadcast((names, profiles))  # one vector per language

    def predicted(batches):
        identifier = Identifier(*sent.value, dimensions, seed)
        for batch in batches:
            found = list(identifier.identify(text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def keep_identified(docs, id_col="doc_id", text_col="text", lang_col="lang", min_score=MIN_SCORE, languages=None,
                    dimensions=DIMENSIONS, seed=SEED):
    """The rows of `docs` whose text is in one of the languages (default: any learned one) with at least `min_score`.

    Null texts and texts without a letter go. If no language can be learned (no text with one), there is nothing to reject
    by, and with `languages` left open all texts with a letter stay. Repeated rows are kept or go together, null ids
    teach nothing, an empty table gives an empty one; columns of any name are passed on.
    """
    names, profiles = learn(docs.where(~_held_out(id_col)), text_col, lang_col, dimensions, seed)
    sent = docs.sparkSession.sparkContext.broadcast((names, profiles))  # one vector per language

    def kept(batches):
        identifier = Identifier(*sent.value, dimensions, seed)
        wanted = set(sent.value[0] if languages is None else languages)
        for batch in batches:
            texts = text_bytes(batch.column(text_col))
            if not sent.value[0] and languages is None:
                keep = [i for i, x in enumerate(texts) if x and any(p.any() for p in trigram_pieces(x))]
            else:
                found = identifier.identify(texts)
                keep = [i for i, (lang, score) in enumerate(found) if lang in wanted and score >= min_score]
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(kept, docs.schema)
