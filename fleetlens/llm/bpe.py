"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The library works on characters, so each byte is shown as a character of its own (the printable ones of Latin-1 as
themselves, the others from U+0100 on), and vocabulary and merges are written in these characters. Every way to put a token
together from two others is a merge with the rank of the token: that is the rule of rank files, where the pair with the
lowest rank of the joined bytes is merged first. Decoding reads the tokens back through the reversed byte table; characters
whose bytes are split over tokens come together there.
"""

import base64
import codecs
import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm.common import text_bytes

# characters of a text that are taken at a time; a long text is cut at the next safe place after as many
PIECE_CHARS = 1 << 18
# rank files go to all tasks, so they are bounded
MOST_FILE_BYTES = 64 << 20
REPLACEMENT = "\N{REPLACEMENT CHARACTER}".encode()

# The characters with the Unicode property White_Space
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Some letters, in any version of Unicode, and the ASCII characters that are neither letters nor white space
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_MARK = "!-@\\[-`{-~"
# A match holds white space at its beginning or nothing else, and no match runs on from a letter to what is none. So a text
# can be cut before white space that follows something else, and after a letter before a mark: it is a row of units that
# are encoded each by itself.
_UNIT = re.compile(f"[{_SPACE}]*(?:[^{_SPACE}]*?[{_LETTER}](?=[{_MARK}])|[^{_SPACE}]+)|[{_SPACE}]+")
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_MOST_UNITS = 1 << 19


def byte_characters():
    """The character that stands for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def read_ranks(data):
    """Token bytes -> rank, from the lines (base64, rank) of a rank file."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def build_tokenizer(ranks, pattern):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [
        (shown(token[:i]), shown(token[i:]))
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
         pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


@lru_cache(maxsize=2)
def _loaded(digest, pattern, source):
    return build_tokenizer(read_ranks(source.value), pattern)


@lru_cache(maxsize=2)
def _token_bytes(digest, source):
    """Bytes of each id, None where there is no token, by way of the byte table as the library's tokens are written."""
    ranks, chars = read_ranks(source.value), byte_characters()
    byte_of, table = {c: b for b, c in enumerate(chars)}, [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = bytes(byte_of[c] for c in "".join(chars[b] for b in token))
    return table


class _Source:
    """A broadcast rank file; equal to others of the same content, so that a worker builds each tokenizer once."""

    def __init__(self, sent, digest):
        self.sent, self.digest = sent, digest

    value = property(lambda self: self.sent.value)
    __hash__ = lambda self: hash(self.digest)
    __eq__ = lambda self, other: self.digest == other.digest


def _shipped(spark, path):
    with open(path, "rb") as file:
        data = file.read(MOST_FILE_BYTES + 1)
    if len(data) > MOST_FILE_BYTES:
        raise ValueError(f"{path} has more than {MOST_FILE_BYTES} bytes")
    return _Source(spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest())


def text_pieces(text, size=PIECE_CHARS):
    """(place, piece) of a text, cut where no match of the pattern can run on; a run without white space stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


class Encoder:
    """Encodes texts unit by unit; the ids and offsets of the units that came up are kept, in arrays."""

    def __init__(self, tokenizer, with_offsets):
        self.tokenizer, self.with_offsets = tokenizer, with_offsets
        self._clear()

    def _clear(self):
        self.index, self.first, self.count, self.used = {}, np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0
        self.flat = np.zeros((3 if self.with_offsets else 1, 1 << 12), np.int32)

    def _learn(self, units):
        """Have the library encode new units, some ten thousand characters at a time."""
        batch = self.tokenizer.encode_batch if self.with_offsets else self.tokenizer.encode_batch_fast
        ids, offsets, counts, at = [], [], [], 0
        while at < len(units):
            end, chars = at, 0
            while end < len(units) and (end == at or chars + len(units[end]) <= 1 << 16):
                chars += len(units[end])
                end += 1
            for found in batch(units[at:end], add_special_tokens=False):
                own = found.ids
                ids += own
                counts.append(len(own))
                if self.with_offsets:
                    offsets += found.offsets
            at = end
        known, counts = len(self.index), np.array(counts, np.int64)
        self.index.update(zip(units, range(known, known + len(units)), strict=True))
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[0, self.used : self.used + len(ids)] = ids
        if self.with_offsets:
            self.flat[1:, self.used : self.used + len(ids)] = np.array(offsets, np.int32).reshape(-1, 2).T
        self.first, self.count = _room(self.first, len(self.index)), _room(self.count, len(self.index))
        self.count[known : len(self.index)] = counts
        self.first[known : len(self.index)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _tokens(self, pieces):
        """Arrays like those of `encode` for (place, piece) of some texts, whose new units are encoded together."""
        if len(self.index) > _MOST_UNITS:
            self._clear()
        rows = [_UNIT.findall(piece) for _, piece in pieces]
        new = [u for u in dict.fromkeys(chain.from_iterable(rows)) if u not in self.index]
        if new:
            self._learn(new)
        for (at, _), units in zip(pieces, rows, strict=True):
            place = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
            count = self.count[place]
            out = self.flat[:, np.repeat(self.first[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            if self.with_offsets:
                sizes = np.fromiter(map(len, units), np.int64, len(units))
                out[1:] += np.repeat(at + np.cumsum(sizes) - sizes, count).astype(np.int32)
            yield out

    def encode(self, texts, size=PIECE_CHARS):
        """ids (one row), or ids, starts and ends (three rows), of each whole text in UTF-8 or None."""
        parts, waiting, owners, chars = [], [], [], 0

        def flush():
            for owner, found in zip(owners, self._tokens(waiting), strict=True):
                parts[owner].append(found)
            waiting.clear()
            owners.clear()

        for data in texts:
            parts.append([])
            for piece in text_pieces((data or b"").decode("utf-8", "replace"), size):
                waiting.append(piece)
                owners.append(len(parts) - 1)
                chars += len(piece[1])
                if chars >= size:
                    flush()
                    chars = 0
        flush()
        return [np.concatenate(p, axis=1) if len(p) > 1 else p[0] for p in parts]


def _room(array, size):
    """The array with space for `size` entries along its last axis."""
    if size <= array.shape[-1]:
        return array
    out = np.zeros((*array.shape[:-1], max(size, 2 * array.shape[-1])), array.dtype)
    out[..., : array.shape[-1]] = array
    return out


def _lists(arrays):
    ends = np.cumsum([0, *(a.size for a in arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs, path, pattern, id_col="doc_id", text_col="text", with_offsets=True, piece_chars=PIECE_CHARS):
    """One row per document: doc_id, ids (array of int), and with `with_offsets` also starts and ends (arrays of int).

    `path` is a rank file that the driver can read, `pattern` the expression whose matches are encoded each by itself.
    Strings of special tokens are ordinary text. A token's start and end are the places of its characters in the text; a
    token with a part of a character has the place of the whole one. Null and empty texts have no tokens; bytes that aren't
    UTF-8 count as U+FFFD. Repeated rows and null ids are rows like others, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = _shipped(docs.sparkSession, path)

    def mapped(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core
        encoder = Encoder(_loaded(source.digest, pattern, source), with_offsets)
        for batch in batches:
            found = encoder.encode(text_bytes(batch.column("text")), piece_chars)
            columns = [_lists([f[i] for f in found]) for i in range(3 if with_offsets else 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", "ids", "starts", "ends"][: 1 + len(columns)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = ", starts array<int>, ends array<int>" if with_offsets else ""
    return rows.mapInArrow(mapped, f"doc_id {kind}, ids array<int>{spans}")


def decode_ids(table, ids):
    """Bytes of a list of ids; an unknown id gives U+FFFD."""
    return b"".join([(table[i] if 0 <= i < len(table) else None) or REPLACEMENT for i in ids])


def token_texts(table, ids):
    """What each id adds to the text: a character split over tokens comes with the token that completes it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    texts = [decoder.decode(decode_ids(table, [i])) for i in ids]
    rest = decoder.decode(b"", final=True)
    if rest:
        texts[-1] += rest
    return texts


def decode(rows, path, id_col="doc_id", ids_col="ids", keep=(), with_text=True, by_token=False):
    """One row per row: doc_id, the columns `keep`, data (the bytes), with `with_text` also text (UTF-8; a character cut off
    by the ends of the ids gives U+FFFD), with `by_token` also token_texts (the text that each id completes).

    Null ids in the list and such without a token give U+FFFD; a null or empty list gives empty data.
    """
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), *keep)
    source = _shipped(rows.sparkSession, path)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def mapped(batches):
        table = _token_bytes(source.digest, source)
        for batch in batches:
            found = batch.column("ids")
            ids = found.values.cast(pa.int64()).fill_null(-1).to_numpy()
            ends = found.offsets.to_numpy()
            lists = [(a, b if there else a) for a, b, there in zip(ends[:-1], ends[1:], found.is_valid().to_pylist(), strict=True)]
            data = [decode_ids(table, ids[a:b].tolist()) for a, b in lists]
            columns = {name: batch.column(name) for name in ("doc_id", *keep)} | {"data": pa.array(data, pa.binary())}
            if with_text:
                columns["text"] = pa.array([x.decode("utf-8", "replace") for x in data], pa.string())
            if by_token:
                columns["token_texts"] = pa.array([token_texts(table, ids[a:b].tolist()) for a, b in lists], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds |= {"data": "binary"} | ({"text": "string"} if with_text else {}) | ({"token_texts": "array<string>"} if by_token else {})
    return rows.mapInArrow(mapped, ", ".join(f"`{c}` {k}" for c, k in kinds.items() if c != "ids"))
