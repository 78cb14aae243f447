"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of a document run through the automaton, which gives at each word the longest match that ends there. A match
of `window` words (or of a whole shorter item) marks its words as hit. Documents lose the hit spans, or go altogether
if too much of them is hit. The test items are taken in blocks of bounded size, one automaton each.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm.common import ALNUM, free_name, pieces, text_bytes, written

WINDOW = 10
# words of the test items that one automaton holds at most; longer items are cut into overlapping parts
BLOCK_WORDS = 50_000
# share of hit words above which a document goes
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = "array<struct<first: long, last: long>>"


class Automaton:
    """Generalised suffix automaton over words. `items` are (name, words, whole); a part of a cut item isn't whole."""

    def __init__(self, items, window=WINDOW):
        self.window = window
        self.words, self.next, self.link, self.length = {}, [{}], [-1], [0]
        coded = []
        for name, words, whole in items:
            code = [self.words.setdefault(w, len(self.words)) for w in words]
            coded.append((name, code, whole))
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.owners = {}  # state of a window -> names of the items with that window
        self.short = {}  # state of a whole short item -> (number of words, name)
        self.least = window
        for name, code, whole in coded:
            if len(code) >= window:
                for _, state, length in self.walk(code):
                    if length >= window:
                        self.owners.setdefault(self._shorten(state), set()).add(name)
            elif whole and code:
                state = 0
                for c in code:
                    state = self.next[state][c]
                self.short.setdefault(state, []).append((len(code), name))
                self.least = min(self.least, len(code))

    def _state(self, length, link=-1, following=None):
        self.next.append(following if following is not None else {})
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state, word, target):
        """A copy of `target` for the matches that come by way of `state`, which are shorter."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last, word):
        target = self.next[last].get(word)
        if target is not None:
            fits = self.length[target] == self.length[last] + 1
            return target if fits else self._split(last, word, target)
        new, state = self._state(self.length[last] + 1), last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state == -1:
            self.link[new] = 0
        else:
            target = self.next[state][word]
            fits = self.length[target] == self.length[state] + 1
            self.link[new] = target if fits else self._split(state, word, target)
        return new

    def _shorten(self, state):
        """The state of the last `window` words of a match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, code, state=0, length=0):
        """(position, state, length) of the longest match at each word that can end a window. None is an unknown word."""
        following, link, lengths, least = self.next, self.link, self.length, self.least
        for i, c in enumerate(code):
            if c is None:
                state = length = 0
                continue
            target = following[state].get(c)
            while target is None and state:
                state = link[state]
                length = lengths[state]
                target = following[state].get(c)
            if target is None:
                continue
            state = target
            length += 1
            if length >= least:
                yield i, state, length
        self.at = state, length

    def ends(self, state, length):
        """(number of words, names) of the windows that end with this match."""
        if length >= self.window:
            yield self.window, self.owners.get(self._shorten(state), ())
        if self.short:
            while state > 0:
                for n, name in self.short.get(state, ()):
                    if n <= length:
                        yield n, (name,)
                state = self.link[state]

    def scan(self, data):
        """(number of words, hit spans as [first, last] word, names of the items) of one text in UTF-8."""
        n, spans, names, at = 0, [], set(), (0, 0)
        for words in pieces(data, ALNUM):
            for i, state, length in self.walk(map(self.words.get, words), *at):
                for size, owners in self.ends(state, length):
                    first = max(0, n + i - size + 1)
                    while spans and first <= spans[-1][0]:
                        spans.pop()
                    if spans and first <= spans[-1][1] + 1:
                        spans[-1][1] = n + i
                    else:
                        spans.append([first, n + i])
                    names.update(owners)
            at = self.at
            n += len(words)
        return n, spans, names


def item_blocks(benchmark, window=WINDOW, block_words=BLOCK_WORDS):
    """Lists of (name, words, whole) with about `block_words` words each, read from the table in streaming fashion."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        data = (row[1] or "").encode("utf-8", "replace")
        name = "" if row[0] is None else str(row[0])
        kept, whole = [], True
        for words in pieces(data, ALNUM):
            kept += words
            while len(kept) > block_words:
                block.append((name, kept[:block_words], False))
                yield block
                block, size, kept, whole = [], 0, kept[block_words - window + 1 :], False
        if kept and (whole or len(kept) >= window):
            block.append((name, kept, whole))
            size += len(kept)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merge(spans):
    out = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def benchmark_hits(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                   window=WINDOW, block_words=BLOCK_WORDS):
    """One row per document: doc_id, n_words, spans (hit words, from 0), items (sorted names of the items found).

    Null texts have no words; an item without words has no window; rows that repeat an item id count as one item; a null
    item id is the name ''. Repeated documents give repeated rows. Other columns are not read. Without items nothing is
    hit.
    """
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    context = docs.sparkSession.sparkContext
    later = False
    blocks = item_blocks(benchmark.select(item_col, item_text_col), window, block_words)
    for block in blocks:
        sent = context.broadcast(block)  # at most about 2 * block_words words
        if later:
            out = written(out, "hits")
        later = True

        def found(batches, sent=sent):
            automaton = Automaton(sent.value, window)
            for batch in batches:
                n_words, spans, items = [], [], []
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for data, (old_spans, old_items) in zip(text_bytes(batch.column("text")), before, strict=True):
                    n, new, names = automaton.scan(data or b"")
                    n_words.append(n)
                    new = _merge([*([x["first"], x["last"]] for x in old_spans), *new]) if old_spans else new
                    spans.append([{"first": a, "last": b} for a, b in new])
                    items.append(sorted(names.union(old_items)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                     pa.array(spans, batch.schema.field("spans").type), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

        out = out.mapInArrow(found, out.schema)
    return (out if later else _words_only(out)).drop("text")


def _words_only(out):
    """Without items: only the number of words."""

    def counted(batches):
        for batch in batches:
            n = [sum(map(len, pieces(x or b"", ALNUM))) for x in text_bytes(batch.column("text"))]
            at = batch.schema.get_field_index("n_words")
            yield batch.set_column(at, "n_words", pa.array(n, pa.int64()))

    return out.mapInArrow(counted, out.schema)


def cut_words(data, spans):
    """The text in UTF-8 without the words of the spans and what stands between them."""
    out, at, spans = [], 0, iter(spans)
    span = next(spans, None)
    for i, word in enumerate(_WORD.finditer(data)):
        if span is None:
            break
        if i == span[0]:
            out.append(data[at : word.start()])
        if i == span[1]:
            at = word.end()
            span = next(spans, None)
    out.append(data[at:])
    return b"".join(out)


def decontaminate(docs, benchmark, text_col="text", chars_col="n_chars", item_col="item_id", item_text_col="text",
                  window=WINDOW, max_coverage=MAX_COVERAGE, block_words=BLOCK_WORDS):
    """The documents without test items: hit spans are cut out; documents with over `max_coverage` hit words go.

    Cutting is repeated until nothing is hit, as what is left may join to a new hit. All columns stay, in their order;
    `chars_col`, if there is one, gets the new length. Documents without a hit stay as they are, null texts included.
    Coverage is that of the hits of all blocks in the text as it came, so `block_words` doesn't change the result.
    """
    context = docs.sparkSession.sparkContext
    read = lambda: item_blocks(benchmark.select(item_col, item_text_col), window, block_words)
    blocks = read()
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return _cut_one_block(docs, context.broadcast(first), text_col, chars_col, window, max_coverage)
    done, rest, most, hits = None, docs, max_coverage, free_name(docs, "_hit_spans")
    while True:
        rest = _spanned(rest, read(), text_col, window, hits)
        clean = rest.where(F.size(hits) == 0).drop(hits)
        done = clean if done is None else done.unionByName(clean)
        rest = rest.where(F.size(hits) > 0)
        if rest.isEmpty():
            return done
        rest = written(_cut_spans(rest, text_col, chars_col, most, hits), "decontaminated")
        most = None  # only the text as it came counts for coverage


def _spanned(docs, blocks, text_col, window, hits):
    """`docs` with the merged hit spans of all blocks as the column `hits`, written."""
    out = docs.withColumn(hits, F.array().cast(_SPANS))
    for block in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most about 2 * block_words words

        def found(batches, sent=sent):
            automaton = Automaton(sent.value, window)
            for batch in batches:
                at, spans = batch.schema.get_field_index(hits), []
                for data, old in zip(text_bytes(batch.column(text_col)), batch.column(at).to_pylist(), strict=True):
                    _, new, _ = automaton.scan(data or b"")
                    merged = _merge([*([x["first"], x["last"]] for x in old), *new])
                    spans.append([{"first": a, "last": b} for a, b in merged])
                yield batch.set_column(at, batch.schema.field(at), pa.array(spans, batch.schema.field(at).type))

        out = written(out.mapInArrow(found, out.schema), "hit-spans")
    return out


def _cut_spans(rows, text_col, chars_col, max_coverage, hits):
    """The rows of _spanned without the words of their spans; those with over `max_coverage` (if given) hit words go."""
    schema = rows.drop(hits).schema

    def cut(batches):
        for batch in batches:
            keep, texts = [], {}
            spans = batch.column(hits).to_pylist()
            for i, data in enumerate(text_bytes(batch.column(text_col))):
                own = [(x["first"], x["last"]) for x in spans[i]]
                if max_coverage is not None:
                    n = sum(map(len, pieces(data, ALNUM)))
                    if sum(b - a + 1 for a, b in own) / n > max_coverage:
                        continue
                texts[i] = cut_words(data, own)
                keep.append(i)
            yield _with_texts(batch, texts, text_col, chars_col).select(schema.names).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(cut, schema)


def _with_texts(batch, texts, text_col, chars_col):
    """The batch with new texts (row -> UTF-8) and their lengths."""
    for column, value in ((text_col, lambda s: s), (chars_col, len)):
        at = batch.schema.get_field_index(column)
        if at >= 0 and texts:
            new = batch.column(at).to_pylist()
            for i, data in texts.items():
                new[i] = value(data.decode("utf-8", "replace"))
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
    return batch


def _cut_one_block(docs, sent, text_col, chars_col, window, max_coverage):
    """decontaminate() for items that fit into one block: each text is cut to its end at once."""

    def cleaned(batches):
        automaton = Automaton(sent.value, window)
        for batch in batches:
            keep, texts, changed = [], {}, False
            for i, data in enumerate(text_bytes(batch.column(text_col))):
                n, spans, _ = automaton.scan(data or b"")
                hit = sum(b - a + 1 for a, b in spans)
                changed = changed or hit > 0
                if n and hit / n > max_coverage:
                    continue
                while spans:
                    data = cut_words(data, spans)
                    _, spans, _ = automaton.scan(data)
                    texts[i] = data
                keep.append(i)
            if not changed:
                yield batch
                continue
            yield _with_texts(batch, texts, text_col, chars_col).take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(cleaned, docs.schema)
