import random

import pytest
from helpers import ascii_lower, collected, components, plain_words
from pyspark.sql import functions as F

from fleetlens.llm import paragraphs as op
from fleetlens.llm.paragraphs import paragraph_classes, repeated_paragraphs, tune_bands
from fleetlens.llm.queries import CASES


def words_of(line):
    return plain_words(ascii_lower(line))


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, least=20):
    """(doc_id, no) of each compared paragraph -> (class members as a frozenset of those)."""
    parts = []
    for at, (doc_id, text) in enumerate(rows):
        lines = [w for line in (text or "").split("\n") if (w := words_of(line))]
        parts += [(at, doc_id, no, w) for no, w in enumerate(lines) if len(w) >= least]
    sets = [shingle_set(p[3]) for p in parts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return parts, components(len(parts), near)


def planted(seed):
    """Paragraphs with copies, near copies, chains of near copies and chance words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    lines = []
    for _ in range(25):
        own = [word() for _ in range(rng.randint(22, 90))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            lines.append(" ".join(own))
            own = list(own)
            own[rng.randrange(len(own))] = word()
    lines += [lines[0].upper(), "short line", "short line", lines[3]]
    rng.shuffle(lines)
    rows, at = [], 0
    while at < len(lines):
        n = rng.randint(1, 4)
        rows.append((len(rows), "\n\n".join(lines[at : at + n])))
        at += n
    return rows


def test_bands_reach_the_recall():
    bands, rows = tune_bands(0.8, 0.999, 12)
    assert bands <= 12 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        tune_bands(0.1, 0.9999, 2)


def test_paragraph_words():
    text = "One two\n\n \n Three\x0bFOUR É\nlast"
    assert list(op.paragraphs(text.encode())) == [[b"one", b"two"], [b"three", b"four", "É".encode()], [b"last"]]
    assert list(op.paragraphs(b"")) == []


@pytest.mark.parametrize("seed,block_rows", [(1, 1024), (2, 1024), (3, 1)])
def test_classes_match_brute_force(spark, seed, block_rows):
    rows = planted(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    parts, comp = brute(rows)
    members = {}
    for p, c in zip(parts, comp, strict=True):
        members.setdefault(c, set()).add((p[1], p[2]))
    expected = {frozenset(m) for m in members.values() if len(m) > 1}
    _, found = paragraph_classes(docs, block_rows=block_rows)
    classes = {}
    for r in found.collect():
        classes.setdefault(r["class_id"], []).append(r)
    got = {frozenset((r["doc_id"], r["no"]) for r in own) for own in classes.values()}
    assert got == expected
    for own in classes.values():
        assert [(r["doc_id"], r["no"]) for r in own if r["stays"]] == [min((r["doc_id"], r["no"]) for r in own)]


def test_unsettled_buckets_are_compared_in_blocks(spark):
    """All paragraphs in one bucket: what differs from its first one must still find its own near copies."""
    rows = planted(4)
    own = spark.createDataFrame(rows, "doc_id long, text string")
    table = [(d, no, w) for d, t in rows for no, w in enumerate(op.paragraphs(t.encode())) if len(w) >= 20]
    key = lambda w: int(op.np.uint64(op.xxhash.xxh3_64_intdigest(b" ".join(w))).view(op.np.int64))
    parts = spark.createDataFrame([(d, no, key(w), [1]) for d, no, w in table], "doc_id long, no int, key long, bands array<long>")
    parts = parts.join(own.select("doc_id", F.xxhash64("text").alias("at")), "doc_id")
    links = {(r["a"], r["b"]) for r in op.paragraph_links(own, parts, block_rows=5).collect()}
    keys = sorted({key(w) for _, _, w in table})
    sets = {key(w): shingle_set(w) for _, _, w in table}
    near = lambda a, b: len(sets[keys[a]] & sets[keys[b]]) >= 0.8 * len(sets[keys[a]] | sets[keys[b]])
    linked = lambda a, b: (keys[a], keys[b]) in links or (keys[b], keys[a]) in links
    assert components(len(keys), linked) == components(len(keys), near)


def test_documents(docs, doc_rows, no_docs):
    parts, comp = brute([(r[0], r[1]) for r in doc_rows])
    size = {c: comp.count(c) for c in comp}
    repeated = [0] * len(doc_rows)
    for p, c in zip(parts, comp, strict=True):
        repeated[p[0]] += size[c] > 1
    n = [sum(bool(words_of(x)) for x in (r[1] or "").split("\n")) for r in doc_rows]
    got = repeated_paragraphs(docs)
    assert collected(got.select("doc_id", "n_paragraphs", "n_repeated")) == sorted(
        ((r[0], k, x) for r, k, x in zip(doc_rows, n, repeated, strict=True)), key=repr)
    classes = sum(1 for s in size.values() if s > 1)
    total = got.agg(F.sum("n_repeated") - F.sum("n_removed")).first()[0]
    assert total == classes
    assert repeated_paragraphs(no_docs).collect() == []


def test_op4_compares_lines_of_any_length(spark, doc_rows, tmp_path):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(r[0], r[1]) for r in doc_rows] + [(100, "Short line\n}\nnot here"), (101, "}\nshort LINE"), (102, near),
                                               (103, "x\n" + near + " fifteen"), (104, "b c d e\nq r s t u v w")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts, comp = brute(rows, least=1)
    size = {c: comp.count(c) for c in comp}
    repeated, words = [0] * len(rows), [0] * len(rows)
    for p, c in zip(parts, comp, strict=True):
        repeated[p[0]] += size[c] > 1
        words[p[0]] += len(p[3]) * (size[c] > 1)
    total = [sum(len(words_of(x)) for x in (r[1] or "").split("\n")) for r in rows]
    got = CASES["op4_paragraph_minhash"][0](spark, str(tmp_path))
    assert collected(got.select("doc_id", "n_repeated", "n_words", "n_repeated_words")) == sorted(
        ((r[0], a, b, c) for r, a, b, c in zip(rows, repeated, total, words, strict=True)), key=repr)
    assert {r["doc_id"]: r["n_repeated"] for r in got.where("doc_id >= 100").collect()} == {100: 2, 101: 2, 102: 1, 103: 1, 104: 0}


def test_windows_of_shared_runs_are_equal():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    for n in range(200):
        run = [word() for _ in range(32)] if n % 5 else [word()] * 32
        a, b = ([word() for _ in range(rng.randint(0, 60))] + run + [word() for _ in range(rng.randint(0, 60))] for _ in "ab")
        keys = [set(op.passages(op.word_hashes([w.encode() for w in x]))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]
    # the same places whatever the pieces
    long = op.word_hashes([word().encode() for _ in range(5000)])
    whole = op.passages(long)[0].tolist()
    size, op._PASSAGE_PIECE = op._PASSAGE_PIECE, 100
    try:
        assert op.passages(long)[0].tolist() == whole
    finally:
        op._PASSAGE_PIECE = size


def test_passages_are_found_inside_lines_and_over_line_breaks(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    words = lambda n: [word() for _ in range(n)]
    shared, other, twice = words(55), words(54), words(40)
    broken = other[:17] + ["\n"] + other[17:35] + ["\n"] + other[35:]
    rows = [(1, " ".join(words(40) + shared + words(30))), (2, " ".join(words(60) + shared + words(50))),
            (3, " ".join(words(25) + broken + words(25))), (4, " ".join(words(35) + other + ["\n"] + words(5))),
            (5, " ".join(words(200))), (6, " ".join(words(9) + twice + words(30) + twice + words(9))), (7, None)]
    got = {r["doc_id"]: r for r in repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["first_doc_ids"] for i, r in got.items()} == {1: [1], 2: [1], 3: [3], 4: [3], 5: [], 6: [6], 7: []}
    assert set(got[1]["class_ids"]) & set(got[2]["class_ids"]) and set(got[3]["class_ids"]) & set(got[4]["class_ids"])
    for i, most in ((1, 55), (2, 55), (3, 54), (4, 54), (6, 80)):
        assert got[i]["repeated"] and got[i]["n_repeated"] == 0 and 20 <= got[i]["n_passage_words"] <= most
    assert not got[5]["repeated"] and got[5]["n_passage_words"] == got[7]["n_passage_words"] == 0
