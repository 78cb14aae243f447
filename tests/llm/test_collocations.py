import random
import re
from collections import Counter

import pytest
from helpers import ascii_lower, collected
from pyspark.sql import functions as F

from fleetlens.llm import collocations as op
from fleetlens.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, n long, piece string, h1 string, word string"


def brute(rows, least=10, longest=3, percent=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    found = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    out = []
    for lang in totals:
        mine = []
        for (own, w), a in found.items():
            inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            if own != lang or any(o == lang and len(v) > len(w) and 100 * b >= percent * a and inside(v) for (o, v), b in found.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = counts[lang, w[:k]], counts[lang, w[k:]]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, k, left, right = min(cuts)
            mine.append((score, a, " ".join(w), left, right, k))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, totals[lang], s, len(p.split(" ")), k)
                for i, (s, a, p, left, right, k) in enumerate(mine[:top], 1)]
    return sorted(out, key=repr)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["new", "York", "san", "francisco", "été", "a", "of", "x.", "the", "\x1cq", "漢"]
    mark = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b", " ;"])
    rows = []
    for i in range(n):
        text = "".join(rng.choice(["New York city ", "san francisco", rng.choice(words)]) + mark() for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), None, "p", "h", "w"))
    rows += [(None, None, "fr", 1, None, None, None), (900, "", "fr", 1, None, None, None), (901, "aa " * 4000, "es", 1, None, None, None)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("seed,settings", [
    (1, {}), (2, {"broadcast_rows": 0}), (3, {"min_count": 3, "max_words": 5, "contained_percent": 80, "top": 7}),
    (4, {"max_words": 2, "bucket_words": 500}),
])
def test_matches_brute_force(spark, seed, settings):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations(docs, **settings)
    want = brute(rows, settings.get("min_count", 10), settings.get("max_words", 3), settings.get("contained_percent", 50),
                 settings.get("top", 2000))
    assert collected(got) == want and len(want) > 5


def test_settings_are_put_back_and_relations_dropped(spark, docs):
    before = {k: spark.conf.get(k) for k in op._MERGE_SETTINGS}
    tables = {t.name for t in spark.catalog.listTables()}
    collocations(docs).collect()
    assert {k: spark.conf.get(k) for k in op._MERGE_SETTINGS} == before
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_merge_join_has_no_shuffle(spark, docs):
    words, seed = op.count_words(docs)
    rows = op.words_of(op.pieces_of(docs).repartition(3, "piece")).select("piece", "place", op.word_hash(seed).alias("h1"))
    relation = op._Relation(rows, 1, 3)
    with op._settings(spark, op._MERGE_SETTINGS):
        plan = relation.extended()._jdf.queryExecution().executedPlan().toString()
    relation.drop()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Sort [") <= 1


def test_colliding_hashes_take_another_seed(spark, docs, doc_rows, monkeypatch):
    good = op.word_hash
    monkeypatch.setattr(op, "word_hash", lambda seed: F.pmod(good(seed), F.lit(3)) if seed == 0 else good(seed))
    words, seed = op.count_words(docs)
    assert seed == 1
    plain = [(r[0], r[1], r[2]) for r in doc_rows]
    assert collected(collocations(docs)) == brute(plain)
    monkeypatch.setattr(op, "word_hash", lambda seed: F.lit(1))
    with pytest.raises(ValueError):
        op.count_words(docs)


def test_scores_are_exact_beyond_64_bits(spark):
    a = 10**13
    rows = spark.createDataFrame([([1], 3 * a), ([2], a + 1), ([1, 2], a - 7)], "items array<long>, n long")
    got = op.score_phrases(rows).first()
    assert got["score"] == 1000000 * (a - 7) ** 2 // (3 * a * (a + 1))


def test_no_documents(no_docs):
    assert collocations(no_docs).collect() == []
    with pytest.raises(ValueError):
        collocations(no_docs, max_words=1)


def test_text_is_split_once(docs):
    plan = op.words_of(op.pieces_of(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_long_texts_are_cut_at_marks(spark, size):
    rows = [(1, "a B. c d e f g h i j k l,\tm  n\n" * 30 + "é É " * 40, "en"), (2, ".. , !", None), (3, None, "x"), (4, "p.q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = lambda t: [w for p in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(t)) for w in [re.findall(r"[^\x20\x09]+", p)] if w]
    want = Counter((r[2] or "und", *pair) for r in rows for p in own(r[1]) for pair in zip(p, p[1:]))
    found = op.words_of(op.pieces_of(docs, piece_bytes=size)).collect()
    at = {(r["piece"], r["place"]): r for r in found}
    assert len(at) == len(found)
    pairs = Counter((r["lang"], r["word"], at[i, j + 1]["word"]) for (i, j), r in at.items() if (i, j + 1) in at)
    assert pairs == want
    words, _ = op.count_words(docs, piece_bytes=size, distinct=3)
    singles = Counter((r[2] or "und", w) for r in rows for p in own(r[1]) for w in p)
    assert {(r["lang"], r["word"]): r["n"] for r in words.collect()} == singles


def test_contained_phrases_go_at_the_percentage(spark):
    rows = [([1], 90), ([2], 90), ([1, 2], 20), ([2, 1], 21), ([1, 2, 1], 10), ([3, 3], 5)]
    phrases = spark.createDataFrame(rows, "items array<long>, n long")
    got = {(tuple(r["items"]), r["n"]) for r in op.free_phrases(phrases, 50).collect()}
    assert got == {((2, 1), 21), ((1, 2, 1), 10), ((3, 3), 5)}


def test_ties_at_the_end_go_by_phrase(spark):
    rows = [(i, f"x{j} y{j}.", "en") for i in range(3) for j in range(60)]
    got = collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_count=3, top=5)
    assert collected(got) == brute(rows, least=3, top=5)
