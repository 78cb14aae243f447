import random
from zlib import crc32

import numpy as np
import pytest
from helpers import collected

from fleetlens.llm import language_id as op
from fleetlens.llm.language_id import Identifier, Vectors, identify_languages, keep_identified, learn, trigram_pieces

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["sch", "lü", "ent"], "cc": ["éa", "oui", "ble"], "dd": ["жи", "ра", "ко"]}


def prose(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def prose_docs(spark):
    rng = random.Random(2)
    rows = [(i, prose(lang := rng.choice(list(SYLLABLES)), rng, rng.randint(1, 200)), lang, lang) for i in range(300)]
    rows += [(1000, None, "aa", None), (1001, "123 ...", "bb", None), (1002, prose("cc", rng, 50), None, "cc"),
             (None, prose("aa", rng, 50), "bb", "aa"), (1003, "", "cc", None), (1004, prose("bb", rng, 300_000), "bb", "bb")]
    rows.append(rows[0])
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, truth string, score int")


def test_trigrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Ab  cé, 12 ж\n" * 50
    whole = np.concatenate(list(trigram_pieces(text.encode())))
    monkeypatch.setattr(op, "_PIECE", 7)
    assert np.array_equal(np.concatenate([p for p in trigram_pieces(text.encode()) if p.size]), whole)
    assert sum(p.size for p in trigram_pieces(b"12 .. \n")) == 0 and list(trigram_pieces(b"")) == []


def test_scores_are_cosines_of_bundled_vectors():
    rng = random.Random(4)
    vectors = Vectors()
    bundle = lambda t: sum(vectors.bind(p).astype(float).sum(0) for p in trigram_pieces(t.encode()))
    texts = [prose(k, rng, 80) for k in SYLLABLES]
    unit = np.stack([bundle(t) / np.linalg.norm(bundle(t)) for t in texts])
    unit -= unit.mean(0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    asked = [prose(rng.choice(list(SYLLABLES)), rng, rng.randint(1, 60)) for _ in range(600)] + ["", "1"]
    found = list(Identifier(list(SYLLABLES), unit.astype(np.float32)).identify([t.encode() for t in asked] + [None]))
    for text, (lang, score) in zip(asked[:600], found[:600], strict=True):
        cosines = unit @ bundle(text) / np.linalg.norm(bundle(text))
        assert cosines[list(SYLLABLES).index(lang)] == pytest.approx(cosines.max(), abs=1e-4)
        assert score == pytest.approx(max(0, cosines.max()), abs=1e-4)
    assert found[600:] == [("und", 0.0)] * 3


def test_held_out_accuracy_and_edge_cases(prose_docs):
    rows = identify_languages(prose_docs).collect()
    truth = {r["doc_id"]: r["truth"] for r in prose_docs.collect()}
    assert len(rows) == 307
    for r in rows:
        held = r["doc_id"] is None or crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if truth[r["doc_id"]] is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 30
    assert collected(identify_languages(prose_docs.repartition(5))) == sorted(map(tuple, rows), key=repr)


def test_held_out_rows_teach_nothing(prose_docs):
    names, profiles = learn(prose_docs.where(~op._held_out("doc_id")))
    changed = prose_docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz zz' "
                                    "ELSE text END AS text", "lang")
    again = learn(changed.where(~op._held_out("doc_id")))
    assert names == again[0] and np.array_equal(profiles, again[1])


def test_keeping(prose_docs, no_docs, docs):
    kept = keep_identified(prose_docs)
    assert kept.columns == prose_docs.columns
    assert {r["doc_id"] for r in prose_docs.collect()} - {r["doc_id"] for r in kept.collect()} == {1000, 1001, 1003}
    assert identify_languages(no_docs).collect() == [] and keep_identified(no_docs).collect() == []
    unlabelled = docs.withColumn("lang", docs["lang"].substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r["lang_pred"] for r in identify_languages(unlabelled).collect()} == {"und"}
    # without any label there is nothing to reject by: all texts with a letter stay
    lettered = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert keep_identified(unlabelled).count() == len(lettered)
    assert keep_identified(unlabelled, languages=["aa"]).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 50])
def test_scores_do_not_depend_on_batches(prose_docs, parts, monkeypatch):
    want = collected(identify_languages(prose_docs))
    assert collected(identify_languages(prose_docs.repartition(parts))) == want


def test_every_letter_has_a_vector_of_its_own():
    rng = random.Random(6)
    texts = ["".join(rng.choice("漢字仮名交文日本語書") for _ in range(60)), "".join(rng.choice("한국어문장을쓴다말") for _ in range(60)), "mixed ж漢é text"]
    joined = np.concatenate([p for t in texts for p in trigram_pieces(t.encode())])
    used, at = op.distinct(joined)
    assert np.array_equal(used[at], joined) and np.array_equal(used, np.unique(joined))
    vectors = Vectors()
    letters = np.stack([vectors.letter(int(op._symbol_of()[ord(c)])) for c in "漢字仮名交文日本語書abжé"]).astype(int)
    near = letters @ letters.T / vectors.dimensions
    assert np.all(np.diag(near) == 1) and np.abs(near - np.eye(len(letters))).max() < 0.2
    assert np.array_equal(vectors.of(used), vectors.bind(used))


def test_sample_tables(spark):
    """Held-out accuracy on the sample documents."""
    folder = "/root/testdata/sf0.001"
    rows = identify_languages(spark.read.parquet(f"{folder}/documents.parquet"))
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in rows.collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
