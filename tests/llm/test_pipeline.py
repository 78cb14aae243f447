"""The pipeline stage by stage on small documents, each against brute force on its own input."""

import os
import random

import pytest
from helpers import alnum_words, ascii_lower, components, plain_words
from test_decontaminate import brute as benchmark_brute
from test_mixing import brute_targets, source_sizes
from test_simhash import brute_fingerprint

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm.common import with_places
from fleetlens.llm.queries import CASES
from fleetlens.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, over the smallest sample with some planted rows."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    text = docs.where("doc_id = 12").first()["text"]
    item = items.orderBy("item_id").first()["text"]
    planted = [(900, None, "en", "s", 0), (901, "12 %%", "en", None, 5), (902, text, "en", "s", None), (903, text.upper(), "en", "s", 1),
               (904, text + " end", "en", "s", 2), (905, item, "es", "s", 3), (906, text[:900] + "\n" + item + "\n" + text[900:] * 3, "en", "s", 9)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    out, frame = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, frame, str(folder))
        result.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, frame.collect(), after.collect(), after.columns))
        frame = after
    return {name: (before, after, columns) for name, before, after, columns in out}, items.collect(), str(folder)


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_columns(stages):
    for name, (_, _, columns) in stages[0].items():
        assert name == "mixing" or columns == COLUMNS


def test_language(stages):
    before, after, _ = stages[0]["language_id"]
    assert ids(before) - ids(after) == {900, 901}


def test_exact_dedup(stages):
    before, after, _ = stages[0]["exact_dedup"]
    keep = {}
    for r in before:
        keep[ascii_lower(r["text"])] = max(r["doc_id"], keep.get(ascii_lower(r["text"]), -1))
    assert ids(after) == set(keep.values()) and 903 in keep.values()


def shingles5(text):
    words = plain_words(ascii_lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_dedup(stages):
    before, after, _ = stages[0]["near_dedup"]
    rows = sorted(before, key=lambda r: r["doc_id"])
    prints, sets = [brute_fingerprint(r["text"]) for r in rows], [shingles5(r["text"]) for r in rows]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
    comp = components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or near(a, b))
    assert ids(after) == {rows[c]["doc_id"] for c in comp}


def test_near_copies_are_found(spark):
    """At least 0.9 of the pairs with a Jaccard coefficient of 0.8 or a little more."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(60):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in range(7, 300, 50 if i % 2 else 60):
            copy[at] = word()
        rows += [(2 * i, " ".join(base[:150]) + "\n" + " ".join(base[150:])), (2 * i + 1, " ".join(copy))]
    pairs = [i for i in range(60) if 5 * len(shingles5(rows[2 * i][1]) & shingles5(rows[2 * i + 1][1])) >=
             4 * len(shingles5(rows[2 * i][1]) | shingles5(rows[2 * i + 1][1]))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = ids(corpus_pipeline.near_dedup_stage(spark, frame, "").collect())
    assert len(pairs) > 50 and {2 * i for i in range(60)} <= left
    assert sum(2 * i + 1 not in left for i in pairs) >= 0.9 * len(pairs)


def test_clashing_columns_empty_tables_and_no_labels(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _row string, _hit_spans int, kept_row int"
    text = "some words of a text that is long enough to be read twice"
    rows = [(1, text, None, "s", 1, "r", "u", 3, 4), (2, text.upper(), None, "s", 1, "r", "u", 3, 4), (3, "123", None, None, 1, "r", "u", 3, 4),
            (4, "other words", None, None, 1, "r", "u", 3, 4)]
    spark.createDataFrame([(1, "not in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data, want in ((rows, {2, 4}), ([], set())):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "mixing":
                assert out.columns == docs.columns and [tuple(r)[5:] for r in out.collect()] == [("r", "u", 3, 4)] * out.count()
                docs = out
        assert ids(out.collect()) == want


def test_decontamination(stages):
    before, after, _ = stages[0]["decontamination"]
    items = [(str(r["item_id"]), alnum_words(r["text"])) for r in stages[1]]
    left = {r["doc_id"]: r for r in after}
    for r in before:
        words = alnum_words(r["text"])
        hit, _ = benchmark_brute(words, items)
        if not hit:
            assert left[r["doc_id"]] == r
        elif len(hit) > 0.5 * len(words):
            assert r["doc_id"] not in left
        else:
            kept = left[r["doc_id"]]
            own = alnum_words(kept["text"])
            assert not benchmark_brute(own, items)[0] and kept["n_chars"] == len(kept["text"])
            assert len(own) <= len(words) - len(hit)
    assert 905 not in left and 906 in left


def test_mixing(stages):
    before, after, _ = stages[0]["mixing"]
    sizes = source_sizes([(None, r["text"], None, r["source"]) for r in before])
    targets = brute_targets(sizes)
    assert ids(after) == ids(before)
    for source, target in targets.items():
        assert abs(sum(r["taken"] for r in after if r["source"] == source) - target) <= 65


def test_run_and_registration(spark, stages):
    _, after, columns = stages[0]["mixing"]
    rows = corpus_pipeline.run(spark, stages[2])
    assert rows.columns == columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, after))
    names = [*CASES, "pipeline"]
    assert set(names) <= set(entry.queries())
    assert set(entry.oracle_sql()) & set(names) >= {"op1_decontaminate", "op2_warc", "op9_block_naming"}


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1"]) + str(rng.randint(0, 99)) for _ in range(200))
             for _ in range(6)]
    a, b, c, d, e, f = texts
    planted = [(None, a), (None, a), (None, a.upper()), (None, b), (5, b), (5, b), (5, c), (7, c), (None, d), (9, e), (9, f)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in planted],
                                  "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted([("None", a.lower()), ("5", b), ("7", c), ("None", d), ("9", e), ("9", f)])
    got = corpus_pipeline.exact_dedup_stage(spark, frame, "")
    assert got.columns == COLUMNS and sorted((str(r["doc_id"]), r["text"].lower()) for r in got.collect()) == want
    want = sorted([("None", a.lower()), ("5", b), ("5", c), ("None", d), ("9", e), ("9", f)])
    # here upper and lower case make no difference either, and the smallest id stays
    got = corpus_pipeline.near_dedup_stage(spark, frame, "")
    assert got.columns == COLUMNS and sorted((str(r["doc_id"]), r["text"].lower()) for r in got.collect()) == want


def folder_bytes(folder):
    return sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)


def test_dedup_stages_leave_no_copy_of_a_table_behind(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1500)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1] + " end"), (5, texts[5]), (5, texts[5].upper()), (90, texts[7])]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    frame.write.parquet(f"{tmp_path}/documents")
    table = spark.read.parquet(f"{tmp_path}/documents")
    for stage, gone in ((corpus_pipeline.exact_dedup_stage, {7}), (corpus_pipeline.near_dedup_stage, {90})):
        before = folder_bytes(shared_dir(spark))
        got = stage(spark, table, "")
        assert got.columns == COLUMNS
        got = sorted((str(r["doc_id"]), r["text"].lower()) for r in got.collect())
        assert folder_bytes(shared_dir(spark)) - before < 0.5 * folder_bytes(f"{tmp_path}/documents")
        nulls = 1 if stage is corpus_pipeline.exact_dedup_stage else 0
        assert [i for i, _ in got].count("None") == nulls and [i for i, _ in got].count("5") == 1
        assert {i for i, _ in got} - {"None"} == {str(i) for i in [*range(80), 90] if i not in gone}
        # a frame that is no table gives the same rows
        assert got == sorted((str(r["doc_id"]), r["text"].lower()) for r in stage(spark, frame, "").collect())


def test_places_are_for_plain_tables_only(spark, tmp_path):
    frame = spark.createDataFrame([(i, "t") for i in range(50)], "doc_id long, _metadata string").repartition(4)
    frame.write.parquet(f"{tmp_path}/a")
    frame.write.json(f"{tmp_path}/b")
    table = spark.read.parquet(f"{tmp_path}/a")
    places = [with_places(spark.read.parquet(f"{tmp_path}/a"), "row").select("doc_id", "row").collect() for _ in range(2)]
    assert sorted(places[0]) == sorted(places[1]) and len({r["row"] for r in places[0]}) == 50
    for other in (frame, table.limit(9), table.sample(0.5), table.where("doc_id > 3"), table.union(table), table.crossJoin(spark.range(2)),
                  spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/a"), spark.read.schema(frame.schema).json(f"{tmp_path}/b")):
        assert with_places(other, "row") is None
