import random

import pytest
from helpers import alnum_words, ascii_lower, collected

from fleetlens.llm.decontaminate import Automaton, benchmark_hits, cut_words, decontaminate, item_blocks


def brute(words, items, window=10):
    hit, names = set(), set()
    for name, own in items:
        k = min(window, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else ()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                names.add(name)
    return hit, names


@pytest.mark.parametrize("seed", range(12))
def test_automaton_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abc" if seed % 2 else "abcdefgh")
    items = [(str(i), [word() for _ in range(rng.randint(0, 14))]) for i in range(12)]
    automaton = Automaton([(n, [w.encode() for w in ws], True) for n, ws in items], 5)
    for _ in range(20):
        words = [word() for _ in range(rng.randint(0, 60))]
        n, spans, names = automaton.scan(" ".join(words).encode())
        hit, expected = brute(words, items, 5)
        assert n == len(words)
        assert {i for a, b in spans for i in range(a, b + 1)} == hit
        assert names == expected


def items_table(spark, rows, doc_rows):
    long_text = next(t for _, t, *_ in doc_rows if t and len(t) > 20_000)
    words = long_text.split()
    rows = [*rows, (1, " ".join(words[100:125]), "x"), (2, " ".join(words[3000:3300]), None), (2, "alpha beta", None)]
    return rows, spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def test_hits_match_brute_force_for_blocks_of_any_size(spark, docs, doc_rows):
    base = doc_rows[60][1]
    rows, items = items_table(spark, [(5, base[40:300], "y"), (7, None, None), (8, "?!", None), (None, "x1 42 x1", "z")],
                              doc_rows)
    plain = [("" if i is None else str(i), alnum_words(t)) for i, t, _ in rows]
    expected = []
    for row in doc_rows:
        words = alnum_words(row[1])
        hit, names = brute(words, plain)
        expected.append((row[0], len(words), len(hit), sorted(names)))
    for block_words in (50_000, 60):
        got = [(r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"])
               for r in benchmark_hits(docs, items, block_words=block_words).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_no_items_and_no_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["items"] == [] and r["spans"] == [] for r in benchmark_hits(docs, none).collect())
    assert benchmark_hits(docs, none).where("n_words > 0").count() > 50
    assert benchmark_hits(no_docs, none).collect() == []
    assert collected(decontaminate(docs, none)) == collected(docs)


def test_long_items_are_cut_with_overlap(spark):
    words = [f"w{i}" for i in range(100)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    blocks = list(item_blocks(items, window=10, block_words=30))
    windows = {tuple(ws[i : i + 10]) for b in blocks for _, ws, _ in b for i in range(len(ws) - 9)}
    assert windows == {tuple(w.encode() for w in words[i : i + 10]) for i in range(91)}
    assert all(sum(len(ws) for _, ws, _ in b) <= 60 for b in blocks)


def test_cutting_leaves_no_hit_and_clean_documents_alone(spark, docs, doc_rows):
    base = doc_rows[60][1]
    rows, items = items_table(spark, [(5, base[40:400], "y")], doc_rows)
    plain = [(str(i), alnum_words(t)) for i, t, _ in rows if i != 2 or len(t) > 20]
    items = items.where("text <> 'alpha beta'")
    left = decontaminate(docs, items, max_coverage=0.3)
    assert left.columns == docs.columns and left.schema == docs.schema
    before = {}
    for row in doc_rows:
        before.setdefault((row[0], row[1]), row)
    for row in left.collect():
        hit, _ = brute(alnum_words(row["text"]), plain)
        assert not hit
        if row["n_chars"] is not None and row["text"] is not None and row["doc_id"] is not None:
            assert row["n_chars"] == len(row["text"])
    clean = [r for r in doc_rows if not brute(alnum_words(r[1]), plain)[0]]
    assert {(r[0], r[1]) for r in clean} <= {(r["doc_id"], r["text"]) for r in left.collect()}
    gone = [r for r in doc_rows if (w := alnum_words(r[1])) and len(brute(w, plain)[0]) / len(w) > 0.3]
    assert gone and not {r[0] for r in gone if r[0] is not None} & {r["doc_id"] for r in left.collect()}


def test_block_size_changes_no_decision(spark):
    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b, c, filler = word("a", 40), word("b", 40), word("c", 12), word("f", 60)
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "item_id long, text string")
    rows = [
        (1, " ".join([*a, *filler[:20], *b]), 7),  # 40% of one block and 40% of another: goes
        (2, " ".join([*filler, *c[:6], *b[:12], *c[6:]]), 7),  # cutting b joins an item of another block
        (3, " ".join([*filler, *b[:6], *a[:12], *b[6:12]]), 7),
        (4, " ".join(filler), 7), (5, None, None),
    ]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, n_chars long, _hit_spans string")
    one = collected(decontaminate(docs, items))
    assert [r[0] for r in one] == [2, 3, 4, 5] and {r[3] for r in one} == {"kept"}
    plain = [("1", a), ("2", b), ("3", c)]
    assert not any(brute(alnum_words(r[1]), plain)[0] for r in one)
    for block_words in (20, 45):
        left = decontaminate(docs, items, block_words=block_words)
        assert left.columns == docs.columns and collected(left) == one


def test_cut_words():
    assert cut_words("Ein, zwei! drei; vier".encode(), [[1, 2]]) == b"Ein, ; vier"
    assert cut_words(b"a b c", [[0, 0], [2, 2]]) == b" b "
    assert ascii_lower("ÀB") == "Àb"
