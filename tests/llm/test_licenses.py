import random

from helpers import alnum_words, collected

from fleetlens.llm import common, licenses
from fleetlens.llm.licenses import BASE, resolve, rules, scan, scan_licenses

TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under CC-BY 4.0 or CC BY-SA 3.0",
    "GNU General Public License, version 3. GNU general public\nlicense", "the mit license; MIT  License and mitlicense",
    "SPDX-License-Identifier: MPL-2.0", "All rights reserved. Copyright (c) 2019 X", "cc by cc by cc", "nothing at all", "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "xapache license apache licensex",
]


def brute_base(text):
    words = alnum_words(text)
    return sorted((i, label) for phrase, label in BASE.items() for i in range(len(words))
                  if words[i : i + len(phrase.split())] == phrase.split())


def brute_detections(text):
    """Each rule over the whole text without a gate, and each pair of detections compared."""
    words = alnum_words(text)
    joined = " ".join(words).encode()
    found = []
    for rule in rules():
        for m in rule.regex.finditer(joined):
            first = joined[: m.start()].count(b" ")
            found.append((rule, first, first + m.group().count(b" ")))
    order = lambda d: (-d[0].priority, d[0].label, d[0].name)
    found = [d for d in found if not any(e[1:] == d[1:] and order(e) < order(d) for e in found)]
    return sorted((d[0].label, d[1], d[2]) for d in found if not any(
        e[1] <= d[1] and d[2] <= e[2] and (e[0].priority, e[2] - e[1]) > (d[0].priority, d[2] - d[1]) for e in found))


def test_rules():
    assert len(rules()) > 300
    assert [r.priority for r in rules()] == sorted((r.priority for r in rules()), reverse=True)


def test_scan_matches_brute_force():
    rng = random.Random(6)
    texts = TEXTS + [" ".join(rng.choice(TEXTS + ["x y z"] * 3) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    for text in texts:
        n, base, found = scan(text.encode())
        assert n == len(alnum_words(text))
        assert sorted((first, label) for label, first, _ in base) == brute_base(text)
        assert sorted((r.label, a, b) for r, a, b in found) == brute_detections(text)


def test_pieces_of_long_texts_give_the_same(monkeypatch):
    rng = random.Random(7)
    text = " ".join(rng.choice(TEXTS + ["lorem ipsum"] * 9) for _ in range(3000))
    whole = scan(text.encode())
    defaults = common.pieces.__defaults__
    monkeypatch.setattr(common.pieces, "__defaults__", (2000,))
    assert scan(text.encode()) == whole
    assert defaults == (common.PIECE_BYTES,)


def test_containment():
    rule = lambda name, priority: licenses._rule("x", name, "a", "a", priority, 1.0)
    low, high = rule("low", 10), rule("high", 90)
    assert resolve([(low, 2, 3), (high, 0, 5)]) == [(high, 0, 5)]
    assert resolve([(low, 0, 5), (high, 2, 3)]) == [(low, 0, 5), (high, 2, 3)]
    assert resolve([(low, 0, 3), (low, 1, 3), (low, 2, 6)]) == [(low, 0, 3), (low, 2, 6)]
    assert resolve([(low, 0, 3), (high, 0, 3)]) == [(high, 0, 3)]


def test_documents(docs, doc_rows, no_docs):
    rows = scan_licenses(docs).collect()
    expected = []
    for row in doc_rows:
        base = brute_base(row[1])
        starts = [i for i, _ in base]
        expected.append((row[0], len(alnum_words(row[1])), len(base), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted({x for _, x in base}))))
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted(expected, key=repr)
    for r in rows:
        labels = {d["label"] for d in r["detections"]} | set(filter(None, r["base_labels"].split(",")))
        assert r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(labels)
    assert scan_licenses(no_docs).collect() == []
    assert collected(scan_licenses(docs.repartition(2))) == sorted(map(tuple, rows), key=repr)
