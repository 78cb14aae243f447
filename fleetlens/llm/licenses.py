"""License scan with ordered signature rules.

A rule is a regular expression over the words of a text (lower-cased A-Z, joined by one blank), with a keyword without
which it can't match, a priority and a score. A text is searched for the keywords first; only the rules of those that it
has are tried. A detection that lies within another of higher priority, or of the same and longer, is dropped.
"""

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm.common import ALNUM, pieces, text_bytes

# words of a match at most; matches are looked for in pieces that overlap by so many words
MATCH_WORDS = 64

#: phrase -> label; places of these are counted, and their labels always stay
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label -> (names, versions or SPDX suffixes); the names are words as they stand in normalised text
FAMILIES = {
    "gpl": (("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3", "1 0", "2 0", "3 0")),
    "lgpl": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"),
             ("2", "2 1", "3", "3 0")),
    "agpl": (("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"),
             ("1", "1 0", "3", "3 0")),
    "gfdl": (("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    "apache": (("apache license", "apache software license", "apache"), ("1 0", "1 1", "2", "2 0")),
    "mit": (("mit license", "mit x11 license", "expat license", "mit"), ("0",)),
    "bsd": (("bsd license", "berkeley software distribution license", "bsd"), ("2 clause", "3 clause", "4 clause")),
    "mpl": (("mozilla public license", "mpl"), ("1 0", "1 1", "2 0")),
    "epl": (("eclipse public license", "epl"), ("1 0", "2 0")),
    "edl": (("eclipse distribution license", "edl"), ("1 0",)),
    "cddl": (("common development and distribution license", "cddl"), ("1 0", "1 1")),
    "cpl": (("common public license",), ("0 5", "1 0")),
    "ipl": (("ibm public license",), ("1 0",)),
    "artistic": (("artistic license", "perl artistic license"), ("1 0", "2 0")),
    "zlib": (("zlib license", "zlib libpng license", "zlib"), ()),
    "isc": (("isc license", "internet software consortium license", "isc"), ()),
    "boost": (("boost software license", "bsl"), ("1 0",)),
    "unlicense": (("unlicense",), ()),
    "wtfpl": (("do what the fuck you want to public license", "wtfpl"), ("1", "2")),
    "cc0": (("creative commons zero", "cc0"), ("1 0",)),
    "cc-by": (("creative commons attribution license", "creative commons attribution", "cc by"),
              ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-sa": (("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"),
                 ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc": (("creative commons attribution noncommercial", "creative commons attribution non commercial",
                  "cc by nc"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nd": (("creative commons attribution noderivatives", "creative commons attribution no derivatives",
                  "cc by nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-sa": (("creative commons attribution noncommercial sharealike", "cc by nc sa"),
                    ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-nd": (("creative commons attribution noncommercial noderivatives", "cc by nc nd"),
                    ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "odbl": (("open database license", "odbl"), ("1 0",)),
    "odc-by": (("open data commons attribution license", "odc by"), ("1 0",)),
    "pddl": (("open data commons public domain dedication and license", "pddl"), ("1 0",)),
    "ofl": (("sil open font license", "open font license", "ofl"), ("1 0", "1 1")),
    "psf": (("python software foundation license", "psf license", "psf"), ("2", "2 0")),
    "php": (("php license",), ("3 0", "3 01")),
    "ruby": (("ruby license",), ()),
    "postgresql": (("postgresql license",), ()),
    "openssl": (("openssl license",), ()),
    "ms-pl": (("microsoft public license", "ms pl"), ()),
    "ms-rl": (("microsoft reciprocal license", "ms rl"), ()),
    "afl": (("academic free license", "afl"), ("2 0", "2 1", "3 0")),
    "osl": (("open software license", "osl"), ("1 0", "2 0", "2 1", "3 0")),
    "eupl": (("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2")),
    "ecl": (("educational community license", "ecl"), ("1 0", "2 0")),
    "upl": (("universal permissive license", "upl"), ("1 0",)),
    "ncsa": (("university of illinois ncsa open source license", "ncsa"), ()),
    "qpl": (("q public license", "qpl"), ("1 0",)),
    "sspl": (("server side public license", "sspl"), ("1", "1 0")),
    "busl": (("business source license", "busl"), ("1 0", "1 1")),
    "elastic": (("elastic license",), ("1 0", "2 0")),
    "lppl": (("latex project public license", "lppl"), ("1 0", "1 1", "1 2", "1 3c")),
    "vim": (("vim license",), ()),
    "w3c": (("w3c software notice and license", "w3c license"), ()),
    "mulan": (("mulan permissive software license", "mulan psl"), ("1", "2")),
    "blueoak": (("blue oak model license", "blueoak"), ("1 0 0",)),
}

#: (label, regex over words, keyword, priority, score): sentences of license texts and notices
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 95, 1.0),
    ("mit", "the software is provided as is without warranty of any kind", "provided as is", 40, 0.5),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 95, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution", 95, 1.0),
    ("bsd", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "neither the name", 90, 0.9),
    ("apache", "unless required by applicable law or agreed to in writing", "required by applicable law", 90, 0.9),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance", 90, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it", "free software", 95, 1.0),
    ("gpl", "either version [0-9] of the license or at your option any later version", "any later version", 85, 0.8),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "free software", 95, 1.0),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "source code form", 95, 1.0),
    ("epl", "this program and the accompanying materials are made available under", "accompanying materials", 80, 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 95, 1.0),
    ("boost", "permission is hereby granted free of charge to any person or organization", "hereby granted", 95, 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is", 85, 0.9),
    ("wtfpl", "you just do what the fuck you want to", "you just do", 90, 0.9),
    ("cc0", "waived all copyright and related or neighboring rights", "neighboring rights", 90, 0.9),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 70, 0.8),
    ("proprietary", "all rights reserved", "all rights reserved", 30, 0.4),
    ("proprietary", "unauthorized (?:copying|reproduction|distribution)(?: [^ ]+){0,8} is (?:strictly )?prohibited",
     "unauthorized", 60, 0.7),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 20, 0.3),
]

_NOTICE = ("(?:licensed|released|distributed|available|provided|published|redistributed|covered) under "
           "(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?")


class Rule(NamedTuple):
    label: str
    name: str
    regex: re.Pattern
    keyword: bytes
    priority: int
    score: float


def _rule(label, name, text, keyword, priority, score):
    return Rule(label, name, re.compile(f"(?<![^ ])(?:{text})(?![^ ])".encode()), keyword.encode(), priority, score)


@lru_cache(maxsize=1)
def rules():
    """All rules in order of priority: five forms of each name, one per version, and the sentences."""
    out = []
    for label, (names, versions) in FAMILIES.items():
        for name in names:
            tail = "" if name.split()[-1] in ("license", "licence", "unlicense") else " licen[cs]e"
            out.append(_rule(label, f"{name}: notice", f"{_NOTICE}{name}(?: licen[cs]e)?", name, 80, 1.0))
            out.append(_rule(label, f"{name}: identifier", f"spdx license identifier {name}(?: [0-9][^ ]*)*"
                             f"(?: only| or later)?", name, 100, 1.0))
            out.append(_rule(label, f"{name}: name", f"{name}{tail}", name, 50, 0.8))
            out.append(_rule(label, f"{name}: field", f"licen[cs]e (?:is |type |name |id )?(?:the )?{name}", name, 55, 0.9))
            for version in versions:
                number = f"(?:version |v )?v?{version}" if version[0].isdigit() else version
                out.append(_rule(label, f"{name}: {version}", f"{name}(?: licen[cs]e)? {number}", name, 60, 0.9))
                out.append(_rule(label, f"{name}: notice {version}", f"{_NOTICE}{name}(?: licen[cs]e)? {number}", name, 85, 1.0))
    for i, (label, text, keyword, priority, score) in enumerate(SENTENCES):
        out.append(_rule(label, f"sentence {i}", text, keyword, priority, score))
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(maxsize=1)
def _by_keyword():
    """keyword -> its rules; a keyword that contains another stands behind it."""
    out = {}
    for rule in rules():
        out.setdefault(rule.keyword, []).append(rule)
    # any match of a keyword has its first word; those are few, and most texts have none of them
    first = sorted({k.split()[0] for k in out} | {p.split()[0].encode() for p in BASE})
    return out, re.compile(b"(?<![^ ])(?:" + b"|".join(map(re.escape, first)) + b")(?![^ ])")


_BASE = [
    (label, phrase.encode(), re.compile(f"(?<![^ ]){phrase}(?![^ ])".encode())) for phrase, label in BASE.items()
]


def _search(joined):
    """Base places (label, from, to) and detections (rule, from, to) in one piece, by byte."""
    groups, gate = _by_keyword()
    if not gate.search(joined):
        return [], []
    base = [(label, m.start(), m.end()) for label, phrase, regex in _BASE if phrase in joined
            for m in regex.finditer(joined)]
    found = [(rule, m.start(), m.end()) for keyword, own in groups.items() if keyword in joined
             for rule in own for m in rule.regex.finditer(joined)]
    return base, found


def resolve(found):
    """The detections (rule, first, last) that stay: of equal intervals the one that is first by priority and name, and
    none that lies within one of higher priority or within a longer one of the same priority."""
    best = {}
    for d in found:
        old = best.get(d[1:])
        if old is None or (-d[0].priority, d[0].label, d[0].name) < (-old[0].priority, old[0].label, old[0].name):
            best[d[1:]] = d
    kept, active = [], []
    # what holds an interval starts before it, or at the same word and reaches further
    for d in sorted(best.values(), key=lambda d: (d[1], -d[2])):
        rule, first, last = d
        active = [k for k in active if k[2] >= first]
        weight = rule.priority, last - first
        if not any(last <= k[2] and (k[0].priority, k[2] - k[1]) > weight for k in active):
            active.append(d)
            kept.append(d)
    return kept


def scan(data):
    """(number of words, base places, detections) of a text in UTF-8; places and detections by word, first and last."""
    total, carry, base, found = 0, [], [], []
    parts = pieces(data, ALNUM)
    words = next(parts, [])
    while words is not None:
        following = next(parts, None)
        words = carry + words
        joined = b" ".join(words)
        base_here, found_here = _search(joined)
        open_from = len(words) if following is None else max(0, len(words) - MATCH_WORDS)
        if base_here or found_here:
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])
            for here, out in ((base_here, base), (found_here, found)):
                for what, low, high in here:
                    first = int(np.searchsorted(starts, low))
                    last = int(np.searchsorted(starts, high)) - 1
                    if first < open_from:
                        out.append((what, total + first, total + last))
        carry = words[open_from:]
        total += open_from
        words = following
    return total, sorted(base, key=lambda b: (b[1], b[0])), resolve(found)


_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label: string, rule: string, first: long, last: long>>"
)


def scan_licenses(docs, id_col="doc_id", text_col="text"):
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    The score is that of the best detection that stays (base places count as the rule of their name), 0 without one. A
    null text is empty. Repeated rows give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scanned(batches):
        for batch in batches:
            out = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                                         "detections")}
            for data in text_bytes(batch.column("text")):
                n, base, found = scan(data or b"")
                starts = [first for _, first, _ in base]
                own = {label for label, _, _ in base}
                out["n_words"].append(n)
                out["n_base"].append(len(base))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {d[0].label for d in found})))
                out["score"].append(max([d[0].score for d in found] + [0.8] * bool(base), default=0.0))
                out["detections"].append(
                    [{"label": r.label, "rule": r.name, "first": a, "last": b} for r, a, b in found]
                )
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([
                ("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]
            columns = [pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"doc_id {kind}, {_SCHEMA}")
