import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import collected

from fleetlens.llm import bpe
from fleetlens.llm.queries import CASES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def other():
    """The same ranks in another library."""
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, "rb") as file:
        return bpe.build_tokenizer(bpe.read_ranks(file.read()), PATTERN)


def odd_texts(seed=3, n=400):
    rng = random.Random(seed)
    letters = "aab b\n\t'sS1 -=_é漢\x00  \u0085\x1c🙂é ß٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    texts += [u * k for u in ("a", " ", "\n", "--", "=", "漢", "🙂", "ab") for k in (1, 2, 3, 7, 64, 500)]
    return [*texts, "<|endoftext|> <|startoftext|>", "don't we'll I'M", "x" * 5000 + " \n \n" + "y 1" * 2000]


def test_byte_characters():
    chars = bpe.byte_characters()
    assert len(set(chars)) == 256 and chars[ord("A")] == "A" and chars[0] == "Ā" and chars[ord(" ")] == "Ġ"


@pytest.mark.parametrize("size,most", [(1 << 18, 1 << 17), (50, 3), (1, 1 << 17)])
def test_ids_are_those_of_the_ranks(tokenizer, other, size, most, monkeypatch):
    monkeypatch.setattr(bpe, "_MOST_UNITS", most)
    encoder, fast = bpe.Encoder(tokenizer, True), bpe.Encoder(tokenizer, False)
    texts = odd_texts()
    found, plain = (e.encode([t.encode() for t in texts], size) for e in (encoder, fast))
    for text, own, short in zip(texts, found, plain, strict=True):
        ids, starts, ends = (x.tolist() for x in own)
        assert ids == other.encode_ordinary(text) == short[0].tolist()
        for i, start, end in zip(ids, starts, ends, strict=True):
            assert other.decode_single_token_bytes(i) in text[start:end].encode()
        assert not text or (starts[0] == 0 and ends[-1] == len(text))


def test_units_at_every_kind_of_white_space(tokenizer, other):
    encoder = bpe.Encoder(tokenizer, False)
    for c in [chr(p) for p in range(0x110000) if chr(p).isspace() or p in (0x180E, 0x200B, 0x2060, 0xFEFF)]:
        for text in (f"a{c}b", f"a{c}{c}{c}b!", f"!{c}?{c}", f" {c} x{c} \n{c}y", c, c * 4):
            assert encoder.encode([text.encode()])[0][0].tolist() == other.encode_ordinary(text)


def test_pieces_are_cut_before_white_space():
    text = "ab  cd\n\nef gh" * 30
    for size in (1, 5, 40):
        parts = list(bpe.text_pieces(text, size))
        assert "".join(p for _, p in parts) == text and [at for at, _ in parts] == [text.index(p, at) for at, p in parts]
        assert all(not p[-1].isspace() for _, p in parts[:-1]) and len(parts) > 3


def test_round_trip_and_edge_cases(spark, other):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts(5, 60))]
    rows += [(None, None, "x"), (None, "a b", None), (900, "", "x"), (901, "word " * 300_000, "x"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    encoded = bpe.encode(docs, PATH, PATTERN)
    want = [(i, other.encode_ordinary(t or "")) for i, t, _ in rows]
    assert collected(encoded.select("doc_id", "ids")) == sorted(want, key=repr)
    assert collected(bpe.decode(encoded, PATH).select("doc_id", "text")) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH).collect() == []


def test_split_characters(spark, other):
    ids = other.encode_ordinary("🙂漢x")
    assert len(ids) > 4
    table = bpe._token_bytes("t", type("S", (), {"value": open(PATH, "rb").read()}))
    texts = bpe.token_texts(table, ids)
    assert "".join(texts) == "🙂漢x" and "" in texts
    rows = spark.createDataFrame([(1, ids[:1], "k"), (2, ids, "k"), (3, [None, 60_000, -1, 64], "k"), (4, None, "k"), (5, [], "k")],
                                 "doc_id int, ids array<int>, extra string")
    out = {r["doc_id"]: r for r in bpe.decode(rows, PATH, keep=("extra",), by_token=True).collect()}
    assert out[1]["text"] == "�" and bytes(out[1]["data"]) == other.decode_single_token_bytes(ids[0])
    assert out[2]["token_texts"] == texts and out[2]["extra"] == "k"
    assert out[3]["text"] == "�" * 3 + other.decode([64]) and out[4]["text"] == out[5]["text"] == ""
    assert out[4]["token_texts"] == []


def test_large_rank_files_are_refused(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_FILE_BYTES", 100)
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id int, text string"), PATH, PATTERN)


def test_query_over_the_sample(spark, other):
    folder = "/root/testdata/sf0.001"
    got = CASES["op13_bpe"][0](spark, folder)
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = other.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((r["text"] or "").encode())))
    assert collected(got) == sorted(want, key=repr)
    assert got.schema["n_tokens"].dataType.simpleString() == "bigint"
