import gzip
import hashlib
from pathlib import Path

import pytest

from fleetlens.llm.warc import read_chunks, read_records, write_warc

LONG = "".join(f"<p>{i} ü\r\n\r\n</p>" for i in range(4000))
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/ 9\r\nX: y", LONG), (3, None, None), (4, "u", ""),
    (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (10, "u", "\r\n\r\n"),
    (11, "u", "a\r\n\r\n"), (12, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (13, "u", "é" * 999),
    (14, "u", "abc\r\n"), (15, "u", "abc\r"), (16, "u", "abc\n\r\n"), (17, "u", "\r\n\r\n\r\n"), (18, "u", "ab\r\n\r"), (19, "u", "\r\n"),
    (7, "again", "x" * 1000), (8, "again", "x" * 1000), (None, "u", "x" * 1000), (None, None, "y" * 1000),
]


def expected(rows):
    out = []
    for name, _, html in rows:
        data = (html or "").encode()
        same = [n for n, _, h in rows if h == html and n is not None]
        keep = max(same, default=None) if len(data) >= 1000 else name
        revisit = name != keep
        out.append((str(name) if name is not None else "null", "revisit" if revisit else "response",
                    str(keep) if revisit else None, len(data), hashlib.sha1(data).hexdigest(), True))
    return sorted(out)


def test_round_trip_of_any_chunk_size(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, chunk string")
    for chunk_bytes in (65_536, 777, 7):
        path = f"{tmp_path}/{chunk_bytes}"
        write_warc(pages.repartition(3), path, chunk_bytes=chunk_bytes)
        found = read_records(spark, path).drop("url").collect()
        assert sorted(tuple(r) for r in found) == expected(ROWS)


def test_chunks_carry_the_digest_so_far(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w", chunk_bytes=1000)
    rows = sorted(read_chunks(spark, f"{tmp_path}/w").collect(), key=lambda r: r["chunk_no"])
    data = LONG.encode()
    assert [r["chunk_no"] for r in rows] == list(range(-(-len(data) // 1000)))
    assert b"".join(bytes(r["data"]) for r in rows) == data
    at = 0
    for row in rows:
        at += len(row["data"])
        assert len(row["data"]) <= 1000 and row["bytes_so_far"] == at
        assert row["sha1_so_far"] == hashlib.sha1(data[:at]).hexdigest()
    assert [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "abc")], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("*.gz"))
    head, http, rest = raw.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest == b"abc\r\n\r\n"
    assert f"Content-Length: {len(http) + 4 + 3}".encode() in head


def test_damage_is_seen(spark, tmp_path):
    raw = _archive(spark, tmp_path, [(1, "http://a/1", "abcdef" * 300)])
    Path(tmp_path, "broken").mkdir()
    Path(tmp_path, "broken", "part.txt.gz").write_bytes(gzip.compress(raw.replace(b"abcdefa", b"abcdefX", 1)))
    assert [r["intact"] for r in read_records(spark, f"{tmp_path}/broken").collect()] == [False]


def test_no_pages(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert read_records(spark, f"{tmp_path}/w").collect() == []


def _archive(spark, tmp_path, rows, name="w", **options):
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/{name}", **options)
    return b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, name).glob("*.gz"))


@pytest.mark.parametrize("html", ["abc\r\n", "abc\r", "abc\n\r\n", "\r\n\r\n", "abc"])
def test_last_payload_may_end_in_line_ends(spark, tmp_path, html):
    raw = _archive(spark, tmp_path, [(1, "u", html)])
    assert raw.endswith(html.encode() + b"\r\n\r\n")
    assert [bytes(r["data"]) for r in read_chunks(spark, f"{tmp_path}/w").collect()] == [html.encode()]


def test_truncated_archives_are_errors(spark, tmp_path):
    raw = _archive(spark, tmp_path, [(1, "u", "abcdef" * 300), (2, "u", "short")], chunk_bytes=700)
    last = raw.rindex(b"WARC/1.1")
    second = raw.index(b"WARC/1.1", 10)
    for i, part in enumerate([raw[: last + 60], raw[:-9], raw[:second], raw[: second + 400]]):
        Path(tmp_path, f"cut{i}").mkdir()
        Path(tmp_path, f"cut{i}", "part.txt.gz").write_bytes(gzip.compress(part))
        with pytest.raises(Exception, match="the archive ends inside"):
            read_records(spark, f"{tmp_path}/cut{i}").collect()


def test_several_files_in_one_task(spark, tmp_path):
    Path(tmp_path, "all").mkdir()
    for i in range(5):
        raw = _archive(spark, tmp_path, [(i, "u", f"page {i}\r\n"), (i + 10, "u", "\r\n")], f"w{i}")
        Path(tmp_path, "all", f"{i}.txt.gz").write_bytes(gzip.compress(raw))
    Path(tmp_path, "all", "9.txt.gz").write_bytes(gzip.compress(b""))
    rows = read_chunks(spark, f"{tmp_path}/all").coalesce(1).collect()
    assert {(int(r["record_id"]), bytes(r["data"])) for r in rows} == {
        x for i in range(5) for x in ((i, f"page {i}\r\n".encode()), (i + 10, b"\r\n"))}
