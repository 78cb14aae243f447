"""WARC archives as chunk rows.

A payload beyond `chunk_bytes` is written as a first segment and continuation records (record segmentation of WARC 1.1),
one row per record id and chunk number. Chunks are cut by Spark before they reach Python, and digests are carried from
chunk to chunk, so that neither writing nor reading holds a whole record outside the source row. Spark's text files with
the record end as line end are the archives: they work in any store that Spark can write to, and lost tasks are repeated.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm.common import written

CHUNK_BYTES = 65_536
# payloads below this size are always stored
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"

_END = "\r\n\r\n"
_MARK = _END.encode()
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = (
    "record_id string, chunk_no int, record_type string, refers_to string, url string, data binary, "
    "bytes_so_far long, sha1_so_far string, last boolean, intact boolean"
)


def _sha1(data):
    return hashlib.sha1(data, usedforsecurity=False)


def plan_records(pages, id_col="page_id", url_col="url", payload_col="html", revisit_bytes=REVISIT_BYTES):
    """id, url, bytes, payload_bytes, payload_digest, refers_to: the id of the equal payload that is stored, or null.

    Of equal payloads of at least `revisit_bytes` bytes that with the largest id is stored; rows that repeat its id are
    stored too. A null payload is empty, a null id is smaller than any other. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("bytes"))
    rows = rows.select(
        "id", "url", "bytes", F.octet_length("bytes").cast("long").alias("payload_bytes"),
        F.sha1("bytes").alias("payload_digest"),
        F.when(F.octet_length("bytes") >= revisit_bytes, F.sha2("bytes", 256)).alias("content"),
    )
    groups = rows.where("content IS NOT NULL").groupBy("content").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").drop("n"), "payload-groups")
    keep = F.when(~F.col("id").eqNullSafe(F.col("keep")), F.col("keep"))
    return rows.join(groups, "content", "left").select(
        "id", "url", "bytes", "payload_bytes", "payload_digest", keep.alias("refers_to")
    )


def _one_line(text):
    return "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in text or "")


def _records(batches, date):
    """WARC records, one per chunk row; the chunks of a record follow each other."""
    digest = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            name, number, count = row["id"], row["pos"] + 1, row["chunks"]
            stored, chunk = row["refers_to"] is None, row["chunk"]
            http = b""
            if number == 1:
                digest = _sha1(b"")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}"
                http = (http + _END).encode()
            digest.update(chunk)
            kind = ("response" if stored else "revisit") if number == 1 else "continuation"
            head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{number}>", f"WARC-Date: {date}"]
            if number == 1:
                head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
                head.append(f"WARC-Target-URI: {_one_line(row['url'])}")
                head.append("Content-Type: application/http;msgtype=response")
                if not stored:
                    head.append(f"WARC-Profile: {_PROFILE}")
                    head.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}:1>")
            else:
                head.append(f"WARC-Segment-Origin-ID: <urn:page:{name}:1>")
            if count > 1:
                head.append(f"WARC-Segment-Number: {number}")
                head.append(f"Running-Payload-Digest: sha1:{digest.hexdigest()}")
                if number == count:
                    head.append(f"WARC-Segment-Total-Length: {row['payload_bytes']}")
            block = http + chunk
            head.append(f"WARC-Block-Digest: sha1:{_sha1(block).hexdigest()}")
            head.append(f"Content-Length: {len(block)}")
            out.append(("\r\n".join(head) + _END).encode() + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages, path, id_col="page_id", url_col="url", payload_col="html", chunk_bytes=CHUNK_BYTES,
               revisit_bytes=REVISIT_BYTES, date=DATE):
    """Write gzip-compressed WARC files into the folder `path`, a record per row and one more per further chunk.

    Ids are written as text (null as 'null'); blanks and control characters of a URL are escaped, a null URL is empty.
    An empty table gives a folder without records.
    """
    plan = plan_records(pages, id_col, url_col, payload_col, revisit_bytes)
    chunks = F.when(F.col("refers_to").isNotNull(), 1).otherwise(
        F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int"))
    )
    chunk = F.expr(f"substring(bytes, pos * {chunk_bytes} + 1, {chunk_bytes})")
    rows = (
        plan.withColumn("chunks", chunks)
        .select("*", F.explode(F.expr("sequence(0, chunks - 1)")).alias("pos"))
        .select(
            F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "payload_bytes", "payload_digest",
            F.col("refers_to").cast("string").alias("refers_to"), "chunks", "pos",
            F.when(F.col("refers_to").isNull(), chunk).otherwise(F.lit(b"")).alias("chunk"),
        )
    )
    records = rows.mapInArrow(lambda batches: _records(batches, date), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", _END).option("compression", "gzip").text(path)


class _Reader:
    """Cuts the bytes of one archive into records by their Content-Length; holds one chunk at most.

    A line end may stand inside a block, or overlap with the end of a block, so that the lines say nothing about records:
    each one goes back into the bytes with the line end that followed it.
    """

    def __init__(self):
        self.rest, self.head, self.open, self.origin = bytearray(), None, False, None

    def add(self, value):
        """Chunk rows of the records that end in `value` and the line end after it."""
        if self.head is None and self.rest:
            raise ValueError("a record end where a record should start")
        self.rest += value
        self.rest += _MARK
        rows = []
        while (row := self._next()) is not None:
            rows.append(row)
        return rows

    def end(self):
        """The archive must end with a whole record. The line end after its last bytes may be one that `add` made up."""
        if self.head is not None or self.open or self.rest not in (b"", _MARK):
            raise ValueError(f"the archive ends inside record {(self.head or self.origin or {}).get('WARC-Record-ID')}")

    def _next(self):
        if self.head is None:
            at = self.rest.find(_MARK)
            if at < 1:
                return None
            lines = self.rest[:at].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record starts with {bytes(self.rest[:40])!r}")
            try:
                self.head = dict(x.split(": ", 1) for x in lines[1:])
                self.need = int(self.head["Content-Length"])
            except (KeyError, ValueError) as error:
                raise ValueError(f"the archive ends inside a record head, or one is damaged: {lines[:3]!r}") from error
            del self.rest[: at + len(_MARK)]
        need = self.need
        if len(self.rest) < need + len(_MARK):
            return None
        block, mark = bytes(self.rest[:need]), self.rest[need : need + len(_MARK)]
        if mark != _MARK:
            raise ValueError(f"record {self.head['WARC-Record-ID']} is longer than it says")
        del self.rest[: need + len(_MARK)]
        head, self.head = self.head, None
        return self._close(head, block)

    def _close(self, head, block):
        kind = head["WARC-Type"]
        fits = head["WARC-Block-Digest"] == f"sha1:{_sha1(block).hexdigest()}"
        http, data = b"", block
        if (kind == "continuation") != self.open:
            raise ValueError(f"record {head['WARC-Record-ID']} comes where {'a segment' if self.open else 'a record'} should")
        if kind != "continuation":
            self.origin, self.digest, self.total, self.intact = head, _sha1(b""), 0, True
            http, _, data = block.partition(_MARK)
        elif head["WARC-Segment-Origin-ID"] != self.origin["WARC-Record-ID"]:
            raise ValueError(f"segment {head['WARC-Record-ID']} doesn't follow its first one")
        self.digest.update(data)
        self.total += len(data)
        number = int(head.get("WARC-Segment-Number", 1))
        last = "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head
        self.open = not last
        so_far, refers = self.digest.hexdigest(), None
        if kind == "revisit":
            so_far = self.origin["WARC-Payload-Digest"].removeprefix("sha1:")
            self.total = int(http.decode().rpartition("Content-Length: ")[2])
            refers = _name(head["WARC-Refers-To"])
        elif last:
            fits = fits and f"sha1:{so_far}" == self.origin["WARC-Payload-Digest"]
        self.intact = self.intact and fits
        return (_name(self.origin["WARC-Record-ID"]), number - 1, self.origin["WARC-Type"], refers,
                self.origin["WARC-Target-URI"], data, self.total, so_far, last, self.intact)


def _name(uri):
    return uri.removeprefix("<urn:page:").removesuffix(">").rpartition(":")[0]


def _chunks(batches, with_data, schema):
    """Chunk rows of the archives of a task, whose lines come file by file."""
    reader, own = None, None
    for batch in batches:
        rows = []
        for value, file in zip(batch.column("value"), batch.column("file").to_pylist(), strict=True):
            if file != own:
                if reader is not None:
                    reader.end()
                reader, own = _Reader(), file
            rows += reader.add(value.as_py())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        if not with_data:
            columns[schema.get_field_index("data")] = [None] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )
    if reader is not None:
        reader.end()


def read_chunks(spark, path, with_data=True):
    """The chunk table of the archives in `path`: one row per record id and chunk number, in the order of the file.

    `bytes_so_far` and `sha1_so_far` cover the payload up to this chunk; in the row with `last` they cover all of it.
    `intact` tells whether block and payload digests fit so far. A revisit has one row without data and the figures of
    the payload it refers to. A compressed file is never split, so its records are read in order by one task. Records are
    cut by their Content-Length, so payloads may hold or end in any bytes. A file that ends inside a record or a segmented
    payload, or whose records don't have the length they say, raises an error; an empty file has no records.
    """
    schema = pa.schema([
        ("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("url", pa.string()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()),
        ("last", pa.bool_()), ("intact", pa.bool_()),
    ])
    lines = spark.read.option("lineSep", _END).text(path).select(
        F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(lambda batches: _chunks(batches, with_data, schema), _CHUNKS)


def read_records(spark, path):
    """One row per record: record_id, record_type, refers_to, url, payload_bytes, payload_digest, intact."""
    return read_chunks(spark, path, with_data=False).where("last").select(
        "record_id", "record_type", "refers_to", "url", F.col("bytes_so_far").alias("payload_bytes"),
        F.col("sha1_so_far").alias("payload_digest"), "intact",
    )
