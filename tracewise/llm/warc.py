"""WARC archives written from and read back to a chunked record table.

A record's payload travels as rows (record identifier, chunk number, bytes) of
bounded size in both directions. The writer appends each chunk to the open
archive as it comes; the reader returns chunks with the digest and the number
of bytes so far, so no whole payload is ever held in a Python worker.

Each record is a gzip member of its own. Archives lie in the shared folder
under names that no other task attempt uses; only those that a finished task
has listed are read, so lost or repeated tasks leave no records behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id long, chunk long, last boolean, record_type string, refers_to long, length long, bytes_so_far long, digest_so_far string, header_digest string"


def open_store(uri: str):
    """A pyarrow file system and a path in it; plain paths are local or mounted."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def base32(sha1_hex: str | None) -> str | None:
    return None if sha1_hex is None else base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def header(kind: str, record_id: int | None, refers_to: int | None, sha1: str, full: int, carried: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{'none' if record_id is None else record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        f"WARC-Payload-Length: {full}",
        "Content-Type: application/octet-stream",
        f"Content-Length: {carried}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


class Writer:
    """Archives of one task; a new one begins when the last has ``ARCHIVE_BYTES``."""

    def __init__(self, folder: str):
        self.store, self.root = open_store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.folder, self.out, self.done = folder, None, []

    def begin(self, head: bytes) -> None:
        if self.out is not None and self.size >= ARCHIVE_BYTES:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.records = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.put(head)

    def put(self, data: bytes, flush: bool = False) -> None:
        packed = self.member.compress(data) + (self.member.flush() if flush else b"")
        self.out.write(packed)
        self.size += len(packed)

    def end(self) -> None:
        self.put(b"\r\n\r\n", flush=True)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder.rstrip('/')}/{self.name}", self.records, self.size))
            self.out = None


def write(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes ``records`` (record_id, payload, record_type, refers_to) and returns the manifest.

    A revisit carries no payload, only the digest and length of the response
    that it refers to.
    """
    size = F.octet_length("payload").cast("long")
    n = F.when((F.col("record_type") == "response") & (size > 0), F.ceil(size / chunk)).otherwise(1).cast("long")
    rows = records.withColumns({"_size": size, "_sha1": F.sha1("payload"), "_n": n}).select(
        "record_id", "record_type", "refers_to", "_size", "_sha1", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_chunk"), "payload"
    )
    part = F.expr(f"substring(payload, cast(_chunk * {chunk} + 1 as int), {chunk})")
    rows = rows.select("record_id", "record_type", "refers_to", "_size", "_sha1", "_n", "_chunk", F.when(F.col("record_type") == "response", part).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            meta = zip(*(batch.column(i).to_pylist() for i in range(7)))
            for (rid, kind, refers, full, sha1, n, at), data in zip(meta, batch.column(7)):
                if at == 0:
                    out.begin(header(kind, rid, refers, sha1, full, full if kind == "response" else 0))
                if kind == "response" and full:
                    out.put(data.as_py())
                if at == n - 1:
                    out.end()
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def parse_header(source) -> dict[str, str] | None:
    first = source.readline()
    if not first:
        return None
    if first != b"WARC/1.1\r\n":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields: dict[str, str] = {}
    while (line := source.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.lower()] = value.strip()
    return fields


def record_number(urn: str | None) -> int | None:
    text = (urn or "").rpartition(":")[2].rstrip(">")
    return int(text) if text.lstrip("-").isdigit() else None


def chunks_of(uri: str, chunk: int) -> Iterator[tuple]:
    """The rows of one archive: metadata of :data:`CHUNKS`, then the bytes of the chunk."""
    store, path = open_store(uri)
    with store.open_input_stream(path, compression=None, buffer_size=1 << 16) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as source:
        while (h := parse_header(source)) is not None:
            left, so_far, number, digest = int(h["content-length"]), 0, 0, hashlib.sha1()
            revisit = h["warc-type"] == "revisit"
            told = h.get("warc-payload-digest", "").removeprefix("sha1:")
            while True:
                data = source.read(min(chunk, left)) if left else b""
                if left and not data:
                    raise ValueError(f"{uri}: a record ends early")
                left, so_far = left - len(data), so_far + len(data)
                digest.update(data)
                now = told if revisit else base64.b32encode(digest.digest()).decode()
                if not left and now != told:
                    raise ValueError(f"{uri}: payload digest {now} of record {h['warc-record-id']} is not {told}")
                yield record_number(h["warc-record-id"]), number, not left, h["warc-type"], record_number(h.get("warc-refers-to")), int(h["warc-payload-length"]), int(h["warc-payload-length"]) if revisit else so_far, now, told, data
                number += 1
                if not left:
                    break
            if source.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record isn't closed")


def read(manifest: DataFrame, chunk: int = CHUNK, payload: bool = False) -> DataFrame:
    """The chunked record table of the archives in ``manifest``; with ``payload``, the bytes too.

    Digests are checked against the records' headers; a mismatch or a
    truncated record fails the task.
    """
    schema = CHUNKS + (", data binary" if payload else "")
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows), kinds))[: len(names)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in chunks_of(uri, chunk):
                    rows.append(row if payload else row[:-1])
                    held += len(row[-1]) if payload else 0
                    if len(rows) >= 4096 or held >= 8 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return spread.mapInArrow(run, schema)


def records_of(rows: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Decides which rows are responses and which revisit one with an equal payload.

    Payloads are equal if length and SHA-256 are; the row with the largest id
    is the response. Null payloads are empty. A null id is less than any
    other; rows that repeat an id and its payload, and all rows of a payload
    that has no id at all, are responses each.
    """
    base = rows.select(F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = base.select("record_id", F.sha2("payload", 256).alias("_key"))
    first = key.groupBy("_key").agg(F.max("record_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_key"), "_first")
    joined = base.withColumn("_key", F.sha2("payload", 256)).join(first, "_key", "left")
    revisit = F.coalesce(~F.col("record_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    return joined.select("record_id", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def archive(rows: DataFrame, id_col: str, payload_col: str, chunk: int = CHUNK, folder: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the manifest of the archives."""
    return write(records_of(rows, id_col, payload_col), folder or shared_dir(rows.sparkSession, "warc"), chunk)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read(archive(table(spark, sf_dir, "pages"), "page_id", "html"))
    return back.where("last").select(
        F.col("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, first, octet_length(encode(p.html)) AS n, sha1(p.html) AS x FROM p JOIN f ON p.html = f.html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST(('0x' || substr(x, CAST(5 * (k // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""
