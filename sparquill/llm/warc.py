"""WARC archives as chunked record tables.

An archive is a table of chunks: (record, chunk_no, last, data, so_far, digest).
The data of its rows, in the order of record and chunk_no, is a WARC 1.1 stream.
A payload longer than a chunk becomes several rows that a task emits one by one
from the page's own buffer; each carries the payload bytes and the digest of
the payload so far, so a reader can stop, or check, at any chunk. Nothing ever
copies a whole record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of payload in a chunk; bytes of one output batch.
CHUNK, BATCH = 1 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record long, chunk_no int, last boolean, data binary, so_far long, digest string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_END = b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(text: str | None) -> str:
    """A header value: line ends, which would end it, and the sign that marks them are percent-encoded."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def header(page_id: int | None, url: str | None, size: int, digest: str, first: int | None, response: bool) -> bytes:
    """All of a record before its payload; a revisit keeps the HTTP header, whose length still says how long the payload was."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_line(url)}"] * (url is not None)
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [] if response else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first)}"]
    lines.append(f"Content-Length: {len(http) + (size if response else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + http


def parse_header(data: bytes) -> tuple[dict[str, str], int, int]:
    """(WARC fields by lower-case name, payload length by the HTTP header, where the payload begins) of a record's first chunk."""
    end = data.index(_END)
    head = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if head[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head[1:])}
    stop = data.index(_END, end + 4)
    http = dict(x.split(": ", 1) for x in data[end + 4 : stop].decode().split("\r\n")[1:])
    return fields, int(http["Content-Length"]), stop + 4


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``sha1`` and ``first``: the page whose response holds the payload.

    Of pages with equal payloads of at least ``min_bytes`` bytes that is the
    smallest page_id; smaller payloads are all their own, and first is null where
    no other page has the payload. Digests, not payloads, are aggregated; only
    digests that pages share are joined, and Spark splits a frequent one.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    shared = base.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written, so that Spark knows its size: pages are not shuffled for a few shared digests
    return base.join(materialize(shared.select("sha1", "first")), "sha1", "left")


def write_chunks(planned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of one record a row of ``planned`` (see plan_records)."""
    schema = pa.schema([("record", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("so_far", pa.int64()), ("digest", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        record = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, urls, firsts, sha1 = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            html = batch.column(2).cast(pa.binary())
            for i, (page_id, url, first, hexed) in enumerate(zip(ids, urls, firsts, sha1)):
                payload = memoryview(html[i].as_buffer())
                size, response = len(payload), first is None or first == page_id
                head = header(page_id, url, size, base32(bytes.fromhex(hexed)), first, response)
                if not response:
                    yield record, 0, True, head + _END, 0, ""
                elif size <= chunk:
                    yield record, 0, True, b"".join((head, payload, _END)), size, base32(bytes.fromhex(hexed))
                else:
                    running = hashlib.sha1()
                    for k, at in enumerate(range(0, size, chunk)):
                        part = payload[at : at + chunk]
                        running.update(part)
                        done = at + chunk >= size
                        yield record, k, done, b"".join((b"" if k else head, part, _END if done else b"")), min(at + chunk, size), base32(running.digest())
                record += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows(batches):
            held.append(row)
            size += len(row[3])
            if size >= BATCH or len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    return planned.select("page_id", "url", "html", "first", "sha1").mapInArrow(run, CHUNKS)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunk rows that come in order; holds one chunk at a time. Lengths and digests are checked against the bytes."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    fields, length, running, got = {}, 0, hashlib.sha1(), 0
    for batch in batches:
        out = []
        chunk_no, last, so_far, digest = (batch.column(i).to_pylist() for i in (1, 2, 4, 5))
        for i in range(len(chunk_no)):
            data, at = batch.column(3)[i].as_py(), 0
            if chunk_no[i] == 0:
                fields, length, at = parse_header(data)
                running, got = hashlib.sha1(), 0
            body = memoryview(data)[at : len(data) - (4 if last[i] else 0)]
            running.update(body)
            got += len(body)
            if so_far[i] != got:
                raise ValueError("a chunk is missing or out of order")
            if not last[i]:
                continue
            kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and (got != length or base32(running.digest()) != named or digest[i] != named):
                raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
            url = fields.get("warc-target-uri")
            refers = number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
            out.append((number(fields["warc-record-id"]), None if url is None else _unline(url), length, named, kind, refers))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)


def read_chunks(archive: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record of a chunk table.

    Records of one chunk, nearly all, are read where they lie. Only the chunks
    of longer ones are brought together by record, in order.
    """
    alone = (F.col("chunk_no") == 0) & F.col("last")
    whole = archive.filter(alone).mapInArrow(_records, RECORDS)
    parted = archive.filter(~alone).repartition("record").sortWithinPartitions("record", "chunk_no").mapInArrow(_records, RECORDS)
    return whole.unionByName(parted)


def archive(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``pages`` as a written chunk table. A null html is an empty payload, a null url no target; every row is a record, repeats too.

    A row that repeats the page_id and payload of a response is a response as well.
    A null page_id revisits the smallest page_id that has its payload; where only null ids have it, all are responses.
    """
    return materialize(write_chunks(plan_records(pages, min_bytes), chunk))


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """What reading ``archive(pages)`` back gives, a row for each page."""
    return read_chunks(archive(pages, min_bytes, chunk))


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((((strpos('0123456789abcdef', h[cast(i * 5 // 4 + 1 as int)]) - 1) * 16 + strpos('0123456789abcdef', h[cast(i * 5 // 4 + 2 as int)]) - 1) >> cast(3 - (i * 5) % 4 as int)) & 31) + 1 as int), 1)), '') as payload_digest,
  case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from p
"""
