"""WARC derivatives: metadata and plain-text conversion records from responses.

Records follow WARC/1.1.  A response's derivatives name it in WARC-Refers-To
and carry its target and date in WARC-Refers-To-Target-URI and -Date; the
metadata record holds the response's own record and payload digests, the HTTP
status and headers, title, outlinks and the conversion's id.  Record ids are
derived from content, so that a task that runs again writes the same records.

A row without html becomes a response with an empty payload; without url, the
target is urn:page:<page_id>.  Repeated rows give repeated records with the
same ids.  An empty table gives no records.  A record that can't be parsed
(no header, or a length that doesn't fit) yields a metadata record that says
so, and no conversion.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, lean, pick, small_batches

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f0d1f2e-6f7c-5d0e-9a44-2d5f3c0b7a11")

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


def one_line(value: str) -> str:
    return re.sub(r"[\r\n\x00]+", " ", value)


def build(headers: Headers, block: bytes) -> bytes:
    """A record: version, headers with block digest and length, the block, and the two line ends that close it."""
    lines = [VERSION, *(f"{k}: {one_line(v)}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block; ValueError if it isn't a whole record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit() or rest[int(size) :].strip(b"\r\n") or len(rest) < int(size):
        raise ValueError("length doesn't fit")
    return headers, rest[: int(size)]


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    target = url or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return build([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, target, digest(payload))), ("WARC-Target-URI", target), ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))], http + payload)


class _Page(HTMLParser):
    """Title, link targets and visible text, one line for each block."""

    BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
    HIDDEN = frozenset("head noscript script style template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.lines, self.line = "", [], [], []
        self.hidden: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in self.HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        if tag in self.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        if tag in self.BLOCK:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.line.append(data)

    def flush(self) -> None:
        if text := " ".join("".join(self.line).split()):
            self.lines.append(text)
        self.line = []


def derivatives(record: bytes) -> list[tuple[str, str, str, str, str, bytes]]:
    """(type, record id, refers-to, target, source digest, record) of a response's metadata and conversion records."""
    try:
        headers, block = parse(record)
    except ValueError as e:
        own = record_id("metadata", digest(record))
        text = f"error: {e}\r\nsource-digest: {digest(record)}\r\n".encode()
        return [("metadata", own, "", "", digest(record), build([("WARC-Type", "metadata"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], text))]
    source, target, date = headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", DATE)
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("utf-8", "replace").split("\r\n")
    page = _Page()
    page.feed(payload.decode("utf-8", "replace"))
    page.close()
    page.flush()
    text = "\n".join(page.lines).encode()
    source_digest = headers.get("warc-payload-digest") or digest(payload)
    common: Headers = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date)]
    conversion_id = record_id("conversion", source)
    metadata_id = record_id("metadata", source)
    fields = [("source-record-id", source), ("source-block-digest", headers.get("warc-block-digest", "")), ("source-payload-digest", source_digest), ("conversion-record-id", conversion_id),
              ("http-status", status), *((f"http-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in lines)), ("title", " ".join(page.title.split())), *(("outlink", x) for x in page.links)]
    body = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode()
    return [
        ("metadata", metadata_id, source, target, source_digest, build([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *common, ("Content-Type", "application/warc-fields")], body)),
        ("conversion", conversion_id, source, target, source_digest, build([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *common, ("WARC-Source-Payload-Digest", source_digest), ("Content-Type", "text/plain; charset=utf-8")], text)),
    ]


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record for each page."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [response(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary())], ["page_id", "record"])

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, record binary")


def derived(records: DataFrame) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, source_digest, record, from (page_id, record)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "record"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [(i, *d) for i, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for d in derivatives(r or b"")]
                cols = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return pick(records, page_id="long", record="binary").mapInArrow(run, "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, record binary")


def digested(derivative_records: DataFrame) -> DataFrame:
    """The records as lengths and digests, for comparison."""
    return derivative_records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest",
        F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))


#: Records in a file that save() writes, at most.
FILE_RECORDS = 50_000


def save(records: DataFrame, path: str) -> None:
    """Writes the records, whose bytes can be any, as gzipped WARC files, part by part."""
    raw = F.col("record").cast("string")  # the bytes as they are; the writer doesn't look at them
    records.select(raw.alias("value")).write.options(lineSep="\n", compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(path)


def records_in(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of a WARC file, each as long as its Content-Length says; what isn't a record's head is put out by itself, up to the next version line."""
    line = stream.readline()
    while line:
        if not line.strip(b"\r\n"):
            line = stream.readline()
            continue
        if not line.startswith(b"WARC/"):
            broken = [line]
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                broken.append(line)
            yield b"".join(broken)
            continue
        head, size = [line], 0
        while line := stream.readline():
            head.append(line)
            if not line.strip(b"\r\n"):
                break
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
        yield b"".join(head) + stream.read(size) + b"\r\n\r\n"
        line = stream.readline()


def load(spark: SparkSession, path: str) -> DataFrame:
    """(record) from WARC files, gzipped or not.  A task reads a file from its begin to its end."""
    small_batches(spark)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = pa.BufferReader(data)
                held, size = [], 0
                for record in records_in(gzip.GzipFile(fileobj=stream) if data[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(stream)):
                    held.append(record)
                    size += len(record)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, "record binary")
