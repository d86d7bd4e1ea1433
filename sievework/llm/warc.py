"""Derived WARC records: metadata and plain-text conversions of responses.

Every response gives a metadata record, with the headers of its source, and a
conversion record with the page's text. Both name the response in
WARC-Refers-To, with its URI and date, keep its payload digest, and have ids that
follow from the response's id, so that reruns agree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, html_extract

VERSION = b"WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URL name space of RFC 4122
RESPONSE = "record_id string, target_uri string, date string, payload_digest string, block_digest string, block binary"
DERIVED = "record_id string, type string, refers_to string, target_uri string, date string, refers_date string, content_type string, source_digest string, payload_digest string, block_digest string, headers string, block binary"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def clean(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {clean(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file, also one of gzip members; field names in lower case."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(raw))
            raw = d.unused_data
        raw = b"".join(parts)
    at = 0
    while (start := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", start)
        if end < 0:
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[start:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(length) if (length := fields.get("content-length", "")).isdecimal() else 0
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def inflated(payload: bytes) -> bytes:
    """gzip, zlib or raw deflate undone, as far as it is whole; the payload itself where it is none of them."""
    for bits in (47, -15):
        whole, out = zlib.decompressobj(bits), []
        try:
            for at in range(0, len(payload), 1024):
                out.append(whole.decompress(payload[at : at + 1024]))
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The payload as text: content encoding undone, in the charset of the headers or UTF-8."""
    names = {k.lower(): v for k, v in headers}
    if re.search("gzip|deflate", names.get("content-encoding", "")):
        payload = inflated(payload)
    charset = re.search(r"charset=[\"']?([\w-]+)", names.get("content-type", ""))
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html), with page_id beside them."""
    common.session(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, url, page in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                payload = (page or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                rows.append((i, urn(f"response:{i}:{url or ''}"), clean(url), date, digest(payload), digest(block), block))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), *[pa.string()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", *(x.split()[0] for x in RESPONSE.split(", "))])

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return kept.mapInArrow(run, "page_id long, " + RESPONSE)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files under ``path``, one file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows = [(f.get("warc-record-id", ""), f.get("warc-target-uri", ""), f.get("warc-date", ""), f.get("warc-payload-digest") or digest(http_parts(b)[2]), f.get("warc-block-digest") or digest(b), b) for f, b in parse_records(raw) if f.get("warc-type") == "response"]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.string()] * 5, pa.binary()], strict=True)], [x.split()[0] for x in RESPONSE.split(", ")])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)


def derive_one(record_id: str, uri: str, date: str, source_digest: str, block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = http_parts(block)
    link = [("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    about = [("http-status", status), *((f"http-header-{k}", v) for k, v in headers), ("payload-length", str(len(payload))), ("payload-digest", source_digest)]
    meta = "".join(f"{k}: {clean(v)}\r\n" for k, v in about).encode("utf-8", "surrogatepass")
    text = html_extract.plain_text(decoded(headers, payload)).encode("utf-8", "surrogatepass")
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = digest(body)
        # Responses without an id still give records of their own.
        new = urn(f"{kind}:{record_id or f'{uri} {digest(block)}'}")
        head = record_bytes([("WARC-Type", kind), ("WARC-Record-ID", new), *link, ("Content-Type", content), ("WARC-Block-Digest", own)], body)[: -len(body) - 8 or None]
        out.append((new, kind, record_id, uri, date, date, content, source_digest, own, own, head.decode("utf-8", "surrogatepass"), body))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of every response, two rows each; extra columns are not read.

    A null block counts as empty; ids, digests and headers are those of the
    source. Repeated responses give repeated records. No shuffle.
    """
    common.session(responses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, uri, date, payload, block in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "payload_digest", "block")), strict=True):
                rows += derive_one(i or "", uri or "", date or "", payload or digest(http_parts(block or b"")[2]), block or b"")
            cols = list(zip(*rows, strict=True)) if rows else [()] * 12
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 11 else pa.string()) for k, c in enumerate(cols)], [x.split()[0] for x in DERIVED.split(", ")])

    return responses.select("record_id", "target_uri", "date", "payload_digest", "block").mapInArrow(run, DERIVED)


def serialise(record: dict) -> bytes:
    """A row of ``derive`` as the bytes of a WARC record."""
    return record["headers"].encode("utf-8", "surrogatepass") + b"\r\n\r\n" + record["block"] + b"\r\n\r\n"
