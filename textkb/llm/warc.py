"""Dictionary-compressed WARC archives: write, read back, and revisit records for equal payloads.

An archive is the bytes of a ``.warc.zst`` file held in one row (``archive``, ``content``), so any
store that Spark writes can hold it: a leading skippable frame (magic 0x184D2A5D) embeds a Zstandard
dictionary built from the archive's own records, then each record is a frame of its own. Archives
roll at ``ARCHIVE_BYTES`` of uncompressed records, which bounds a task's memory and a row's size; a
longer single record makes an archive of its own.

Payload digests and the first holder of each payload are found by Spark before writing: digests are
grouped (minima are pre-aggregated), and only the digests of several rows, narrow rows, come back to the
pages. Where they are a small table, Spark sends it to the pages and no payload is shuffled; else both
sides are, and a payload that a third of all pages share is a skewed join that adaptive execution splits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20  # of records that a dictionary is built from
LEVEL = 3
REVISIT_LEAST = 0  # bytes from which equal payloads are stored once
DATE = "2024-01-01T00:00:00Z"  # pages carry no date
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header_text(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in value)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {_header_text(str(v))}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, first, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page-Id", first)]
    return _record(fields, http if is_revisit else http + payload)


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records up to ``SAMPLE_BYTES``; too few or too short records serve as they are."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: SAMPLE_BYTES // 8])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    if size < 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(name: str, records: list[bytes]) -> bytes:
    info = _record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", f"{name}.warc.zst"), ("Content-Type", "application/warc-fields")],
        b"software: textkb\r\nformat: WARC File Format 1.1\r\n",
    )
    dictionary = build_dictionary(records)
    out = []
    if dictionary is not None:
        raw = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    out += [compressor.compress(r) for r in [info, *records]]
    return b"".join(out)


def _frames(view: memoryview) -> Iterator[memoryview]:
    """The Zstandard frames of ``view`` one after the other, found by their block headers: nothing is copied."""
    at = 0
    while at < len(view):
        if bytes(view[at : at + 4]) != b"\x28\xb5\x2f\xfd":
            raise ValueError("not a Zstandard frame")
        head = view[at + 4]
        single, checksum = head >> 5 & 1, head >> 2 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[head & 3] + ((1 if single else 0), 2, 4, 8)[head >> 6]
        last = False
        while not last:
            if end + 3 > len(view):
                raise ValueError("truncated record")
            block = int.from_bytes(view[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)  # a run-length block holds one byte
        end += 4 * checksum
        if end > len(view):
            raise ValueError("truncated record")
        yield view[at:end]
        at = end


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, in order."""
    view, dictionary = memoryview(content), None
    if len(view) >= 8 and struct.unpack("<I", view[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", view[4:8])[0]
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, view = zstandard.ZstdCompressionDict(raw), view[8 + size :]
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    for frame in _frames(view):
        record = decompressor.decompressobj().decompress(frame)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        yield fields, rest[: int(fields["Content-Length"])]


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, revisit_least: int = REVISIT_LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``(archive, content)`` rows that hold a record per row of ``pages`` (page_id, url, html).

    A null html is an empty payload; a null url has no target header; of equal payloads of at least
    ``revisit_least`` bytes the smallest page_id is the response (all its rows, if it is repeated;
    null ids come last), the others revisit it. An empty table gives no archives; a payload longer than
    ``archive_bytes`` has an archive of its own, whole; other columns are ignored, whatever their names.
    """
    bounded_batches(pages.sparkSession)
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = (
        rows.where(F.octet_length("payload") >= revisit_least)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first")
    )
    joined = rows.join(materialize(firsts), "digest", "left").select("page_id", "url", "payload", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, records, size = TaskContext.get(), 0, [], 0
        part = task.partitionId() if task else 0

        def rolled() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{made:05d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_archive(name, records)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for i, (page, url, digest, first) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True)):
                revisit = first is not None and first != page
                record = page_record(page, url, batch.column(2)[i].as_py(), base32(digest), first, revisit)
                if records and size + len(record) > archive_bytes:
                    yield rolled()
                    made, records, size = made + 1, [], 0
                records.append(record)
                size += len(record)
        if records:
            yield rolled()

    return joined.mapInArrow(write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The page records of ``(archive, content)`` rows; payload digests of responses are verified.

    Records come in the order of their archive, repeated pages as often as they were written; an empty table gives
    none; long payloads are read whole, frame by frame; other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in read_archive(content.as_py()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if kind == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or len(payload) != length:
                            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), fields.get("WARC-Target-URI"), payload if kind == "response" else None, length, digest, kind, refers and int(refers)))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select("content").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_archives(table(spark, sf_dir, "pages")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digits AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS head, count(*) OVER (PARTITION BY hex) AS n
  FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN n > 1 AND head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM digits
"""
