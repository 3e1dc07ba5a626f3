"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly.

Writer: of the records with equal payloads the one with the smallest page id is a response, the others are revisits
that refer to it. A response's block is an HTTP response whose body has chunked transfer framing; a block longer than
``segment_bytes`` is written as a first record and continuation records, which may lie in different archive files.
Reader: records of one origin are grouped by the origin's identifier, ordered by segment number, checked against the
total length that the last segment states, joined, and the chunked framing is decoded.

Record ids derive from page id and payload digest, so equal ids mean equal blocks; the number of copies of segment 1
says how often a repeated row was written.

Defined cases: a null payload is empty; a null page id is kept as null and never preferred as response; repeated rows
of the smallest page id are all responses; payloads below ``min_bytes`` are all responses; a null or odd URL is left
out or percent-encoded; an incomplete group of segments gives a row with ``complete`` false and null payload; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shared_dir
from .files import RollingFile, resolve

#: Blocks above this many bytes are segmented.
SEGMENT_BYTES = 16 * 1024
#: A new archive file is begun beyond this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Size of the chunks of the transfer framing.
CHUNK_BYTES = 4096
DATE = "2020-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORD = "record_id string, page_id long, url string, record_type string, digest string, refers_to long, segment int, total_length long, block binary"
PAGE = "page_id long, url string, record_type string, payload_digest string, refers_to long, copies long, complete boolean, payload_bytes long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def to_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """Decode chunked framing; raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(part)
        at = end + 4 + n


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records_of(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of one page."""
    own = record_id(page_id, digest)
    head = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head += [("X-Page-Id", str(page_id))] if page_id is not None else []
    head += [("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]-._"))] if url is not None else []
    if revisit:
        head += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", PROFILE)]
        yield _record([("WARC-Type", "revisit"), *head], REVISIT_HEAD)
        return
    block = HEAD + to_chunks(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *head], block)
        return
    n = -(-len(block) // segment_bytes)
    for k in range(n):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            yield _record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", "1")], part)
            continue
        rest = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{digest}/{k + 1}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k + 1))]
        yield _record(rest + [("WARC-Segment-Total-Length", str(len(block)))] * (k == n - 1), part)


def _digest32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html) and return the manifest, which is a written table."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written out, the few repeated payloads join by an exchange of their own, whose large partitions can be split.
    first = materialise(first.withColumnRenamed("sha", "sha_first"), "warc-first")
    linked = rows.join(first, F.col("sha") == F.col("sha_first"), "left").select(
        "page_id", "url", "payload", "sha", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, count, done = RollingFile(folder, ".warc.gz"), 0, 0, []

        def finish() -> None:
            nonlocal size, count
            done.append((out.close(), count, size))
            size = count = 0

        for batch in batches:
            for page_id, url, body, sha, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in records_of(page_id, url, body, _digest32(bytes.fromhex(sha)), refers, refers is not None, segment_bytes):
                    if out.sink is not None and size > archive_bytes:
                        finish()
                    if out.sink is None:
                        out.open()
                    member = gzip.compress(record, 1, mtime=0)
                    out.sink.write(member)
                    size, count = size + len(member), count + 1
        if out.sink is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialise(map_arrow(linked, write, MANIFEST, 256), "warc-manifest")


def parse_stream(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode().strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of the archives that the manifest lists; one task works through a file as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = resolve(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    for h, block in parse_stream(io.BufferedReader(unpacked, 1 << 20)):
                        kind, number = h["warc-type"], h.get("warc-segment-number")
                        key = h["warc-segment-origin-id"] if kind == "continuation" else h["warc-record-id"]
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        page, refers, total = (int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page", "warc-segment-total-length"))
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((key, page, h.get("warc-target-uri"), None if kind == "continuation" else kind, digest, refers, int(number or 1), total if number else len(block), block))
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    # A stated number, so that the few small manifest rows are not put into one task.
    return map_arrow(manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)), "path"), read, RECORD)


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records -> one row per page record, with the full payload of responses; ``copies``: times it was written."""
    # A set: pages that repeat a row bring equal segments of one record, which already the map side holds once.
    segments = F.array_sort(F.collect_set(F.struct("segment", "block")))
    named = [F.max(c).alias(c) for c in ("page_id", "url", "record_type", "digest", "refers_to", "total_length")]
    copies = F.count_if(F.col("record_type").isNotNull()).alias("copies")
    grouped = records.groupBy("record_id").agg(*named, copies, segments.alias("segments")).select(
        "page_id", "url", "record_type", "digest", "refers_to", "total_length", "copies", F.col("segments.segment").alias("numbers"), F.col("segments.block").alias("blocks")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, kind, _digest, refers, total, copies, numbers, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = dict(zip(numbers, blocks, strict=True))
                block = b"".join(parts[k] for k in sorted(parts))
                complete, payload = sorted(parts) == list(range(1, len(parts) + 1)) and total == len(block), None
                if kind == "response" and complete:
                    head, _, body = block.partition(b"\r\n\r\n")
                    try:
                        payload = from_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body
                    except ValueError:
                        complete = False
                digest = _digest
                if payload is not None:
                    digest = _digest32(hashlib.sha1(payload).digest())
                    complete = complete and digest == _digest
                rows.append((page, url, kind, digest, refers, copies, complete, None if payload is None else len(payload), payload if with_payload else None))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PAGE.split(", ")])

    return map_arrow(grouped, join, PAGE, 256)


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """One row per written record, revisits with the size of the payload that they refer to."""
    pages = materialise(pages.drop("payload"), "warc-pages")
    sizes = materialise(
        pages.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
        .join(pages.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("held_bytes")), ["refers_to", "payload_digest"]).distinct()
        .withColumnsRenamed({"refers_to": "held_by", "payload_digest": "held_digest"}),
        "warc-sizes",
    )
    full = pages.join(sizes, (F.col("refers_to") == F.col("held_by")) & (F.col("payload_digest") == F.col("held_digest")), "left")
    return full.withColumn("payload_bytes", F.coalesce("payload_bytes", "held_bytes")).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_", "copies", "held_by", "held_digest", "held_bytes")


def round_trip(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    manifest = write_archives(pages, None, min_bytes, segment_bytes, archive_bytes)
    return resolve_revisits(reassemble(read_records(manifest), with_payload=False))
