"""WARC archives: a writer with one gzip member a record, and a reader that salvages damaged files.

The reader checks each member (gzip checksum, version line, Content-Length, payload digest). After a failed check it
searches for the next place where a member unpacks to a version line (or, in uncompressed files, for the next version
line), reads on from there, and reports the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import file_contents, shared_dir, written

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
SIZE = re.compile(r"\d{1,18}")
#: An archive is closed once it holds this many bytes.
ROLL_BYTES = 16 << 20
#: A member is unpacked in slices of the archive of this many bytes, so reading takes time in proportion to the bytes.
SLICE = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the uncompressed record at ``at``; ValueError with the failed check."""
    if not VERSION.match(raw, at):
        raise ValueError("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("unfinished header")
    headers = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header line")
        headers[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not SIZE.fullmatch(headers.get("content-length", "")):
        raise ValueError("no content length")
    stop = end + 4 + int(headers["content-length"])
    if not raw.startswith(b"\r\n\r\n", stop):
        raise ValueError("block does not match its content length")
    block = raw[end + 4 : stop]
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("block digest differs")
    return headers, block, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """Unpacked bytes of the gzip member at ``at`` and its end; ValueError if it fails its check."""
    unpack, view, parts = zlib.decompressobj(31), memoryview(data), []
    while not unpack.eof:
        if at >= len(data):
            raise ValueError("gzip member is unfinished")
        piece = view[at : at + SLICE]
        at += len(piece)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as e:
            raise ValueError("gzip member fails its check") from e
    return b"".join(parts), at - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive in order, and a gap for every stretch of bytes that belongs to none."""
    at, bad, reason, line, packed_at = 0, None, "", -1, -1
    while at < len(data):
        packed = data.startswith(MAGIC, at)
        try:
            if packed:
                raw, end = _member(data, at)
                headers, block, used = _parse(raw)
                if used != len(raw):
                    raise ValueError("bytes after the record in its member")
            else:
                headers, block, end = _parse(data, at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            if line <= at:  # else the version line found before is still ahead
                found = VERSION.search(data, at + 1)
                line = found.start() if found else len(data)
            if packed_at <= at:
                packed_at = data.find(MAGIC, at + 1)
                packed_at = packed_at if packed_at >= 0 else len(data)
            at = min(line, packed_at)
            continue
        if bad is not None:
            yield Gap(bad, at - bad, reason)
            bad = None
        yield Record(at, end - at, headers, block)
        at = end
    if bad is not None:
        yield Gap(bad, len(data) - bad, reason)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` (a URI that all executors share) and return their manifest, itself written.

    Payload is the html in UTF-8, null counts as empty. Of pages with equal payloads the smallest page_id (null last)
    is the response and the others revisit it. Each task attempt writes files of its own names; only those of the
    attempts that Spark accepted are in the manifest (file, records, bytes), and only those are read.
    """
    keyed = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # rows that repeat a page id repeat its record: only another page is a revisit
    marked = keyed.join(firsts, "sha", "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in (row for lo in range(0, batch.num_rows, 256) for row in batch.slice(lo, 256).to_pylist()):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(marked.mapInArrow(write, "file string, records bigint, bytes bigint"))


READ = "file string, offset bigint, length bigint, gap string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, target_uri string, payload binary"


def read_archives(spark, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """A row for each record and for each quarantined gap (``gap`` tells the failed check; record columns are null there).

    A revisit's payload length is the Content-Length of its HTTP header. A response whose payload does not have the
    digest it states is a gap as well. ``manifest`` limits the files to those of accepted task attempts: one of them that is
    not there is an error, and one that is shorter than it was written ends in a gap.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in READ.split(", ")])
        for batch in batches:
            for name, data, size in zip(*(batch.column(c).to_pylist() for c in ("file", "content", "bytes")), strict=True):
                rows, held = [], 0
                if size is not None and len(data) < size:
                    rows.append({"file": name, "offset": len(data), "length": size - len(data), "gap": "file ends early"})
                for x in salvage(data):
                    row = {"file": name, "offset": x.offset, "length": x.length} | ({"gap": x.reason} if isinstance(x, Gap) else _columns(x, payloads))
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = file_contents(spark, folder, "*.warc*", manifest)
    files = files.withColumn("bytes", F.lit(None).cast("long")) if manifest is None else files.join(manifest.select("file", "bytes"), "file")
    return files.select("file", "content", "bytes").mapInArrow(read, READ)


def _columns(x: Record, payloads: bool) -> dict:
    head, _, payload = x.block.partition(b"\r\n\r\n")
    kind, stated = x.headers.get("warc-type"), x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and stated and digest(payload) != stated:
        return {"gap": "payload digest differs"}
    number = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x.headers.get(key, ""))) else None
    size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return {
        "page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"),
        "payload_bytes": len(payload) if kind == "response" else int(size[1]) if size else None,
        "payload_digest": stated or digest(payload), "target_uri": x.headers.get("warc-target-uri"), "payload": payload if payloads else None,
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Repeated page ids give one record each; a row with a null page_id has a record whose id is not a number and comes
    back with a null page_id. An empty table gives no archive and no row; other columns are ignored. A gap in what was
    just written is an error, not a missing row.
    """
    folder = shared_dir(pages.sparkSession)
    manifest = write_archives(pages, folder)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    rows = read_archives(pages.sparkSession, folder, manifest, payloads=False)
    damaged = F.raise_error(F.concat_ws(" ", F.lit("damaged:"), "file", "offset", "gap")).cast("bigint")
    return rows.select(F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(damaged).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
