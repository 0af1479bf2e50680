"""WARC archives: writing with payload revisits, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm._shared import scratch_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
MEMBER = 8 << 20
RANGE = 16 << 20
STEP = 1 << 14
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class Damaged(ValueError):
    """A member or record that can't be decoded."""


def _members(block: bytes) -> bytes:
    """gzip members of at most MEMBER bytes of content: an uncompressed size
    below 16 MiB makes a member's last byte zero, see ``write_archives``."""
    out = []
    for i in range(0, len(block), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(block[i : i + MEMBER]) + z.flush())
    return b"".join(out)


def _line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def make_record(page_id: int | None, url: str | None, digest: str, size: int, kind: str, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record, compressed. A revisit has the HTTP head alone."""
    block = HTTP + (payload if kind == "response" else b"")
    ident = uuid.UUID(bytes=hashlib.md5(f"{page_id}/{digest}".encode()).digest())
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        other = uuid.UUID(bytes=hashlib.md5(f"{refers_to}/{digest}".encode()).digest())
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{other}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return _members("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write ``pages``(page_id, url, html) as .warc.gz content under ``path``, a file
    for each task.

    Payload: html as UTF-8, null as empty. Among payloads of at least ``least``
    bytes that are equal, the row with the largest page_id is the response and
    the others revisit it; rows that tie with it in page_id, too, are responses
    of their own; without any page_id all are. Smaller payloads are responses.

    Copies are found by partial aggregates of digests; the html goes through
    at most one shuffle, and not at all where the digests that occur more than
    once are few enough for Spark to send them round. The bytes go out through
    Spark's committed text writer: it puts the separator, one zero byte, after
    each row, and that is just the last byte of the row's last gzip member.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    heads = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    heads = heads.where("n > 1 AND head IS NOT NULL").select("sha1", "head")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    out = rows.join(heads, "sha1", "left").select(
        "page_id",
        "url",
        "sha1",
        "size",
        F.when(revisit, F.col("head")).alias("refers_to"),
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            for r in range(batch.num_rows):
                page_id, url, sha1, size, refers_to, payload = (batch.column(c)[r].as_py() for c in range(6))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = make_record(page_id, url, digest, size, "revisit" if payload is None else "response", refers_to, payload or b"")
                made.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    members = out.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").text(path)


class _Range:
    """Cached reads at any place of one file."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start = file, start
        file.seek(start)
        self.data = file.read(size)

    def read(self, at: int, n: int) -> bytes:
        i = at - self.start
        if i + n <= len(self.data):
            return self.data[i : i + n]
        self.file.seek(at)
        return self.file.read(n)


def _member(source: _Range, at: int, header_only: bytes = b"") -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and where it ends. Content that
    doesn't begin with ``header_only`` is refused as soon as that is seen."""
    z, out, got, step = zlib.decompressobj(31), [], 0, STEP
    while not z.eof:
        chunk = source.read(at, step)
        if not chunk:
            raise Damaged("cut off")
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        at += len(chunk)
        got += len(out[-1])
        if header_only and got >= len(header_only):
            out = [b"".join(out)]
            if not out[0].startswith(header_only):
                raise Damaged("no record starts here")
            header_only = b""
        step = min(1 << 20, 4 * step)
    if header_only:
        raise Damaged("no record starts here")
    return b"".join(out), at - len(z.unused_data)


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    head, found, block = content.partition(b"\r\n\r\n")
    if not found:
        raise Damaged("no end of the header")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no length")
    return fields, block


def scan_range(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of the records that begin in [start, end).

    Candidates are places of the gzip magic whose content decodes (with its
    checksum) and begins like a record header. A record may reach beyond the
    range and over several members. After a record the scan goes on where it
    ends; magic bytes inside compressed data are refused by decoding.
    """
    source, at = _Range(file, start, end - start + len(MAGIC) - 1), start
    while True:
        i = source.data.find(MAGIC, at - start)
        if i < 0 or start + i >= end:
            return
        at = start + i
        try:
            content, after = _member(source, at, VERSION)
            fields, block = parse_record(content)
            length, parts, got = int(fields["content-length"]), [block], len(block)
            while got < length:
                more, after = _member(source, after)
                parts.append(more)
                got += len(more)
            yield fields, b"".join(parts)[:length]
            at = after
            if at >= end:
                return
        except Damaged:
            at += 1


def open_input(uri: str):
    """Open a file for reads at any place, on whatever store pyarrow knows."""
    if re.match(r"^(file:)?/", uri):
        store, path = fs.FileSystem.from_uri("file://" + re.sub(r"^(file:)?/+", "/", uri))
    else:
        store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_archives(spark, path: str, range_bytes: int = RANGE, opener: Callable = open_input) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of
    all records under ``path``.

    Files are listed by Spark (names and lengths, no content) and cut in byte
    ranges; each task owns the records that begin in its ranges, so one large
    archive is read by many tasks and no record twice. A response's length and
    digest are of the bytes read (a digest other than in the header raises); a
    revisit's are those in its header, of the full payload, and its payload is
    null.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def number(text: str | None) -> int | None:
        return int(text) if text is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        rows, held = [], 0
        for batch in batches:
            for uri, start, end in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with opener(uri) as file:
                    for fields, block in scan_range(file, start, end):
                        kind = fields.get("warc-type", "")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        payload, size = None, number(fields.get("x-payload-length"))
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest and digest != real:
                                raise Damaged(f"the payload of page {fields.get('x-page-id')} has digest {real}, its header {digest}")
                            digest = real
                        rows.append((number(fields.get("x-page-id")), size, digest, kind, number(fields.get("x-refers-to-page")), payload))
                        held += len(payload or b"")
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield flush(rows)
                            rows, held = [], 0
        if rows:
            yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("length"), F.col("start") + range_bytes).alias("end"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of ``pages`` in the shared folder and read them back: a row for
    each page, with its payload (null for revisits). Empty table: no rows."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
