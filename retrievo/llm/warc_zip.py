"""Web archives packed as ZIP files: written by tasks, read back by byte ranges without extraction.

An archive holds two stored members: gzip'd WARC records one after the other, and an index line for each record. Reading
takes two passes. The first parses each archive's directory and its index and gives ranges of neighbouring records; the
second, spread anew over all tasks, reads each range and its records. No task holds more than one range.

Archives lie in the shared staging folder and are opened by URI, so any store that pyarrow knows will do.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.llm import zip_reader
from retrievo.staging import new_stage_path, stage

LEAST_BYTES = 100           # shorter payloads are never replaced by a revisit
ARCHIVE_BYTES = 256 << 20   # a task begins another archive beyond it
RANGE_BYTES = 4 << 20       # neighbouring records that are read at once
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_DATE = "2026-01-01T00:00:00Z"
_PLAN = "path string, start long, size long, lengths array<long>"
_PLAN_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
                         ("lengths", pa.list_(pa.int64()))])
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                         ("html", pa.string())])


def _open(path: str):
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if revisit else head + payload
    named = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"),
             ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload)),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if url is not None:
        named.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        named.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        named.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    lines = "".join(f"{k}: {v}\r\n" for k, v in named)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One ZIP file being written as a stream; the index is kept packed until the records are complete."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store, inside = _open(self.path)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(inside)
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Forward(self.out)), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.records = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.index, self.size = io.BytesIO(), 0

    def add(self, page: int | None, record: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.records.write(packed)
        self.index.write(json.dumps({"id": page, "offset": self.size, "length": len(packed)}).encode() + b"\n")
        self.size += len(packed)

    def close(self) -> str:
        self.records.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(self.index.getvalue())
        under = self.zip.fp
        self.zip.close()
        under.flush()
        self.out.close()
        return self.path


class _Forward(io.RawIOBase):
    """A pyarrow stream as an unseekable Python file."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row, ``path``, for each archive written; the rows of ``pages`` are written once each.

    Of rows with equal payloads of at least ``LEAST_BYTES`` those with the smallest id are responses, the others revisit
    it; shorter payloads are always responses. A null payload is empty. Rows that repeat the smallest id are responses
    all; a row without an id revisits a row that has one. Control characters of a URL are percent-encoded. A repeated
    task writes archives of its own names, and only the paths of the attempt that counted are returned.
    """
    held = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = stage(held.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest")
                  .agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows"))
                  .where("rows > 1 and first_id is not null").drop("rows"), "repeated-payloads")
    held = held.join(first, "digest", "left")
    folder = new_stage_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)

    def write(batches):
        archive = None
        for batch in batches:
            for page, address, text, digest, of in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "html", "digest", "first_id"))):
                archive = archive or _Archive(folder)
                archive.add(page, _record(page, address, text.encode(), of, of is not None and page != of, digest))
                if archive.size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": [archive.close()]})
                    archive = None
        if archive:
            yield pa.RecordBatch.from_pydict({"path": [archive.close()]})

    return stage(held.select("page_id", "url", "html", "digest", "first_id").mapInArrow(write, "path string"), "archives")


def _ranges(batches):
    """Neighbouring records of every archive, from its directory and its index."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inside = _open(path)
            with store.open_input_file(inside) as file:
                found = {m.name: m for m in zip_reader.members(file) if m.name in (RECORDS, INDEX)}
                records, index = found[RECORDS], found[INDEX]
                if records.method or index.method:
                    raise ValueError(f"{path}: members are compressed; only stored ones can be read by range")
                for start, lengths in _neighbours(_index_lines(file, index)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([records.start + start]), pa.array([sum(lengths)]),
                         pa.array([lengths], pa.list_(pa.int64()))], schema=_PLAN_ARROW)


def _index_lines(file, member: zip_reader.Member):
    """(offset, length) of every record; the index is read in pieces."""
    at, rest = member.start, b""
    end = member.start + member.packed
    while at < end:
        file.seek(at)
        piece = file.read(min(1 << 20, end - at))
        at += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            entry = json.loads(line)
            yield entry["offset"], entry["length"]


def _neighbours(entries):
    start, lengths, size = None, [], 0
    for offset, length in entries:
        if lengths and (offset != start + size or size + length > RANGE_BYTES):
            yield start, lengths
            lengths, size = [], 0
        if not lengths:
            start = offset
        lengths.append(length)
        size += length
    if lengths:
        yield start, lengths


def _parse(record: bytes):
    """A record's fields and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record where the index says")
    named = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(named["Content-Length"])]
    return named, block.partition(b"\r\n\r\n")[2]


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _records(batches):
    for batch in batches:
        for row in batch.to_pylist():
            store, inside = _open(row["path"])
            with store.open_input_file(inside) as file:
                file.seek(row["start"])
                data = file.read(row["size"])
            at, out = 0, []
            for length in row["lengths"]:
                named, payload = _parse(zlib.decompress(data[at:at + length], 31))
                at += length
                revisit = named["WARC-Type"] == "revisit"
                digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{row['path']}: the payload of {named['WARC-Record-ID']} is not what was written")
                out.append((_page(named["WARC-Record-ID"]), named.get("WARC-Target-URI"),
                            int(named["WARC-Payload-Length"]) if revisit else len(payload), digest, named["WARC-Type"],
                            _page(named.get("WARC-Refers-To")), None if revisit else payload.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ_ARROW)],
                                             schema=_READ_ARROW)


def read_archives(paths: DataFrame) -> DataFrame:
    """Every record of the archives in ``path``: page, URL, digest and length of the full payload, type, target, payload.

    ``html`` is null for revisits. A file that is no ZIP archive, has compressed members or other bytes than its
    directory and index say raises an error. An empty table of paths gives no rows.
    """
    tasks = paths.sparkSession.sparkContext.defaultParallelism
    plan = stage(paths.repartition(tasks, "path").mapInArrow(_ranges, _PLAN), "ranges")
    return plan.repartition(4 * tasks, "path", "start").mapInArrow(_records, _READ)
