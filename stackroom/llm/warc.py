"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own, whose extra field holds the member's offset in the archive. The reader's
tasks get byte ranges: a task scans its range for gzip magic, accepts a candidate if the member's decoded header is
one of a WARC record (and the member names this very offset, where it names one, so that an archive inside a payload is
no record), and owns the records that start in its range, reading past its end for the last.

Nothing is lost in silence: an archive has to begin with a record, and each record to be followed by another one or by
the archive's end, which the task that owns it checks. A damaged member raises an error, or is skipped with
strict=False.

Archives are written by tasks under names of their own, and only those that a finished task reports are read, so a
task that is run again leaves at most a file that nobody reads.

Defined results: a null html is an empty payload, a null url an empty one; a null page_id stays null. Of records with
equal payloads of at least MIN_REVISIT bytes the largest page_id is the response. Rows that repeat a page_id are
records of their own; where they share the largest page_id they are all responses. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_dir, small_batches

MIN_REVISIT = 1000
#: Bytes of a reader's range.
SPLIT = 8 << 20
#: An archive is closed once it holds so many bytes.
ROLL = 256 << 20
#: Longest header that the reader looks through.
MAX_HEADER = 1 << 20
#: Groups of equal payloads up to this many are sent to all tasks; beyond, pages meet them by a salted join.
SMALL_GROUPS, SALTS = 50_000, 16
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def assign(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to: the page_id of the response for a revisit, else null."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload")
    groups = rows.filter(size >= MIN_REVISIT).select("page_id", F.sha2("payload", 256).alias("key")).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    groups = checkpoint(groups)
    keyed = rows.withColumn("key", F.when(size >= MIN_REVISIT, F.sha2("payload", 256)))
    if groups.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS:
        found = keyed.join(F.broadcast(groups), "key", "left")
    else:  # short payloads get a key of their own and large groups are salted, so that they don't meet in one task
        own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string"))
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = keyed.withColumns({"key": F.coalesce("key", own), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")}).join(salted, ["key", "salt"], "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


#: Characters of a URL that stay as they are.
_PLAIN = ":/?#[]@!$&()*+,;=~"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url, safe=_PLAIN + '%')}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head.append(f"X-Page-Url: {quote(url, safe=_PLAIN)}")  # what a percent sign stands for can't be told from the URI
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(body: bytes, offset: int) -> bytes:
    """A gzip member whose extra field (subfield WO) says where it starts."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    extra = b"WO" + struct.pack("<HQ", 8, offset)
    head = _MAGIC + b"\x04" + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + deflate.compress(body) + deflate.flush() + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of `assign`; (path, size, records) of each archive, checkpointed, so written once."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(folder)
        out, name, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "size", "records"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, size, count = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                made = member(record(page_id, url, payload, refers_to), size)
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= ROLL:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return checkpoint(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, size long, records long"))


class Window:
    """Bytes of a file from any offset, read in chunks."""

    def __init__(self, file, chunk: int = 1 << 20):
        self.file, self.chunk, self.start, self.data = file, chunk, 0, b""

    def at(self, offset: int, size: int) -> bytes:
        if not (self.start <= offset and offset + size <= self.start + len(self.data)):
            self.start, self.data = offset, self.file.read_at(max(self.chunk, size), offset) if offset < self.file.size() else b""
        return self.data[offset - self.start : offset - self.start + size]


def starts_record(w: Window, offset: int) -> bool:
    """Does a gzip member start here whose decoded header is that of a WARC record?"""
    head = w.at(offset, 512)
    if not head.startswith(_MAGIC):
        return False
    if len(head) > 24 and head[3] & 4 and head[12:16] == b"WO\x08\0" and struct.unpack("<Q", head[16:24])[0] != offset:
        return False
    gz, text, at = zlib.decompressobj(31), b"", offset
    try:
        while b"\r\n\r\n" not in text and not gz.eof and len(text) < MAX_HEADER and head:
            text += gz.decompress(head, 1 << 12)
            while gz.unconsumed_tail and b"\r\n\r\n" not in text and len(text) < MAX_HEADER:
                text += gz.decompress(gz.unconsumed_tail, 1 << 12)
            if not text.startswith(b"WARC/1."[: len(text)]):
                return False
            at += len(head)
            head = w.at(at, 1 << 12)
    except zlib.error:
        return False
    fields = {line.partition(b":")[0].lower() for line in text.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]}
    return text.startswith(b"WARC/1.") and {b"warc-type", b"warc-record-id", b"content-length"} <= fields


def inflate(w: Window, offset: int) -> tuple[bytes, int] | None:
    """The member's content and where it ends; None if it is damaged."""
    gz, out, at = zlib.decompressobj(31), [], offset
    try:
        while not gz.eof:
            part = w.at(at, 1 << 16)
            if not part:
                return None
            out.append(gz.decompress(part))
            at += len(part) - len(gz.unused_data)
    except zlib.error:
        return None
    return b"".join(out), at


def scan(file, start: int, end: int, strict: bool = False) -> Iterator[bytes]:
    """Contents of the records that start in [start, end). strict: see to it that none is lost."""
    w, at, size = Window(file), start, file.size()
    sure = strict and start == 0 < size  # a record has to be here
    while at < end or (sure and at < size):
        if not starts_record(w, at):
            if sure:
                raise ValueError(f"no record at byte {at}, where one has to be")
            # Magic may straddle two chunks: they overlap by two bytes.
            part = w.at(at + 1, min(1 << 16, end - at + 1))
            found = part.find(_MAGIC)
            if found >= 0:
                at += 1 + found
            elif len(part) < 3:
                return
            else:
                at += len(part) - 1
            continue
        if at >= end:
            return  # the next range's
        got = inflate(w, at)
        if got is None:
            if strict:
                raise ValueError(f"the record at byte {at} is damaged")
            at += 1
            continue
        yield got[0]
        at, sure = got[1], strict


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields.get("Content-Length", len(rest)))]


def read(archives: DataFrame, folder: str, split: int = SPLIT, payloads: bool = True, strict: bool = True) -> DataFrame:
    """page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to of each record.

    strict: a lost or damaged record is an error, and so is an archive that was cut or grew since it was written.
    """
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("end"), "size").repartition(F.xxhash64("path", "start"))
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def row(raw: bytes) -> tuple:
        fields, block = parse(raw)
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        kind, payload, size = fields["WARC-Type"], None, int(fields["X-Payload-Length"])
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"the payload of page {page} differs from its digest")
        return None if page is None else int(page), unquote(fields["X-Page-Url"]), kind, payload if payloads else None, size, digest, None if other is None else int(other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(folder)
        for batch in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{base}/{path}") as file:
                    if strict and file.size() != size:
                        raise ValueError(f"{path} has {file.size()} bytes, not the {size} that were written")
                    rows = []
                    for raw in scan(file, start, end, strict):
                        rows.append(row(raw))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write pages to archives in folder, or in a new one of the shared folder."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return write(assign(pages), folder), folder
