"""WARC archives: a writer with revisit records, and a salvage reader.

Writer: a gzip member for each record, files of bounded size in a shared folder, written by the tasks that hold the rows. Of records with
equal payloads of at least `least` bytes, that with the smallest id is a `response`, others are `revisit` records that refer to it. Only the
files named in the manifest count: each attempt of a task writes files of its own, so a lost executor or a repeated task adds no records.

Salvage reader: a record is valid if its member decompresses, its version line and headers parse, its block has the stated length and its
payload the stated digest (sha1, md5, sha256 or sha512, as hexadecimal digits or base32 of either case; others aren't checked). A member may
hold several records: the first one has the member's place and length, further ones its place and length 0. After a failed check the reader searches for the next valid member (or, in uncompressed files, version line),
goes on from there, and logs the bytes between as a quarantined gap with a reason; within a member at its next version line, with a gap of
length 0. A file is read through a window that holds the record at
hand and no more, so archives of any size need the memory of their largest record. Headers of more than HEADER_BYTES fail the check.

Null payloads are empty. A null id is no one's smallest id, unless all are null; then all are responses. Repeated rows with the smallest id
are all responses. Null addresses are written without WARC-Target-URI. Other columns are ignored. An empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .cluster import shared_dir, written

GZ, VERSION = b"\x1f\x8b\x08", b"WARC/1."
HEAD = b"\r\n\r\n"
STEP, PIECE, HEADER_BYTES = 1 << 20, 1 << 16, 1 << 20
LENGTH = re.compile(rb"(?mi)^content-length:\s*(\d{1,18})\s*$")
RECORD = "path string, offset long, length long, reason string, warc_type string, record_id string, uri string, date string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to long"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
RECORD_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(NAMES, RECORD.split(", "), strict=True)])


def filesystem(uri: str):
    """(file system, path) of any store that pyarrow knows; local paths without one."""
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    fs, path = filesystem(uri)
    if fs is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


class Window:
    """The bytes of a file, read on demand. `keep` forgets what lies before a place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, bytearray()

    def fill(self, end: int) -> None:
        while self.base + len(self.held) < min(end, self.size):
            more = self.file.read(max(STEP, min(end, self.size) - self.base - len(self.held)))
            if not more:
                self.size = self.base + len(self.held)
            self.held += more

    def get(self, start: int, end: int) -> bytes:
        self.fill(end)
        return bytes(self.held[max(0, start - self.base) : max(0, end - self.base)])

    def find(self, mark: bytes, start: int, end: int | None = None, forget: bool = False) -> int:
        """The first `mark` that begins at `start` or later and ends by `end`, or -1."""
        end = self.size if end is None else end
        while True:
            self.fill(start + STEP)
            known = min(end, self.base + len(self.held))
            at = self.held.find(mark, start - self.base, known - self.base)
            if at >= 0:
                return at + self.base
            if known >= min(end, self.size):
                return -1
            start = max(start, known - len(mark) + 1)
            if forget:
                self.keep(start - 1)

    def peek(self, start: int, end: int) -> bytes:
        """The bytes from start to end without holding what lies before them."""
        if end <= self.base + len(self.held):
            return self.get(start, end)
        self.file.seek(start)
        out = self.file.read(end - start)
        self.file.seek(self.base + len(self.held))
        return out

    def keep(self, at: int) -> None:
        if at > self.base:
            del self.held[: at - self.base]
            self.base = at

    def rewind(self) -> None:
        if self.base:
            self.file.seek(0)
            self.base, self.held = 0, bytearray()


def opened(uri: str):
    """(file, size)"""
    fs, path = filesystem(uri)
    if fs is None:
        return open(path, "rb"), os.path.getsize(path)
    f = fs.open_input_file(path)
    return f, f.size()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def is_digest(stated: str, data: bytes) -> bool:
    """Whether data has the stated digest; unknown algorithms aren't checked."""
    name, _, value = stated.partition(":")
    if name.lower().replace("-", "") not in ("sha1", "md5", "sha256", "sha512"):
        return True
    d = hashlib.new(name.lower().replace("-", ""), data).digest()
    return value.lower() == d.hex() or value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=")


def bare_digest(stated: str) -> str | None:
    """A stated SHA-1 as upper-case base32, others as they are."""
    value = stated.removeprefix("sha1:")
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode()
    return (value.upper() if stated.startswith("sha1:") else value) or None


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}')}>"


def line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, uri: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record; `first` is the id that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    head += [f"WARC-Target-URI: {line(uri)}"] if uri is not None else []
    head += [f"X-Page-ID: {page}"] if page is not None else []
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + HEAD


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, to: str | None = None, least: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 32 << 20, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", compress: bool = True) -> DataFrame:
    """Writes archives below `to` (a shared folder; a new one by default) and returns the manifest: path, records, bytes."""
    spark = ship(pages.sparkSession)
    to = to or shared_dir(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    # only payloads that repeat come back to the rows; counted with map-side combining
    firsts = written(own.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first"))
    rows = own.join(firsts, "sha", "left").withColumn("first", F.when((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first")).cast("long"))

    def files(batches):
        out, path, records, size = None, "", 0, 0
        done = []
        for batch in batches:
            for page, uri, body, sha, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(page, uri, body, digest, first if len(body) >= least else None, date)
                data = member(data) if compress else data
                if out is None:
                    path = f"{to}/{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, records, size = create(path), 0, 0
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((path, records, size))
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return written(rows.select("page_id", "uri", "payload", "sha", "first").mapInArrow(files, "path string, records long, bytes long"))


def parse(data: bytes) -> tuple[dict, int]:
    """A record at the start of data: its columns and its length. Raises ValueError with the check that failed."""
    if not data.startswith(VERSION):
        raise ValueError("version")
    end = data.find(HEAD)
    if end < 0:
        raise ValueError("headers")
    head = {}
    for x in data[:end].split(b"\r\n")[1:]:
        k, colon, v = x.partition(b":")
        if not colon:
            raise ValueError("headers")
        head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
    try:
        n = int(head[b"content-length"])
        page, refers = (int(head[k]) if k in head else None for k in (b"x-page-id", b"x-refers-to-page-id"))
    except (KeyError, ValueError):
        raise ValueError("headers") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != HEAD:
        raise ValueError("length")
    kind, stated = head.get(b"warc-type"), head.get(b"warc-payload-digest", "")
    payload, size = block, None
    if head.get(b"content-type", "").startswith("application/http"):
        http, _, payload = block.partition(HEAD)
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()), None)
    stated_block = head.get(b"warc-block-digest", "")
    if not is_digest(stated_block, block):
        raise ValueError("block digest")
    if kind == "revisit":
        digest = bare_digest(stated)
    else:
        size, digest = len(payload), digest32(payload)
        if not is_digest(stated, payload):
            raise ValueError("payload digest")
    got = {"warc_type": kind, "record_id": head.get(b"warc-record-id"), "uri": head.get(b"warc-target-uri"), "date": head.get(b"warc-date"), "page_id": page, "payload": None if kind == "revisit" else payload, "payload_bytes": size, "payload_digest": digest, "refers_to": refers}
    return got, end + 8 + n


def one_member(window: Window, at: int) -> tuple[list[tuple[str | None, dict | None]], int]:
    """What the gzip member at `at` holds, records and gaps in order as (reason, columns), and the member's length. A member without any valid
    record fails as a whole."""
    z, parts, end = zlib.decompressobj(31), [], at
    while not z.eof:
        piece = window.get(end, end + PIECE)
        if not piece:
            raise ValueError("member")
        try:
            parts.append(z.decompress(piece))
        except zlib.error:
            raise ValueError("member") from None
        end += len(piece)
    body = b"".join(parts)
    found, i, why = [], 0, None
    while i < len(body):
        try:
            got, n = parse(memoryview(body)[i:].tobytes() if i else body)
            found.append((None, got))
            i += n
        except ValueError as e:
            why = why or str(e)
            found.append((str(e), None))
            i = body.find(b"\n" + VERSION, i) + 1 or len(body)
    if not any(got for _, got in found):
        raise ValueError(why or "version")
    return found, end - len(z.unused_data) - at


def one_plain(window: Window, at: int) -> tuple[list[tuple[str | None, dict | None]], int]:
    end = window.find(HEAD, at, at + HEADER_BYTES)
    if end < 0:
        raise ValueError("headers")
    stated = LENGTH.search(window.get(at, end + 2))
    stop = end + 4 if stated is None else end + 8 + int(stated[1])
    if stop > window.size or stated is not None and window.peek(stop - 4, stop) != HEAD:
        raise ValueError("length")  # before the block is read: a wrong length may name most of the file
    got, n = parse(window.get(at, stop))
    return [(None, got)], n


def is_packed(window: Window) -> bool:
    """Whether the first mark in the file is that of a gzip member."""
    if window.get(0, 2) == GZ[:2]:
        return True
    at, packed = 0, False
    while at < window.size:
        piece = window.get(at, at + STEP + len(VERSION))
        g, v = piece.find(GZ), piece.find(VERSION)
        if g >= 0 or v >= 0:
            packed = v < 0 or 0 <= g < v
            break
        at += STEP
        window.keep(at)
    window.rewind()
    return packed


def salvage(source: bytes | Window):
    """Records and gaps of an archive: (offset, length, reason, columns); reason is None for records, columns for gaps."""
    window = source if isinstance(source, Window) else Window(io.BytesIO(source), len(source))
    packed = is_packed(window)
    mark, read = (GZ, one_member) if packed else (VERSION, one_plain)
    at, lost, why = 0, None, None
    while at < window.size:
        window.keep(at)
        try:
            if window.get(at, at + len(mark)) != mark:
                raise ValueError("version" if not packed else "member")
            got, n = read(window, at)
        except ValueError as e:
            lost, why = (at, str(e)) if lost is None else (lost, why)
            at = window.find(mark, at + 1, forget=True)
            while not packed and at > 0 and window.get(at - 1, at) != b"\n":
                at = window.find(mark, at + 1, forget=True)
            if at < 0:
                break
            continue
        if lost is not None:
            yield lost, at - lost, why, None
            lost = None
        for k, (reason, columns) in enumerate(got):
            yield at, 0 if k else n, reason, columns
        at += n
    if lost is not None:
        yield lost, window.size - lost, why, None


def read(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Rows of RECORD for the archives named in column `path`: records (reason null) and quarantined gaps (reason set, the rest null)."""
    ship(spark)

    def records(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                file, length = opened(path)
                with file:
                    for at, n, why, got in salvage(Window(file, length)):
                        rows.append({"path": path, "offset": at, "length": n, "reason": why} | (got or {}))
                        size += len((got or {}).get("payload") or b"")
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(parts, "path").mapInArrow(records, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read(pages.sparkSession, write(pages))
    return back.where("reason is null").select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
