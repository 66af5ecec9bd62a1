"""WARC archives packed in ZIP files, and a reader that never unpacks them.

A package is a ZIP whose members are stored, not deflated: `archive/data.warc.gz` (one gzip
member a record) and `indexes/index.cdxj` (a CDXJ line a record: sort key, time, JSON with its place). The reader
parses the end-of-central-directory record, the ZIP64 locator and directory where present,
and the central directory; it finds where a stored member's bytes begin from its local
header, and then reads records by byte ranges of the package.

Files are reached through `pyarrow.fs` by URI, in the shared folder.

Defined cases: a null payload is empty. Pages with the same id are separate records
(each a response where that id is the smallest of its payload). Payloads that are equal share one response, that of the smallest id, the
rest are revisits (from `min_revisit` bytes on). Null ids sort last. Empty tables make no
records. Columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

tk.ship(__name__)

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
_U32, _U16 = 0xFFFFFFFF, 0xFFFF


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -------------------------------------------------------------------------


def record(kind: str, target: str, record_id: str, digest: str, payload: bytes, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that keeps only its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if _}


def parse_record(data: bytes) -> Record:
    """A record from its bytes (plain, or one gzip member)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(lines[1:])
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record is cut short")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return Record(headers, _fields(http.decode("latin-1").split("\r\n")[1:]), payload)


# --- ZIP -----------------------------------------------------------------------------


def local_header(name: str, crc: int, size: int) -> bytes:
    """Local header of a stored member; sizes beyond 32 bits go to a ZIP64 field."""
    big = size >= _U32
    extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
    raw = name.encode()
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, min(size, _U32), min(size, _U32), len(raw), len(extra)) + raw + extra


def directory(members: list[tuple[str, int, int, int]], at: int, zip64: bool = False) -> bytes:
    """Central directory for (name, crc, size, offset), with ZIP64 records where a field is too small or on demand."""
    out = b""
    for name, crc, size, offset in members:
        wide = [v for v in (size, size, offset) if v >= _U32] if not zip64 else [size, size, offset]
        extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
        small = lambda v: _U32 if zip64 or v >= _U32 else v
        raw = name.encode()
        out += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, small(size), small(size), len(raw), len(extra), 0, 0, 0, 0, small(offset)) + raw + extra
    n, size = len(members), len(out)
    if zip64 or n >= _U16 or size >= _U32 or at >= _U32:
        end = at + size
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        n, size, at = _U16, _U32, _U32
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, at, 0)


class ZipReader:
    """Stored members of a ZIP by byte ranges; `read(offset, length)` is all it needs."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - _U16)
        tail = read(tail_at, size - tail_at)
        at = len(tail) - 22
        while at >= 0 and not (tail[at : at + 4] == b"PK\x05\x06" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at + 3) if at > 0 else -1
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        locator = tail_at + at - 20
        if locator >= 0 and (raw := read(locator, 20))[:4] == b"PK\x06\x07":
            end = struct.unpack_from("<Q", raw, 8)[0]
            z = read(end, 56)
            if z[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points at no directory record")
            n, length, start = struct.unpack_from("<QQQ", z, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}  # name: method, crc, stored size, header's offset
        raw, p = read(start, length), 0
        for _ in range(n):
            sig, method, crc, packed, plain, nn, ne, nc, offset = struct.unpack_from("<I6xH4xIIIHHH8xI", raw, p)
            if sig != 0x02014B50:
                raise ValueError("the central directory is damaged")
            name, extra = raw[p + 46 : p + 46 + nn].decode(), raw[p + 46 + nn : p + 46 + nn + ne]
            q = 0
            while q + 4 <= len(extra):
                tag, size_ = struct.unpack_from("<HH", extra, q)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, q + 4))
                    plain = next(wide) if plain == _U32 else plain
                    packed = next(wide) if packed == _U32 else packed
                    offset = next(wide) if offset == _U32 else offset
                q += 4 + size_
            self.members[name] = (method, crc, packed, offset)
            p += 46 + nn + ne + nc

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, _, size, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed by the package; only stored members can be read by range")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        nn, ne = struct.unpack_from("<HH", head, 26)
        return offset + 30 + nn + ne, size


# --- writing -------------------------------------------------------------------------

_WRITTEN = "package string, records long, bytes long"
_ROLL = 256 << 20  # a task starts a new package beyond so many bytes


def sort_key(url: str) -> str:
    """A URL with its host's labels the other way round, lower-cased, as indexes sort by it."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:  # no URL at all
        return url.lower().replace(" ", "%20")
    rest = parts.path + (f"?{parts.query}" if parts.query else "")
    return (f"{host}){rest or '/'}" if host else url).lower().replace(" ", "%20")


def index_lines(entries: list[tuple[str, str, str, int, int]]) -> bytes:
    """CDXJ: sort key, time and JSON of each record (id, url, type, offset, length), in sorted order."""
    day = re.sub(r"\D", "", DATE)
    line = lambda i, url, kind, a, n: json.dumps({"url": url, "id": i, "type": kind, "offset": str(a), "length": str(n), "filename": DATA.split("/")[-1]})
    return "".join(sorted(f"{sort_key(e[1])} {day} {line(*e)}\n" for e in entries)).encode()


def _write_package(fs, path: str, data_path: str, entries: list[tuple[str, str, str, int, int]], crc: int, size: int) -> int:
    """Pack a finished data file and its index. The data is copied through in blocks."""
    lines = index_lines(entries)
    icrc = zlib.crc32(lines)
    with fs.open_output_stream(path) as out:
        head = local_header(DATA, crc, size)
        out.write(head)
        with fs.open_input_stream(data_path) as src:
            while block := src.read(1 << 22):
                out.write(block)
        second = len(head) + size
        head2 = local_header(INDEX, icrc, len(lines))
        out.write(head2 + lines)
        at = second + len(head2) + len(lines)
        end = directory([(DATA, crc, size, 0), (INDEX, icrc, len(lines), second)], at, zip64=True)
        out.write(end)
    fs.delete_file(data_path)
    return at + len(end)


def _writer(root: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        task = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}" if ctx else "0"
        out: list[tuple[str, int, int]] = []  # packages
        stream, entries, crc, size, number = None, [], 0, 0, 0

        def close():
            nonlocal stream, entries, crc, size, number
            stream.close()
            path = f"{base}/{task}-{number}.zip"
            n = _write_package(fs, path, f"{base}/{task}-{number}.part", entries, crc, size)
            out.append((path, len(entries), n))
            stream, entries, crc, size, number = None, [], 0, 0, number + 1

        for batch in batches:
            for pid, url, html, refers in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
                if stream is None:
                    stream = fs.open_output_stream(f"{base}/{task}-{number}.part")
                payload = (html.as_py() or "").encode()
                kind, rid = ("revisit" if refers is not None else "response"), "null" if pid is None else str(pid)
                target = quote(url or f"urn:page:{rid}", safe=":/?#[]@!$&'()*+,;=%~")
                packed = gzip.compress(record(kind, target, rid, sha1_base32(payload), payload, len(payload), refers), level, mtime=0)
                stream.write(packed)
                entries.append((rid, target, kind, size, len(packed)))
                crc, size = zlib.crc32(packed, crc), size + len(packed)
                if size >= _ROLL:
                    close()
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["package", "records", "bytes"])

    return run


def dedup(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int, salts: int = 16) -> DataFrame:
    """The pages with `digest` and `refers_to` (as text; null for a response).

    Copies are found from digests alone: one row a group of two and more, spread over salts,
    joins back, so that neither side gathers a large group in one task.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.withColumn("_size", F.length(payload)).withColumn("_sha1", F.sha1(payload)).withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    groups = keyed.where(F.col("_size") >= min_revisit).groupBy("_sha1").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("_n")
    return keyed.join(groups, ["_sha1", "_salt"], "left")


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, level: int = 1) -> DataFrame:
    """Write every page as a record of a package under `root`; returns (package, records, bytes), written once."""
    pages = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(payload_col).cast("string").alias("_html"))
    rows = dedup(pages, "_id", "_html", min_revisit)
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    ready = rows.select("_id", "_url", "_html", refers.alias("refers"))
    return ready.mapInArrow(_writer(root, level), _WRITTEN)


# --- reading -------------------------------------------------------------------------


def _indexer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    z = ZipReader(lambda a, n, f=f: f.read_at(n, a), f.size())
                    start, _ = z.locate(DATA)
                    at, size = z.locate(INDEX)
                    lines = f.read_at(size, at)
                if zlib.crc32(lines) != z.members[INDEX][1]:
                    raise ValueError(f"the index of {path} is damaged")
                places = sorted((int(e["offset"]), int(e["length"])) for e in (json.loads(x.split(b" ", 2)[2]) for x in lines.splitlines()))
                starts, lengths = [], []
                for a, n in places:  # neighbours go together, as far as a range goes
                    if starts and a == after and after - starts[-1] < _RANGE:
                        lengths[-1].append(n)
                    else:
                        starts.append(a)
                        lengths.append([n])
                    after = a + n
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([path] * len(starts), [start + a for a in starts], lengths), kinds, strict=True)], names=["package", "start", "lengths"])

    return run


_RANGE = 2 << 20  # neighbouring records are fetched together, about so many bytes at a time


def _reader(root: str, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    data = memoryview(f.read_at(sum(lengths), at))
                cols: list[list] = [[] for _ in range(7)]
                end = 0
                for n in lengths:  # one gzip member a record
                    begin, end = end, end + n
                    r = parse_record(zlib.decompress(data[begin:end], 31))
                    digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
                    kind, size = r.headers["warc-type"], int(r.http["content-length"])
                    if kind == "response" and (len(r.payload) != size or sha1_base32(r.payload) != digest):
                        raise ValueError(f"a record of {path} is damaged")
                    rid, refers = (r.headers.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
                    row = (None if rid == "null" else rid, r.headers["warc-target-uri"], size, digest, kind, refers or None, r.payload if keep_payload and kind == "response" else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["record_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def read_archives(packages: DataFrame, root: str, keep_payload: bool = True) -> DataFrame:
    """Every record of the packages (column `package`), by ranges found from each package's directory and index.

    A revisit has no payload of its own; its size and digest are those of the response it refers to.
    """
    spark = packages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = packages.select("package").repartition(n, "package").mapInArrow(_indexer(root), "package string, start long, lengths array<bigint>")
    return ranges.repartition(n, "package", "start").mapInArrow(
        _reader(root, keep_payload), "record_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )
