"""WARC records in ZIP packages: written as stored members with an index, read by ranges without extraction.

A package is a ZIP file with ``archive/data.warc.gz`` (each record a gzip member of its own), ``indexes/index.cdxj``
(offset and length of each record) and ``datapackage.json``, all stored and not compressed again. A reader takes the end
of a file, follows the central directory (ZIP64 records and fields included) to the members, reads the indexes and hands
out ranges of neighbouring records; tasks fetch and parse their ranges alone. Archive members that no index names are
scanned once for their records. Files are reached by pyarrow's file systems, so any store that it knows will do.
"""

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import cut, only, prepare, read

#: Bytes of archive and number of records in one package; bytes and records of one range; bytes of a read.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 1 << 20
RANGE_BYTES, RANGE_RECORDS, CHUNK = 4 << 20, 1 << 12, 1 << 17
#: Bytes that a reading task should fetch.
TASK_BYTES = 32 << 20
#: Rows of a table of repeated payloads that is broadcast at most.
BROADCAST_ROWS = 1 << 16
LEAST_BYTES = 100
MANIFEST = "path string, length long, records long"
RANGES = "path string, start long, gz boolean, lengths array<long>"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@lru_cache(maxsize=64)
def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


# ---- ZIP directories


class Member(NamedTuple):
    name: str
    stored: bool
    start: int  # of its data
    size: int


def directory(read_at: Callable[[int, int], bytes], size: int) -> Iterator[Member]:
    """Members of a ZIP file of ``size`` bytes, whose bytes ``read_at(start, length)`` fetches, in the order of its central
    directory. Reads the end, the directory in chunks, and a local header for each member. Bytes before the archive
    are allowed. A file that is no ZIP file, is cut short, or has an encrypted member is an error."""
    low = max(0, size - 65_557)
    tail = read_at(low, size - low)
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HLL", tail, at + 10)
    end = low + at
    locator = read_at(end - 20, 20) if end >= 20 else b""
    if locator[:4] == b"PK\6\7":
        where = struct.unpack_from("<Q", locator, 8)[0]
        wide = read_at(where, 56)
        if wide[:4] != b"PK\6\6":  # bytes before the archive move it
            where = end - 20 - 56
            wide = read_at(where, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of the central directory")
        n, length, start = struct.unpack_from("<QQQ", wide, 32)
        end = where
    shift = end - length - start
    if shift < 0:
        raise ValueError("the central directory does not fit the file")
    at, buffer, left = start + shift, b"", length
    for _ in range(n):
        while True:
            if len(buffer) >= 46:
                if buffer[:4] != b"PK\1\2":
                    raise ValueError("broken central directory")
                flags, method = struct.unpack_from("<HH", buffer, 8)
                packed, plain, a, b, c = struct.unpack_from("<LLHHH", buffer, 20)
                if len(buffer) >= 46 + a + b + c:
                    break
            if left <= 0:
                raise ValueError("broken central directory")
            more = read_at(at, min(CHUNK, left))
            buffer, at, left = buffer + more, at + len(more), left - len(more)
        name, extra = buffer[46 : 46 + a], buffer[46 + a : 46 + a + b]
        local = struct.unpack_from("<L", buffer, 42)[0]
        buffer = buffer[46 + a + b + c :]
        packed, local = _wide(extra, plain, packed, local)
        if flags & 1:
            raise ValueError(f"{name!r} is encrypted")
        head = read_at(local + shift, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{name!r} has no local header")
        x, y = struct.unpack_from("<HH", head, 26)
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method == 0, local + shift + 30 + x + y, packed)


def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
    """(packed size, local header) with the ZIP64 field in place of those that are all ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            out = [next(values) if v == 0xFFFFFFFF else v for v in (plain, packed, local)]
            return out[1], out[2]
        at += 4 + n
    return packed, local


# ---- records


def record(kind: str, record_id: str, uri: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its payload alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"") if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    head += [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))] if uri is not None else []
    head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)] if kind == "revisit" else []
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], memoryview, int]:
    """(fields, block, end) of the record at a place."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/", at) or end < 0:
        raise ValueError("no WARC record here")
    fields = _fields(data[at:end])
    stop = end + 4 + int(fields["content-length"])
    if len(data) < stop:
        raise ValueError("a WARC record is cut short")
    return fields, memoryview(data)[end + 4 : stop], stop + 4


def as_row(fields: dict[str, str], block: memoryview) -> tuple:
    """Values of RECORDS. Responses: of the payload itself, which must have the digest that the record names; others:
    digest and size as the record names them."""
    strip = lambda x: None if x is None else x.strip("<>")
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    digest = digest.removeprefix("sha256:") if digest.startswith("sha256:") else None
    http = fields.get("content-type", "").startswith("application/http")
    stop = bytes(block).find(b"\r\n\r\n") + 4 if http else 0
    payload, size = (bytes(block[stop:]), None) if kind in ("response", "resource") else (None, None)
    if payload is not None:
        own, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest not in (None, own):
            raise ValueError(f"{fields.get('warc-record-id')}: payload and digest differ")
        digest = own
    elif http:
        length = _fields(bytes(block[:stop])).get("content-length")
        size = int(length) if length else None
    return strip(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), strip(fields.get("warc-refers-to")), digest, size, payload


# ---- packages


class Package:
    """A package while it is written."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = store(self.path)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        self.size, self.lines, self.hash = 0, [], hashlib.sha256()

    def add(self, data: bytes, uri: str | None, date: str) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        self.hash.update(packed)
        host, _, path = (uri or "").partition("://")[2].partition("/")
        key = re.sub(r"[\x00-\x20]", "", ",".join(reversed(host.lower().split(":")[0].split("."))) + ")/" + path.lower())
        facts = {"url": uri, "filename": "data.warc.gz", "offset": str(self.size), "length": str(len(packed))}
        self.lines.append(f"{key} {re.sub('[^0-9]', '', date)} {json.dumps(facts)}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(sorted(self.lines)).encode()
        parts = [("data.warc.gz", "archive/data.warc.gz", self.hash.hexdigest(), self.size), ("index.cdxj", "indexes/index.cdxj", hashlib.sha256(index).hexdigest(), len(index))]
        facts = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": n, "path": p, "hash": f"sha256:{h}", "bytes": z} for n, p, h, z in parts]}
        for name, data in (("indexes/index.cdxj", index), ("datapackage.json", json.dumps(facts).encode())):
            with self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(data)
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, len(self.lines)


class _Stream(io.RawIOBase):
    """An output stream that can't go back, as object stores have them."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def write_packages(rows: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Write rows (record_id, kind, uri, payload, digest, size, refers_to) into packages in a folder that all executors
    share; (path, length, records) of the packages. Kinds: response and revisit. Each task writes files of its own names
    and only finished ones are listed, so a repeated task leaves a file that nobody reads, and no record twice."""

    def go(batches):
        package, done = None, []
        for b in batches:
            for r in b.to_pylist():
                package = package or Package(folder)
                package.add(record(r["kind"], r["record_id"], r["uri"], r["payload"], r["digest"], r["size"], r["refers_to"], date), r["uri"], date)
                if package.size >= package_bytes or len(package.lines) >= package_records:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "length", "records"])

    system, path = store(folder)
    system.create_dir(path)
    return cut(rows.select("record_id", "kind", "uri", "payload", "digest", "size", "refers_to").mapInArrow(go, MANIFEST))


def list_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path or pattern, without their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _index(lines: Iterator[bytes]) -> dict[str, np.ndarray]:
    """(offset, length) rows by archive name, in order, each once."""
    found: dict[str, list[tuple[int, int]]] = {}
    for line in lines:
        brace = line.find(b"{")
        if brace >= 0:
            x = json.loads(line[brace:])
            found.setdefault(x["filename"].rpartition("/")[2], []).append((int(x["offset"]), int(x["length"])))
    return {k: np.unique(np.array(v, dtype=np.int64).reshape(-1, 2), axis=0) for k, v in found.items()}


def _lines(read_at, m: Member) -> Iterator[bytes]:
    rest, unpack = b"", zlib.decompressobj(31) if m.name.endswith(".gz") else None
    for at in range(0, m.size, CHUNK):
        data = read_at(m.start + at, min(CHUNK, m.size - at))
        if unpack:
            out = []
            while data:
                out.append(unpack.decompress(data))
                data = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            data = b"".join(out)
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _scan(read_at, m: Member) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a member without an index, in bounded memory."""
    if not m.name.endswith(".gz"):
        at = 0
        while at < m.size:
            head = read_at(m.start + at, min(CHUNK, m.size - at))
            end = head.find(b"\r\n\r\n")
            if not head.startswith(b"WARC/") or end < 0:
                raise ValueError(f"{m.name}: no WARC record at {at}")
            length = end + 8 + int(_fields(head[:end])["content-length"])
            yield at, length
            at += length
        return
    begun, unpack, at = 0, zlib.decompressobj(31), 0
    while at < m.size:
        data = read_at(m.start + at, min(CHUNK, m.size - at))
        view = data
        while view:
            unpack.decompress(view)
            if not unpack.eof:
                break
            left = unpack.unused_data
            end = at + len(data) - len(left)
            yield begun, end - begun
            begun, view, unpack = end, left, zlib.decompressobj(31)
        at += len(data)
    if begun != m.size:
        raise ValueError(f"{m.name}: the last record is cut short")


def _grouped(where: Iterator[tuple[int, int]], most: int) -> Iterator[tuple[int, list[int]]]:
    """(start, lengths) of runs of neighbours, of bounded bytes and number; a longer record is a run of its own."""
    start, lengths, total = 0, [], 0
    for at, n in where:
        if lengths and (at != start + total or total + n > RANGE_BYTES or len(lengths) >= most):
            yield start, lengths
            lengths = []
        if not lengths:
            start, total = at, 0
        lengths.append(n)
        total += n
    if lengths:
        yield start, lengths


def ranges(packages: DataFrame, most: int = RANGE_RECORDS) -> DataFrame:
    """(path, start, gz, lengths): ranges of neighbouring records, ``most`` at most, of packages (path, length).

    A task holds 16 bytes for each record of one index. An index that names a record twice counts it once; archive
    members that no index names are scanned. A package without archive members has no ranges; a compressed archive or
    index member can't be read by ranges and is an error."""

    def go(batches):
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, p = store(path)
                with system.open_input_file(p) as f:
                    read_at = lambda start, n, f=f: f.read_at(n, start)
                    members = list(directory(read_at, length))
                    named: dict[str, np.ndarray] = {}
                    for m in members:
                        if not m.stored and m.name.startswith(("archive/", "indexes/")):
                            raise ValueError(f"{path}: {m.name} is compressed")
                        if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m.name):
                            for k, v in _index(_lines(read_at, m)).items():
                                named[k] = np.unique(np.concatenate([named[k], v]), axis=0) if k in named else v
                    for m in members:
                        if re.fullmatch(r"archive/.*\.warc(\.gz)?", m.name):
                            own = named.get(m.name.rpartition("/")[2])
                            found = _scan(read_at, m) if own is None else map(tuple, own.tolist())
                            for start, lengths in _grouped(found, most):
                                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([m.start + start]), pa.array([m.name.endswith(".gz")]), pa.array([lengths], pa.list_(pa.int64()))], names=["path", "start", "gz", "lengths"])

    return packages.select("path", "length").mapInArrow(go, RANGES)


def read_records(packages: DataFrame, payload: bool = True, most: int = RANGE_RECORDS) -> DataFrame:
    """Records of packages (path, length): record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes and
    payload (null without ``payload``, and for records that have none).

    Only places travel; each task reads its ranges itself, one at a time. Broken records and payloads of another digest
    than their record names are errors."""
    where = cut(ranges(packages, most))
    total = where.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    tasks = max(1, where.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)

    def go(batches):
        kinds = (*[pa.string()] * 5, pa.int64(), pa.binary())
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                system, p = store(r["path"])
                with system.open_input_file(p) as f:
                    data = f.read_at(sum(r["lengths"]), r["start"])
                rows, at, held = [], 0, 0
                for n in r["lengths"]:
                    one = data[at : at + n]
                    fields, block, _ = parse(gzip.decompress(one) if r["gz"] else one)
                    at += n
                    row = as_row(fields, block)
                    rows.append(row if payload else (*row[:-1], None))
                    held += len(row[-1] or b"") if payload else 0
                    if held > RANGE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return where.repartition(int(tasks), "path", "start").mapInArrow(go, RECORDS)


def with_revisits(pages: DataFrame, key: str = "page_id", uri: str = "url", text: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Rows for ``write_packages`` from a table of pages, and the digest of each payload.

    Of equal payloads of ``least`` bytes or more that of the smallest key is the response (of repeated rows with that key
    each one); null keys revisit it, and are responses where all keys are null. Null texts are empty payloads."""
    payload = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{uri}`").cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = cut(rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    # a short list is broadcast, else payloads move once
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    rows = rows.join(first, "digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return rows.select(name("k").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("kind"), "uri", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", F.when(again, name("first")).alias("refers_to"))


def op11_zip_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to packages and read back by ranges; odd rows behave as in ``with_revisits``, and
    an empty table gives no rows. The packages are deleted when their records are read."""
    pages = only(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/packages-{uuid.uuid4().hex}"
    records = read_records(write_packages(with_revisits(pages), folder), payload=False)
    number = lambda c: F.when(F.col(c) != "urn:page:none", F.substr(c, F.lit(10)).cast("long"))
    out = cut(records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))
    system, path = store(folder)
    system.delete_dir(path)
    return out


SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM r
"""
