"""WARC records in ZIP packages, written by tasks and read back by byte ranges.

A package is a ZIP file whose members are stored, not compressed: WARC files of
one gzip member per record, and an index line per record with offset and length.
The reader parses the end and central directories (ZIP64 as well), finds where a
stored member's bytes lie in the package, and reads records at their own ranges;
nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftframe.llm.common import written
from weftframe.session import scratch_path

# Fixed values of the ZIP format.
END, END_SIZE = b"PK\x05\x06", 22
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
# Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
# a task starts another package after this many records or bytes
PACKAGE_RECORDS = 50_000
PACKAGE_BYTES = 512 << 20


def _store(path: str):
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pa.fs.LocalFileSystem(), path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit holds the response's header block alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in (url or "about:blank"))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """A package being written, straight to its place; small state in memory: the index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, place = _store(self.path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)
        self.index: list[tuple[str, int, int]] = []
        self.bytes = 0

    def add(self, name: str, record: bytes) -> None:
        packed = gzip.compress(record, 4, mtime=0)
        self.data.write(packed)
        self.index.append((name, self.bytes, len(packed)))
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as lines:
            for name, offset, length in self.index:
                entry = {"url": name, "offset": offset, "length": length, "filename": DATA_MEMBER.rpartition("/")[2]}
                lines.write((json.dumps(entry) + "\n").encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.index)


def write_packages(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Write one record per row into packages below ``folder``; returns (path, records), materialised.

    Of rows with equal payloads of at least ``least_bytes`` bytes the smallest key is
    a response and the others revisits of it; rows with that same key are responses
    too. Payloads are UTF-8, null as empty. A null key never is the response of
    others. Equal payloads are told by SHA-1 and only (digest, key) is aggregated, so
    a payload that a third of the rows share meets in no one task. A task that is
    repeated writes new files; only files of finished tasks are in the result.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    firsts = rows.where(F.length("body") >= least_bytes).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left").select(
        "k", "url", "body", F.when((F.col("first") != F.col("k")) | F.col("k").isNull(), F.col("first")).alias("refers_to")
    )

    def run(batches):
        package = None
        paths, counts = [], []
        for batch in batches:
            for page_id, address, content, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    package = _Package(folder)
                record = _record(page_id, address, content, base32_sha1(content), refers_to, date)
                package.add(address or "", record)
                if len(package.index) >= PACKAGE_RECORDS or package.bytes >= PACKAGE_BYTES:
                    path, n = package.close()
                    paths.append(path)
                    counts.append(n)
                    package = None
        if package is not None:
            path, n = package.close()
            paths.append(path)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(joined.mapInArrow(run, "path string, records long"), "packages")


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    header_at: int


def directory(file, size: int) -> dict[str, Member]:
    """The members of a ZIP file by its central directory, of either kind."""
    tail_at = max(0, size - END_SIZE - FULL16)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator = tail.rfind(LOCATOR64, 0, at)
        if locator < 0:
            raise ValueError("no ZIP64 locator")
        (end_at,) = struct.unpack_from("<Q", tail, locator + 8)
        file.seek(end_at)
        end = file.read(56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    file.seek(start)
    entries = file.read(length)
    members, at = {}, 0
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, plain = struct.unpack_from("<II", entries, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<HHH", entries, at + 28)
        (header_at,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + ENTRY_SIZE : at + ENTRY_SIZE + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + ENTRY_SIZE + name_n : at + ENTRY_SIZE + name_n + extra_n]
        plain, packed, header_at = _wide(extra, plain, packed, header_at)
        members[name] = Member(name, method, packed, plain, header_at)
        at += ENTRY_SIZE + name_n + extra_n + comment_n
    return members


def _wide(extra: bytes, plain: int, packed: int, header_at: int) -> tuple[int, int, int]:
    """The 64-bit values of an entry, where its 32-bit fields are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return tuple(next(values) if v == FULL32 else v for v in (plain, packed, header_at))
        at += 4 + n
    return plain, packed, header_at


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin in the package."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    file.seek(member.header_at)
    header = file.read(LOCAL_SIZE)
    if header[:4] != LOCAL:
        raise ValueError("broken local header")
    name_n, extra_n = struct.unpack_from("<HH", header, 26)
    return member.header_at + LOCAL_SIZE + name_n + extra_n


def parse_record(record: bytes) -> dict:
    """Headers of a WARC record (names in lower case), and its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return {"headers": headers, "payload": payload, "length": int(sizes[0]) if sizes else len(payload)}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def read_packages(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row per record of the packages: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    ``payload`` is null for revisits. A response whose payload does not have the
    length and digest that its headers state is an error.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _records(path)

    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"
    )
    # one package per task where there are that many
    spread = paths.select(F.col(column).alias("path")).repartition(max(1, paths.count()), F.col("path"))
    return spread.mapInArrow(run, schema)


def _records(path: str):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    fs, place = _store(path)
    with fs.open_input_file(place) as file:
        members = directory(file, file.size())
        starts = {n.rpartition("/")[2]: data_start(file, m) for n, m in members.items() if n.startswith("archive/")}
        for index in sorted(n for n in members if n.startswith("indexes/")):
            begin, left = data_start(file, members[index]), members[index].size
            rows, held, rest = [], 0, b""
            while left or rest:
                # the index comes in pieces, so a package of any size fits
                file.seek(begin)
                piece = file.read(min(left, 1 << 20))
                begin, left = begin + len(piece), left - len(piece)
                lines = (rest + piece).split(b"\n")
                rest = lines.pop() if left else b""
                for line in lines:
                    if not line:
                        continue
                    entry = json.loads(line)
                    file.seek(starts[entry["filename"]] + entry["offset"])
                    record = parse_record(gzip.decompress(file.read(entry["length"])))
                    rows.append(_row(record))
                    held += record["length"]
                    if held > 16 << 20 or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _row(record: dict) -> tuple:
    headers, payload = record["headers"], record["payload"]
    digest = headers["warc-payload-digest"].partition(":")[2]
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != record["length"] or base32_sha1(payload) != digest):
        raise ValueError(f"record {headers['warc-record-id']} does not match its digest")
    refers_to = _number(headers.get("warc-refers-to"))
    page = _number(headers["warc-record-id"])
    return page, headers["warc-target-uri"], record["length"], digest, kind, refers_to, payload if kind == "response" else None


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages into packages, then list what the packages hold, without the payloads."""
    packages = write_packages(pages, folder or scratch_path(spark, "warc"))
    return read_packages(packages).drop("payload", "url")
