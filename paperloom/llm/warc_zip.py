"""WARC in ZIP packages, read by ranges.

A package holds `archive/data.warc.gz` (gzip members, one a record, stored without further compression) and `indexes/index.cdxj`
(a line for each record: key, and JSON with its offset and length). Packages are read without extraction: the end of the file
gives the central directory, by way of the ZIP64 records where numbers do not fit; a member's local header gives its first byte;
the index gives each record's range.

Writing: of records with equal payloads of at least least_bytes, that of the smallest page_id is the response, the others revisit
it and hold no payload, only the headers. Digests of all pages are gathered first; only those that several pages have are joined
back, and a payload that very many pages have is a large partition of a plain join, which Spark can split.

A null html is empty; rows with a null page_id come last and refer to the response, or are all responses where none has an id; rows
of the smallest page_id are all responses; equal rows each get a record; an empty table gives no package and no row; other columns
but url are ignored.
"""

from __future__ import annotations

import base64
import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import Ranges, bounded_batches, new_folder, write_whole

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its archive has so many bytes.
PACKAGE_BYTES = 64 << 20
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
BIG, MANY = 0xFFFFFFFF, 0xFFFF


# ---- ZIP


def zip_parts(members: list[tuple[str, list[bytes]]], force64: bool = False) -> list[bytes]:
    """A package of stored members. ZIP64 fields are written where a number needs them, or everywhere if asked for."""
    out, central, at = [], [], 0
    for name, data in members:
        size, crc, raw = sum(map(len, data)), 0, name.encode()
        for x in data:
            crc = zlib.crc32(x, crc)
        wide = force64 or size >= BIG or at >= BIG
        sizes = struct.pack("<II", BIG, BIG) if wide else struct.pack("<II", size, size)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        start = [LOCAL, struct.pack("<HHHHHI", 45 if wide else 20, 0x800, 0, 0, 0x21, crc), sizes, struct.pack("<HH", len(raw), len(extra)), raw, extra]
        own = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(b"".join([CENTRAL, struct.pack("<HHHHHHI", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc), sizes, struct.pack("<HHHHHII", len(raw), len(own), 0, 0, 0, 0, BIG if wide else at), raw, own]))
        out += [*start, *data]
        at += sum(map(len, start)) + size
    length, n = sum(map(len, central)), len(members)
    if force64 or at >= BIG or n >= MANY:
        out_end = [END64, struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, at), LOCATOR, struct.pack("<IQI", 0, at + length, 1), END, struct.pack("<HHHHIIH", 0, 0, MANY, MANY, BIG, BIG, 0)]
    else:
        out_end = [END, struct.pack("<HHHHIIH", 0, 0, n, n, length, at, 0)]
    return [*out, *central, *out_end]


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name: (offset of its local header, bytes in the package, method, bytes), from the central directory. read(offset, n)."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    place = tail.rfind(END, 0, len(tail) - 18)
    while place >= 0 and place + 22 + struct.unpack_from("<H", tail, place + 20)[0] != len(tail):
        place = tail.rfind(END, 0, place)
    if place < 0:
        raise ValueError("not a ZIP package")
    n, length, at = struct.unpack_from("<HII", tail, place + 10)
    if MANY == n or BIG in (length, at):
        spot = tail_at + place - 20
        mark, _, end64, _ = struct.unpack("<4sIQI", read(spot, 20))
        if mark == LOCATOR:
            head = read(end64, 56)
            if head[:4] != END64:
                raise ValueError("ZIP64 record not found")
            n, length, at = struct.unpack_from("<QQQ", head, 32)
    data, p, found = read(at, length), 0, {}
    for _ in range(n):
        if data[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, p + 10)[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, p + 20)
        offset = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n_name].decode()
        extra = data[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                whole, packed, offset = (next(wide) if x == BIG else x for x in (whole, packed, offset))
            q += 4 + m
        found[name] = (offset, packed, method, whole)
        p += 46 + n_name + n_extra + n_note
    return found


def stored(read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """First byte and size of a stored member."""
    offset, packed, method, _ = entry
    head = read(offset, 30)
    if head[:4] != LOCAL or method:
        raise ValueError("not a stored member")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, packed


# ---- WARC


def record_name(page_id: int | None, sha1: bytes) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:payload:{sha1.hex()}"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit if refers_to is given: its block has the headers of the response, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_name(page_id, sha1)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_name(refers_to, sha1)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(data: bytes) -> dict:
    """A record from its gzip member: type, page_id, refers_to, url, digest, payload_bytes, payload (None in a revisit)."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    page = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("payload cut off")
    return {"record_type": fields["WARC-Type"], "page_id": page(fields["WARC-Record-ID"]), "refers_to": page(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": length, "payload": None if revisit else payload}


# ---- Spark


def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    data: list[bytes] = []
    lines: list[str] = []
    rows: list[tuple] = []
    size = 0

    def close() -> None:
        index = "".join(lines).encode()
        write_whole(path := f"{folder}/{part:08d}-{len(rows):06d}.wacz", zip_parts([(ARCHIVE, data.copy()), (INDEX, [index])]), attempt)
        rows.append((path, len(lines)))
        data.clear(), lines.clear()

    for batch in batches:
        for page_id, url, html, sha1, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
            page_id, url, sha1, refers_to = page_id.as_py(), url.as_py(), bytes.fromhex(sha1.as_py()), refers_to.as_py()
            own = record(page_id, url, html.as_buffer().to_pybytes(), sha1, refers_to)
            lines.append(f"{record_name(page_id, sha1)} {json.dumps({'offset': size, 'length': len(own), 'url': url})}\n")
            data.append(own)
            size += len(own)
            if size >= most:
                close()
                size = 0
    if data:
        close()
    yield pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "n": [r[1] for r in rows]}, schema=pa.schema([("path", pa.string()), ("n", pa.int64())]))


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> str:
    """A record for each row of pages (page_id, url, html), in packages; the folder gets *.wacz and _packages, the list of them."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha1", F.sha1("html"))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1 AND first IS NOT NULL").select("sha1", "first")
    known = rows.join(shared.hint("shuffle_hash"), "sha1", "left")
    refers = F.when(F.octet_length("html") >= least_bytes, F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    made = known.select("page_id", "url", "html", "sha1", refers.alias("refers_to")).mapInArrow(partial(_write, folder=folder, most=package_bytes), "path string, n long")
    made.write.parquet(f"{folder}/_packages")
    return folder


def _records(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            source = Ranges(path)
            found = directory(source.read, source.size)
            start, _ = stored(source.read, found[ARCHIVE])
            lines = source.read(*stored(source.read, found[INDEX])).decode().splitlines()
            for at in range(0, len(lines), 256):
                places = [json.loads(x.split(" ", 1)[1]) for x in lines[at : at + 256]]
                own = [parsed(source.read(start + x["offset"], x["length"])) for x in places]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in own], t) for n, t in zip(names, types, strict=False)], names=names)
            source.close()


def read_records(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each record of the packages in folder: page_id, record_type, refers_to, url, payload_digest, payload_bytes and, if asked for, payload."""
    packages = spark.read.parquet(f"{folder}/_packages").select("path")
    schema = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long" + ", payload binary" * payload
    return packages.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(partial(_records, payload=payload), schema)
