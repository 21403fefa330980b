"""WARC records in ZIP packages, read by range.

``package`` writes pages as WARC records into ZIP archives, several to a task
and each of about ``archive_bytes``. An archive holds two stored
(uncompressed) members: ``archive/data.warc`` and ``indexes/index.cdx``, whose
lines give offset and length of each record. ``read_packages`` takes archives as
rows (name, content), as Spark's ``binaryFile`` source gives them, finds the end
record, the ZIP64 locator and directory where there is one, then the central
directory and the stored members, and reads each record by its range from the
index. Nothing is decompressed or unpacked.

Equal payloads of at least ``least`` bytes are stored once: the record of the
largest page_id is the response, others are revisit records that refer to it.
Payload and its SHA-1 are checked when read; damage raises ValueError.

Scale. Page bodies are shuffled once, by page. Which record refers to which is
decided on digests only, by a pre-aggregated group and a join; a payload that a
third of the pages share is one row of that group. An archive is a bounded
part of a task's rows.

Edge cases. Null html is an empty payload; a null url is written empty. A null
page_id is written as ``null`` and read back as null. All rows that tie for the
largest page_id of a payload are responses. Columns other than page_id, url and
html are ignored.
"""

import hashlib
import struct
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

LEAST, ARCHIVE_BYTES = 1000, 8 << 20
WARC_NAME, INDEX_NAME = b"archive/data.warc", b"indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
U32, U16 = 0xFFFFFFFF, 0xFFFF


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; with refers_to it is a revisit without the payload."""
    name = "null" if page_id is None else str(page_id)
    digest = hashlib.sha1(payload).hexdigest()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _member(name: bytes, data: bytes, at: int, zip64: bool) -> tuple[bytes, bytes]:
    """Local header, and central directory entry of a stored member at offset ``at``."""
    crc, n = zlib.crc32(data), len(data)
    sizes = struct.pack("<QQ", n, n)
    version = 45 if zip64 else 20
    extra = struct.pack("<HH", 1, 16) + sizes if zip64 else b""
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", version, 0x800, 0, 0, 0x5821, crc, *((U32, U32) if zip64 else (n, n)), len(name), len(extra)) + name + extra
    extra = struct.pack("<HH", 1, 24) + sizes + struct.pack("<Q", at) if zip64 else b""
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", version, version, 0x800, 0, 0, 0x5821, crc, *((U32, U32) if zip64 else (n, n)), len(name), len(extra), 0, 0, 0, 0, U32 if zip64 else at) + name + extra
    return local, central


def zip_stored(members: list[tuple[bytes, bytes]], zip64: bool = True) -> bytes:
    out, directory = bytearray(), bytearray()
    for name, data in members:
        local, central = _member(name, data, len(out), zip64)
        out += local
        out += data
        directory += central
    at, n, size = len(out), len(members), len(directory)
    out += directory
    if zip64:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        n, size, at = U16, U32, U32
    return bytes(out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, size, at, 0))


def directory(read_at, length: int) -> dict[bytes, tuple[int, int]]:
    """Name -> (offset of the stored bytes, their number). read_at(offset, n) gives bytes of the archive."""
    tail_at = max(0, length - 22 - U16)
    tail = bytes(read_at(tail_at, length - tail_at))
    end = tail.rfind(b"PK\5\6")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end record: not a ZIP archive")
    n, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if n == U16 or size == U32 or at == U32:
        if tail_at + end < 20:
            raise ValueError("no ZIP64 locator")
        mark, _, end64, _ = struct.unpack("<4sIQI", bytes(read_at(tail_at + end - 20, 20)))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        head = bytes(read_at(end64, 56))
        if head[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        n, size, at = struct.unpack("<QQQ", head[32:56])
    entries, found, pos = bytes(read_at(at, size)), {}, 0
    for _ in range(n):
        if entries[pos : pos + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", entries[pos + 8 : pos + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", entries[pos + 20 : pos + 34])
        start = struct.unpack("<I", entries[pos + 42 : pos + 46])[0]
        name, extra = entries[pos + 46 : pos + 46 + n_name], entries[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4 : 4 + k - k % 8])]
                plain = wide.pop(0) if plain == U32 else plain
                packed = wide.pop(0) if packed == U32 else packed
                start = wide.pop(0) if start == U32 else start
            extra = extra[4 + k :]
        if method == 0 and not flags & 1:
            local = bytes(read_at(start, 30))
            if local[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            a, b = struct.unpack("<HH", local[26:30])
            found[name] = (start + 30 + a + b, packed)
        pos += 46 + n_name + n_extra + n_comment
    return found


def parse(data: bytes) -> dict:
    """Headers of one record, and under ``payload`` its block."""
    head, mark, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = dict(x.split(": ", 1) for x in lines[1:])
    out["payload"] = block[: int(out["Content-Length"])]
    if len(out["payload"]) != int(out["Content-Length"]):
        raise ValueError("a truncated record")
    return out


def _write(batches, archive_bytes: int):
    """Archives of the task's rows, in their order."""
    warc, index = bytearray(), []

    def flush():
        content = zip_stored([(WARC_NAME, bytes(warc)), (INDEX_NAME, "".join(index).encode())])
        batch = pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".wacz"]), pa.array([content], pa.binary())], ["name", "content"])
        warc.clear()
        index.clear()
        return batch

    for batch in batches:
        for page, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())
            index.append(f"{page.as_py()} {len(warc)} {len(data)}\n")
            warc += data
            if len(warc) >= archive_bytes:
                yield flush()
    if index:
        yield flush()


_READ = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _read(batches, payload: bool):
    urn = lambda x: None if x in (None, "<urn:page:null>") else x[10:-1]
    for batch in batches:
        for content in batch.column(0):
            view = memoryview(content.as_buffer())
            read_at = lambda at, n, v=view: v[at : at + n]
            members = directory(read_at, len(view))
            (base, size), (at, n) = members[WARC_NAME], members[INDEX_NAME]
            rows = []
            for line in bytes(read_at(at, n)).decode().splitlines():
                _, offset, length = line.rsplit(" ", 2)
                if int(offset) + int(length) > size:
                    raise ValueError("the index points outside the archive member")
                r = parse(bytes(read_at(base + int(offset), int(length))))
                digest, kind = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"]
                if kind == "response" and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != int(r["WARC-Payload-Length"])):
                    raise ValueError(f"payload of {r['WARC-Record-ID']} is damaged")
                rows.append((urn(r["WARC-Record-ID"]), r["WARC-Target-URI"], kind, int(r["WARC-Payload-Length"]), digest, urn(r.get("WARC-Refers-To")), r["payload"] if payload else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def package(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (name, content) of ZIP packages with a record for each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    big = pages.filter(F.octet_length("html") >= least).select("page_id", "digest")
    kept = big.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("digest", "keep")
    refers = big.join(kept, "digest").filter("page_id < keep").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keep").distinct()
    rows = pages.join(refers, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", F.col("keep").alias("refers_to"))
    return rows.mapInArrow(partial(_write, archive_bytes=archive_bytes), "name string, content binary")


def read_packages(archives: DataFrame, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to (ids as strings) and, if wanted, payload."""
    out = archives.select("content").mapInArrow(partial(_read, payload=payload), "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return out if payload else out.drop("payload")


def write_and_read(pages: DataFrame) -> DataFrame:
    """The archives are stored as a table in the shared folder, then read."""
    kind = pages.schema["page_id"].dataType.simpleString()
    out = read_packages(materialize(package(pages), "packages"), payload=False)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN keep END AS refers_to
FROM k
"""
