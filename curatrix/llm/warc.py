"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is its frames followed by the
seek table of the seekable Zstandard format, a skippable frame that ends the file and lists the sizes of
all frames. Each bundle comes with an index from record identifiers to (frame, offset inside the frame,
length). Archives are stored as a table in the shared folder, a bundle in a row, under Spark's commit
protocol, so a lost executor leaves no half-written bundle; :func:`export` writes them as files.

Payloads that are equal are stored once: the record with the least page_id is the response, the others
are revisits that refer to it. Payloads are told apart by length and SHA-1.

Defined cases: null html is an empty payload; null urls are written as an empty target; a null page_id is
never less than another, and is a response only where no other page has that payload; rows that repeat a
page_id are numbered, so each has a record identifier of its own, and of those that repeat the least
page_id of a payload one is the response; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, record, written

#: Bytes of records that close a frame, compressed bytes that close a bundle.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 8 << 20, 3
#: Of the seekable format: the skippable frame's magic number, and that of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, copy: int = 0) -> str:
    """copy: 0 where no other row has that page_id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' + (f'#{copy}' if copy else ''))}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int = 0, refers_copy: int = 0) -> bytes:
    """One WARC record; a revisit has no block, and names the length and digest of what it stands for."""
    sha = digest(payload)
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, copy)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or ""), f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_copy)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and payload of one record (None: a revisit); raises where the payload isn't what the headers say."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if headers["WARC-Type"] == "revisit":
        return headers, None
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't have its digest")
    return headers, payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the table at the bundle's end."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at, out = 0, []
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    if at + 8 + 8 * n + 9 != len(bundle):
        raise ValueError("the seek table doesn't fit the bundle")
    return out


class Writer:
    """Fills one bundle."""

    def __init__(self):
        self.out, self.open, self.sizes, self.index = io.BytesIO(), bytearray(), [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, name: str, page_id: int | None, raw: bytes) -> None:
        self.index.append((name, page_id, len(self.sizes), len(self.open), len(raw)))
        self.open += raw
        if len(self.open) >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(bytes(self.open))
            self.sizes.append((len(packed), len(self.open)))
            self.out.write(packed)
            self.open = bytearray()

    def full(self) -> bool:
        return self.out.tell() >= BUNDLE_BYTES

    def close(self) -> tuple[bytes, list]:
        self._close_frame()
        self.out.write(seek_table(self.sizes))
        return self.out.getvalue(), self.index


class Reader:
    """Records of one bundle, by what its index says; a frame is read once while records follow each other."""

    def __init__(self, bundle: bytes):
        self.bundle, self.frames, self.at, self.data = bundle, frames(bundle), -1, b""
        self.zstd = zstandard.ZstdDecompressor()

    def get(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.at:
            start, size, whole = self.frames[frame]
            self.data, self.at = self.zstd.decompress(self.bundle[start : start + size], max_output_size=whole), frame
        return self.data[offset : offset + length]


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, copy, first (page_id and copy of the response of an equal payload; null: it is one itself)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    again = p.groupBy("page_id").count().filter("count > 1").select(F.col("page_id").alias("again_id"))
    if again.isEmpty():
        p = p.withColumn("copy", F.lit(0).cast("long"))
    else:  # stored, so that a row keeps its number when a task runs anew
        repeats = written(p.join(again, p.page_id.eqNullSafe(again.again_id), "left_semi").withColumn("copy", 1 + F.monotonically_increasing_id()), "repeated-pages")
        p = p.join(again, p.page_id.eqNullSafe(again.again_id), "left_anti").withColumn("copy", F.lit(0).cast("long")).unionAll(repeats)
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "copy")
    # one row for each payload that several pages have, so hot payloads are counted before they are shuffled
    shared = p.groupBy("sha", "size").agg(F.min(key).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    return p.join(shared, ["sha", "size"], "left").select("page_id", "url", "html", "copy", F.when(F.col("first") != key, F.col("first")).alias("first"))


ARCHIVE = "bundle string, data binary, index array<struct<record_id string, page_id long, frame int, offset long, length long>>"


def archived(pages: DataFrame) -> DataFrame:
    """Bundles with a record for every row of ``pages`` (page_id, url, html), stored in the shared folder."""
    entry = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", entry)])

    def run(batches):
        w = Writer()

        def done() -> pa.RecordBatch:
            data, index = w.close()
            return record(schema, [[uuid.uuid4().hex], [data], [[dict(zip(("record_id", "page_id", "frame", "offset", "length"), x, strict=True)) for x in index]]])

        for b in cut(batches):
            for page_id, url, html, copy, first in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                to, to_copy = (first["page_id"], first["copy"]) if first else (None, 0)
                w.add(record_id(page_id, copy), page_id, render(page_id, url, html.encode(), to, first is not None, copy, to_copy))
                if w.full():
                    yield done()
                    w = Writer()
        if w.index:
            yield done()

    return written(with_references(pages).mapInArrow(run, ARCHIVE), "warc")


def _rows(pick=None):
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for b in cut(batches):
            for data, index in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                reader, out, size = Reader(data), [], 0
                for e in index:
                    if pick is not None and e["page_id"] not in pick:
                        continue
                    h, payload = parse(reader.get(e["frame"], e["offset"], e["length"]))
                    number = lambda k: int(h[k]) if h.get(k) else None
                    n = int(h["X-Payload-Length"]) if payload is None else len(payload)
                    out.append((h["WARC-Record-ID"], number("X-Page-ID"), h["WARC-Target-URI"], n, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number("X-Refers-To-Page-ID"), payload))
                    size += len(payload or b"")
                    if size > FRAME_BYTES * 16:
                        yield record(schema, list(zip(*out, strict=True)))
                        out, size = [], 0
                if out:
                    yield record(schema, list(zip(*out, strict=True)))

    return run


READ = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: DataFrame) -> DataFrame:
    """Every record of the bundles, parsed; payloads are held against their digests."""
    return archives.select("bundle", "data", "index").mapInArrow(_rows(), READ)


def fetch(archives: DataFrame, page_ids: list[int]) -> DataFrame:
    """All records of some pages: only bundles whose index names them are read, and only their frames decompressed."""
    hit = archives.filter(F.exists("index", lambda e: e["page_id"].isin(*page_ids)))
    return hit.select("bundle", "data", "index").mapInArrow(_rows(set(page_ids)), READ)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Bundles as `.warc.zst` files in a local or mounted folder, one at a time."""
    from pathlib import Path

    out = []
    for r in archives.toLocalIterator():
        (path := Path(folder, f"{r['bundle']}.warc.zst")).write_bytes(r["data"])
        out.append(str(path))
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return read(archived(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.sha, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (sha)
"""
