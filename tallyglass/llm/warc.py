"""WARC records in ZIP archives: written from pages, then located by their directories and range-read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import dealt, keep, scratch, table
from tallyglass.llm.files import Output, Ranges

NAME = "op4_warc"
#: Payloads of fewer bytes are never told as revisits.
REVISIT_BYTES = 0
#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 64 << 20
#: Bytes that one range read of records spans at most, but for a longer record.
READ_BYTES = 4 << 20
GZIP_LEVEL = 1
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
STORED, BIG32, BIG16 = 0, 0xFFFFFFFF, 0xFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class ZipWriter:
    """A ZIP archive of stored members, written in one pass. The first member streams: its size and checksum are known
    at its end, so they stand in the directory and in a data descriptor. ZIP64 fields are always written."""

    def __init__(self, out):
        self.out, self.members = out, []

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.out.size, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.out.write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 1 << 3 | 1 << 11, STORED, 0, 33, 0, BIG32, BIG32, len(raw), len(extra)) + raw + extra)
        self.start = self.out.size

    def write(self, data: bytes) -> int:
        """Appends to the open member; the offset in the member."""
        m = self.members[-1]
        at = m[3]
        m[2], m[3] = zlib.crc32(data, m[2]), at + len(data)
        self.out.write(data)
        return at

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self.out.write(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        at = self.out.size
        for raw, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self.out.write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 1 << 3 | 1 << 11, STORED, 0, 33, crc, BIG32, BIG32, len(raw), len(extra), 0, 0, 0, 0, BIG32) + raw + extra)
        n, length, end64 = len(self.members), self.out.size - at, self.out.size
        self.out.write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, at))
        self.out.write(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
        self.out.write(struct.pack("<4sHHHHIIH", END, 0, 0, BIG16, BIG16, BIG32, BIG32, 0))


def members(ranges) -> dict[str, tuple[int, int, int, int]]:
    """name -> (offset of the data, stored size, size, method), from the central directory alone plus one read of each
    local header, whose name and extra lengths may differ. Comments and ZIP64 records are allowed for."""
    tail_at = max(0, ranges.size - 22 - BIG16)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    n, length, at = struct.unpack_from("<HII", tail, end + 10)
    where = tail_at + end - 20
    if where >= 0 and (n == BIG16 or length == BIG32 or at == BIG32):
        locator = ranges.read(where, 20)
        if locator[:4] == LOCATOR64:
            record = ranges.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of a central directory")
            n, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, p, out = ranges.read(at, length), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("not a central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        offset, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # only the fields that are full in the short form, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                size = wide.pop(0) if size == BIG32 else size
                stored = wide.pop(0) if stored == BIG32 else stored
                offset = wide.pop(0) if offset == BIG32 else offset
            q += 4 + width
        head = ranges.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("no local header")
        a, b = struct.unpack_from("<HH", head, 26)
        out[name] = (offset + 30 + a + b, stored, size, method)
        p += 46 + n_name + n_extra + n_comment
    return out


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload of its own and names the response."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = " ".join(url.split()) or "about:blank"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of its HTTP message, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _id(uri: str) -> int:
    return int(uri.removeprefix("<urn:page:").removesuffix(">"))


def mark():
    """Payloads are equal if their lengths, SHA-1 and 64-bit hashes are."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return F.struct(F.length(html).alias("n"), F.sha1(html).alias("a"), F.xxhash64(html).alias("b"))


def roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(_id, _of, refers_to): the pages that revisit another, once for each page_id and mark of a payload.

    Only digests are shuffled; groups of equal payloads are folded to their smallest page_id map-side.
    """
    marks = pages.filter("page_id is not null").select("page_id", mark().alias("_mark")).filter(F.col("_mark.n") >= least)
    first = marks.groupBy("_mark").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1")
    return marks.join(first, "_mark").filter("page_id > refers_to").select(F.col("page_id").alias("_id"), F.col("_mark").alias("_of"), "refers_to").distinct()


def write(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes every page as a record into archives of the shared folder; returns their list (uri).

    An archive holds one member of records, each compressed by itself, and an index of where each stands.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")

    def run(batches):
        out = z = None
        index, done = [], []

        def close():
            z.end()
            z.begin(INDEX)
            z.write("".join(index).encode())
            z.end()
            z.close()
            done.append(out.close())

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = Output(folder, ".wacz")
                    z, index = ZipWriter(out), []
                    z.begin(DATA)
                payload = (html or "").encode()
                raw = gzip.compress(record(page_id, url or "", payload, digest32(payload), refers), GZIP_LEVEL, mtime=0)
                at = z.write(raw)
                index.append(f"{page_id} {at} {len(raw)}\n")
                if at + len(raw) >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done)], ["uri"])

    known = pages.filter("page_id is not null").select("page_id", "url", "html", mark().alias("_mark"))
    joined = known.join(roles(pages, least), (F.col("page_id") == F.col("_id")) & (F.col("_mark") == F.col("_of")), "left")
    text = joined.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return keep(text.mapInArrow(run, "uri string"), "archives")


def locate(archives: DataFrame) -> DataFrame:
    """(uri, offset, length, parts): runs of neighbouring records of about READ_BYTES, from directories and indexes."""
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                r = Ranges(uri)
                found = members(r)
                data_at, data_size, _, method = found[DATA]
                index_at, index_size, _, index_method = found[INDEX]
                if method != STORED or index_method != STORED:
                    raise ValueError("members that can be range-read are stored")
                lines = np.array([x.split()[1:] for x in r.read(index_at, index_size).decode().splitlines()], np.int64).reshape(-1, 2)
                r.close()
                if len(lines) and int(lines.sum(axis=1).max()) > data_size:
                    raise ValueError("the index points beyond its member")
                i, out = 0, []
                while i < len(lines):
                    j = max(i + 1, int(np.searchsorted(lines[:, 0], lines[i, 0] + READ_BYTES)))
                    out.append({"uri": uri, "offset": data_at + int(lines[i, 0]), "length": int(lines[j - 1].sum() - lines[i, 0]), "parts": lines[i:j, 1].tolist()})
                    i = j
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("parts", pa.list_(pa.int64()))]))

    return dealt(archives, "uri").mapInArrow(run, "uri string, offset long, length long, parts array<long>")


def read(archives: DataFrame) -> DataFrame:
    """The records of the archives: page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to. A response's length and digest are taken from its payload and held against its headers."""
    def run(batches):
        for batch in batches:
            for uri, offset, length, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = Ranges(uri)
                data = io.BytesIO(r.read(offset, length))
                r.close()
                out = []
                for n in parts:
                    fields, http, payload = parse(gzip.decompress(data.read(n)))
                    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(payload) != told:
                        raise ValueError("a payload differs from its digest")
                    own = kind == "response"
                    out.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload if own else None, len(payload) if own else int(http["Content-Length"]), told, kind, None if own else _id(fields["WARC-Refers-To"])))
                c = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = dealt(keep(locate(archives), "ranges"), "uri", "offset")
    return spread.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages written to archives and read back, see `read`.

    A null html is an empty payload, and empty payloads are equal; a null url becomes about:blank; rows without a
    page_id can't be named and aren't written; repeated rows are written each, as responses or revisits by their own payload; an
    empty table gives no archives and no rows. Other columns are ignored, whatever their names.
    """
    return read(write(pages, least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = archive_pages(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Base 32 of the 40 hex digits of a SHA-1: five hex digits are 20 bits, four letters.
SQL = f"""
WITH base AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hx FROM pages WHERE page_id IS NOT NULL),
coded AS (
    SELECT page_id, html, n, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
        '{_ALPHABET}'[((('0x' || hx[5 * k + 1:5 * k + 5])::BIGINT >> s) & 31) + 1]), '')), '') AS digest FROM base),
firsts AS (SELECT html, min(page_id) AS first FROM base WHERE n >= {REVISIT_BYTES} GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM coded LEFT JOIN firsts USING (html)
"""
