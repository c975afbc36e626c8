"""WARC records in ZIP packages, written and read back by byte range.

A package is a ZIP file whose members are all stored, never deflated: ``archive/data.warc.gz`` (each
record a gzip member of its own) and ``indexes/index.cdxj`` (one line a record: offset and length
inside the archive member). ``read_packages`` parses the end record, the ZIP64 end record where the
counts or offsets call for it, and the central directory; finds where the members' bytes begin from
their local headers; and reads records by range. Nothing is extracted.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page id is a
response and the others revisit it; smaller payloads are all responses.

Defined cases: a null html is an empty payload; repeated rows of one page id are written row by row,
and those with a large payload equal to the response's refer to that page id, but the row with the
page id itself stays a response; a null page id is kept and never chosen while another one is there;
an empty table gives no package; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MIN_BYTES = 1000
#: Digests that occur twice, of at most so many rows (about 150 bytes a row), are broadcast.
BROADCAST_ROWS = 200_000
#: A package is closed once its records hold so many bytes.
PACKAGE_BYTES = 48 << 20
#: Neighbouring records are fetched in one read of at most so many bytes.
READ_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

#: ZIP signatures and marks.
LOCAL_HEADER, CENTRAL_HEADER, END_RECORD, END64_RECORD, END64_LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class PackageError(ValueError):
    """A package that can't be read as one."""


def assign_revisits(pages: DataFrame, page_id: str, payload: Column, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``payload, digest, payload_bytes, refers_to`` (null for responses) to the page ids.

    Only digests that occur twice come out of the aggregation, which counts before it shuffles. Their list
    is counted and broadcast up to ``BROADCAST_ROWS``, so that payloads stay where they are; beyond it
    large payloads alone meet it by key, and a digest that holds many pages is split by Spark's skew
    handling, as the join needs no grouping.
    """
    keyed = pages.select(F.col(page_id).cast("long").alias("page_id"), *([F.col("url").cast("string").alias("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]), payload.alias("payload"))
    keyed = keyed.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    repeated = keyed.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    large = F.col("payload_bytes") >= min_bytes
    repeated = scratch.save(repeated.withColumnRenamed("digest", "again"), "repeated-payloads")
    met = keyed.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    return met.join(repeated, F.col("key") == F.col("again"), "left").select("page_id", "url", "payload", "digest", "payload_bytes", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, but keeps the payload's digest and length."""
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise PackageError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise PackageError("a WARC record of another length than it states")
    return fields, rest[:size]


def write_packages(marked: DataFrame, folder: str) -> DataFrame:
    """Write what ``assign_revisits`` gave; a row per package: ``package, n_records``.

    A task's packages have fresh names and count only once their row is committed, so a task that
    runs again leaves no record twice in the result.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, index, at = [], [], 0

        def close() -> pa.RecordBatch:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(ARCHIVE, b"".join(archive))
                z.writestr(INDEX, "".join(index))
            name, n = f"{uuid.uuid4().hex}.wacz", len(index)
            scratch.put(f"{folder}/{name}", out.getbuffer())
            archive.clear()
            index.clear()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["package", "n_records"])

        for batch in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(c for c in batch.columns), strict=True):
                data = gzip.compress(record(page_id.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), size.as_py(), refers_to.as_py()), 3, mtime=0)
                index.append(json.dumps({"offset": at, "length": len(data)}) + "\n")
                archive.append(data)
                at += len(data)
                if at >= PACKAGE_BYTES:
                    yield close()
                    at = 0
        if index:
            yield close()

    return scratch.save(scratch.map_arrow(marked.select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to"), write, "package string, n_records long"), "packages")


class ZipReader:
    """Members of a ZIP file that is read by ``read_at(size, offset)`` alone."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        tail_at = max(0, self.size - (22 + FULL16 + 20))
        tail = self.read_at(self.size - tail_at, tail_at)
        end = tail.rfind(END_RECORD)
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(END_RECORD, 0, end)  # the mark inside the comment
        if end < 0:
            raise PackageError("no end of central directory")
        count, length, at = struct.unpack_from("<H", tail, end + 10)[0], *struct.unpack_from("<II", tail, end + 12)
        if FULL16 == count or FULL32 in (length, at):
            locator = tail_at + end - 20
            if locator < 0 or (found := self.read_at(20, locator))[:4] != END64_LOCATOR:
                raise PackageError("no ZIP64 locator")
            where = struct.unpack_from("<Q", found, 8)[0]
            if (end64 := self.read_at(56, where))[:4] != END64_RECORD:
                raise PackageError("no ZIP64 end record")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        directory, p, members = self.read_at(length, at), 0, {}
        for _ in range(count):
            if directory[p : p + 4] != CENTRAL_HEADER:
                raise PackageError("a broken central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
            offset = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # the 64-bit values of those fields that are full
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                extra = extra[4 + n :]
            if method == 0:
                members[name] = (offset, packed, plain)
            p += 46 + n_name + n_extra + n_comment
        return members

    def start(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        if name not in self.members:
            raise PackageError(f"no stored member {name}")
        offset, size, _ = self.members[name]
        head = self.read_at(30, offset)
        if head[:4] != LOCAL_HEADER:
            raise PackageError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n_name + n_extra, size

    def read(self, name: str) -> bytes:
        at, size = self.start(name)
        return self.read_at(size, at)


def read_records(reader: ZipReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every indexed record, fetched by range; neighbours share a read."""
    base, size = reader.start(ARCHIVE)
    places = [(x["offset"], x["length"]) for x in map(json.loads, reader.read(INDEX).splitlines())]
    have, at = b"", 0
    for k, (offset, length) in enumerate(places):
        if offset + length > size:
            raise PackageError("the index points past the archive")
        if not at <= offset <= offset + length <= at + len(have):
            until, j = offset + length, k + 1
            while j < len(places) and places[j][0] == until and until + places[j][1] - offset <= READ_BYTES:
                until, j = until + places[j][1], j + 1
            have, at = reader.read_at(until - offset, base + offset), offset
        yield parse_record(zlib.decompress(have[offset - at : offset - at + length], wbits=31))


def read_packages(spark: SparkSession, packages: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """``page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload`` of every
    record of the named packages; a response's payload is checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = scratch.filesystem(f"{folder}/{name}")
                with fs.open_input_file(path) as f:
                    rows, n, held = [], 0, 0
                    for head, body in read_records(ZipReader(f.read_at, f.size())):
                        digest, n = head["warc-payload-digest"].removeprefix("sha1:"), n + 1
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(body).hexdigest() != digest:
                            raise PackageError(f"{name}: the payload of {head['warc-record-id']} has changed")
                        if not revisit and len(body) != int(head["warc-payload-length"]):
                            raise PackageError(f"{name}: the payload of {head['warc-record-id']} has another length")
                        rows.append({"page_id": _from_urn(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "payload_digest": digest, "payload_bytes": int(head["warc-payload-length"]), "refers_to": _from_urn(head["warc-refers-to"]) if revisit else None, "payload": body if with_payload and not revisit else None})
                        held += len(body)
                        if held > READ_BYTES or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(types.items())))
                            rows, held = [], 0
                    if n != expected:
                        raise PackageError(f"{name} holds {n} records, not {expected}")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(types.items())))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return scratch.map_arrow(packages.select("package", "n_records").repartition(parts), read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
