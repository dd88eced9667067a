"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, record offsets."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import salted_left_join, SALTS, Scratch, trimmed, write_table

#: Fixed values of the seekable format: a skippable frame holds the table; its last four bytes name the format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

BUNDLES = "bundle_id long, data binary, ids array<string>, frames array<int>, offsets array<long>"
RECORDS = "record_id string, page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has no block and names the record that holds its payload."""
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": len(payload),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit and refers_to is not None else None,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": 0 if revisit else len(payload),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


class Bundle:
    """Groups records into frames of about frame_bytes and closes with the seek table."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.table, self.open, self.open_bytes = bytearray(), [], [], 0
        self.ids, self.frames, self.offsets = [], [], []

    def add(self, record_id: str, data: bytes) -> None:
        self.ids.append(record_id)
        self.frames.append(len(self.table))
        self.offsets.append(self.open_bytes)
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.out += packed
            self.table.append((len(packed), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self.end_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed, unpacked) of each frame, read from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    each = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or struct.unpack("<I", data[-9 - n * each - 8 : -9 - n * each - 4])[0] != SKIPPABLE:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for i in range(n):
        packed, unpacked = struct.unpack_from("<II", data, len(data) - 9 - (n - i) * each)
        out.append((at, packed, unpacked))
        at += packed
    return out


def read_frame(data: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, packed, unpacked = table[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=unpacked)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: one frame is unpacked, none before it."""
    return parse(read_frame(data, seek_table(data), frame), offset)[:2]


def classified(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, uri, payload, refers_to): equal payloads refer to the smallest page_id that has them; null: a response.

    Where rows share that page_id, that of the smallest uri is the response (one of them if those are equal too).
    """
    tables = Scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    each = rows.where(F.octet_length("payload") >= min_payload).groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("key").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("m"), F.sum("n").alias("n"))
    groups = write_table(groups.where("n > 1 and m is not null").select("key", F.col("m.page_id").alias("first"), (F.col("m.n") > 1).alias("shared")), "groups")
    told = salted_left_join(rows, groups, ["key"], F.struct("page_id", "uri"))
    own = F.col("page_id").eqNullSafe(F.col("first"))
    plain = told.where(~(own & F.coalesce("shared", F.lit(False)))).select("page_id", "uri", "payload", F.when(~own, F.col("first")).alias("refers_to"))
    if groups.where("shared").isEmpty():
        return plain
    # rows that share the least page_id: one in all is the response; equal rows are counted, then dealt out again
    twins = told.where(own & F.col("shared")).withColumn("part", F.spark_partition_id() % SALTS)
    twins = tables.write(twins.groupBy("key", "page_id", "uri", "part").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload")), "twins")
    top = twins.groupBy("key").agg(F.min(F.struct("uri", "part")).alias("top"))
    twins = salted_left_join(twins, top, ["key"], F.struct("uri", "part")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    chosen = F.struct("uri", "part").eqNullSafe(F.col("top")) & (F.col("i") == 1)
    return plain.unionByName(twins.select("page_id", "uri", "payload", F.when(~chosen, F.col("page_id")).alias("refers_to")))


def write_bundles(pages: DataFrame, min_payload: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 16 << 20) -> DataFrame:
    """Write a record per row of pages; return the bundles as a table in the shared folder.

    Each row is one bundle of about bundle_bytes: the seekable archive in `data`, and the map from record
    identifiers (`ids`) to `frames` and frame-relative `offsets`. Null html: empty payload. Payloads under
    min_payload bytes are never revisits. Null page_id: identifier without a number, never referred to; such rows are
    all responses where no other has their payload. Rows repeated whole, or rows that share a page_id, are records of
    their own, one of each payload the response. Payloads of any length are whole, in one frame. Other columns are
    ignored, whatever their names. Empty table: no bundle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count, now = TaskContext.get().partitionId() << 32, 0, Bundle(frame_bytes)
        schema = pa.schema([("bundle_id", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"bundle_id": [base + count], "data": [now.close()], "ids": [now.ids], "frames": [now.frames], "offsets": [now.offsets]}, schema=schema)

        for batch in batches:
            for page, uri, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                now.add(f"<urn:page:{'' if page is None else page}>", record(page, uri, payload, first, first is not None))
                if len(now.out) >= bundle_bytes:
                    yield closed()
                    count, now = count + 1, Bundle(frame_bytes)
        if now.ids:
            yield closed()

    return write_table(classified(pages, min_payload).mapInArrow(trimmed(pack), BUNDLES), "warc")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(RECORDS) of the records that `wanted` (record_id) names, by the bundles' maps: only their frames are unpacked.

    An identifier that several records bear gives all of them; unknown and null ones give none.
    """
    spots = bundles.select("bundle_id", F.explode(F.arrays_zip("ids", "frames", "offsets")).alias("at")).select("bundle_id", F.col("at.ids").alias("record_id"), "at.frames", "at.offsets")
    spots = spots.join(wanted.select("record_id").distinct(), "record_id").groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("frames", "offsets"))).alias("at"))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, now, frame = data.as_py(), -1, b""
                table = seek_table(data)
                for spot in at:
                    if spot["frames"] != now:
                        now, frame = spot["frames"], read_frame(data, table, spot["frames"])
                    yield _records([parse(frame, spot["offsets"])[:2]], True)

    return bundles.join(spots, "bundle_id").select("data", "at").mapInArrow(trimmed(seek), RECORDS)


def _records(found: list[tuple[dict[str, str], bytes]], payloads: bool) -> pa.RecordBatch:
    names = ["record_id", "page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "intact"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    rows = []
    for head, block in found:
        full, kind = head["WARC-Payload-Digest"][5:], head["WARC-Type"]
        rows.append((head["WARC-Record-ID"], number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, number(head.get("WARC-Refers-To")), int(head["X-Payload-Length"]), full, block if payloads else None, None if kind == "revisit" else digest(block) == full))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Read every record of the archives, frame by frame as the seek tables say (RECORDS).

    intact: the block's SHA-1 is the digest in the header (null for a revisit, which has no block).
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in (x.as_py() for x in batch.column(0)):
                table = seek_table(data)
                for i in range(len(table)):
                    frame, at, found = read_frame(data, table, i), 0, []
                    while at < len(frame):
                        head, block, at = parse(frame, at)
                        found.append((head, block))
                    yield _records(found, payloads)

    return bundles.select("data").mapInArrow(trimmed(unpack), RECORDS)
