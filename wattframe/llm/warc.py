"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. After the frames come two
skippable frames: an index of (record, frame, offset in the frame, length) and, last, the seek
table of the seekable format, whose footer says how many frames there are. One row of binary
data is one file, written and read by Spark's own file sources, so any file system and the
commit of Spark's writers serve; a lost task writes its bundles again under a new attempt.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.functions.sizes import shared_folder
from wattframe.llm.staging import stage

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
LEAST_SHARED = 1000
SKIPPABLE = 0x184D2A50  # of the index; the seek table has the number of the seekable format
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = b"\xb1\xea\x92\x8f"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: str) -> str:
    """The same identifier for the same key, in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}>"


def record(key: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit leaves its payload out and names the record that has it."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Source-Key: {key}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        fields += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record and of its HTTP head, and the payload that it carries."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Collects records into frames; ``close`` gives the file's bytes but for the last four."""

    def __init__(self, frame_bytes: int) -> None:
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.open: list[bytes] = []
        self.open_bytes = 0
        self.index: list[tuple[str, int, int, int]] = []
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, key: str, data: bytes) -> None:
        if self.open and self.open_bytes + len(data) > self.frame_bytes:
            self.end_frame()
        self.index.append((key, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)

    def end_frame(self) -> None:
        self.frames.append(self.compressor.compress(b"".join(self.open)))
        self.sizes.append(self.open_bytes)
        self.open, self.open_bytes = [], 0

    @property
    def size(self) -> int:
        return sum(map(len, self.frames)) + self.open_bytes

    def close(self) -> bytes:
        if self.open:
            self.end_frame()
        index = self.compressor.compress(json.dumps(self.index).encode())
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        body = struct.pack("<II", SKIPPABLE, len(index)) + index
        table = entries + struct.pack("<II", len(body), 0)
        footer = struct.pack("<IB", len(self.frames) + 1, 0)
        return b"".join([*self.frames, body, struct.pack("<II", SEEK_TABLE, len(table) + 9), table, footer])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, from the footer alone."""
    if data[-4:] != SEEK_MAGIC:
        raise ValueError("no seek table")
    count, flags = struct.unpack_from("<IB", data, len(data) - 9)
    width = 12 if flags & 0x80 else 8
    at, place, out = len(data) - 9 - count * width, 0, []
    for i in range(count):
        packed, size = struct.unpack_from("<II", data, at + i * width)
        out.append((place, packed, size))
        place += packed
    return out


def index_of(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record key, frame, offset in the frame, length) of each record."""
    place, packed, _ = seek_table(data)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[place + 8 : place + packed]))]


def frame_of(data: bytes, frames: list[tuple[int, int, int]], number: int) -> bytes:
    place, packed, size = frames[number]
    return zstandard.ZstdDecompressor().decompress(data[place : place + packed], max_output_size=max(size, 1))


def _bundles(frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bundle: Bundle) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bundle.close()], pa.binary())], ["value"])

        bundle = Bundle(frame_bytes)
        for batch in batches:
            key, url, payload, sha1, refers = batch.columns
            for i in range(batch.num_rows):
                name = key[i].as_py()
                bundle.add(name, record(name, url[i].as_py(), payload[i].as_py(), sha1[i].as_py(), refers[i].as_py()))
                if bundle.size >= bundle_bytes:
                    yield out(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield out(bundle)

    return run


def originals(pages: DataFrame) -> DataFrame:
    """(sha1, sha2, response): of payloads that several pages share, the largest page_id."""
    shared = (
        pages.where(f"length(payload) >= {LEAST_SHARED} and page_id is not null")
        .groupBy("sha1", "sha2")
        .agg(F.max("page_id").alias("response"), F.min("page_id").alias("least"))
        .where("least < response")
        .drop("least")
    )
    return stage(shared, "originals")


def write_archives(
    pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> None:
    """Write a WARC record per row of (page_id, url, html) into bundles below ``path``.

    Payloads are whole, NULL counting as empty. Of equal payloads of 1000 bytes or more the
    largest page_id is a response and the others are revisits of it; equal means the same
    SHA-1 and SHA-256. Shorter ones, rows that repeat the largest page_id, and rows without an
    id are responses. Nothing but the digests is shuffled where those of shared payloads are
    few; otherwise rows join them by digest, and Spark splits a payload that very many share.
    A bundle ends after about ``bundle_bytes`` compressed bytes and a frame before
    ``frame_bytes`` bytes, except for a single larger record. Other columns are ignored; an
    empty table writes no bundle.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload")).withColumns(
        {"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256)}
    )
    records = rows.join(originals(rows), ["sha1", "sha2"], "left").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"),
        "url",
        "payload",
        "sha1",
        F.when(F.col("page_id") != F.col("response"), F.col("response").cast("string")).alias("refers"),
    )
    # The separator that ends each row, and so each file, is the magic number of the footer.
    (
        records.mapInArrow(_bundles(frame_bytes, bundle_bytes), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", SEEK_MAGIC.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            entries = index_of(batch.column(1)[i].as_py())
            keys, frames, offsets, sizes = zip(*entries, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([record_id(k) for k in keys]),
                    pa.array([batch.column(0)[i].as_py()] * len(entries)),
                    *(pa.array(x, pa.int64()) for x in (frames, offsets, sizes)),
                ],
                ["record_id", "path", "frame", "offset", "size"],
            )


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, path, frame, offset, size) of all records; no frame is decompressed."""
    return archive_files(spark, path).mapInArrow(
        _index_rows, "record_id string, path string, frame long, offset long, size long"
    )


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    )
    number = lambda x: int(x) if x else None
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(1)[i].as_py()
            frames, at, frame, rows = seek_table(data), -1, b"", []

            def out(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

            for _, own, offset, size in index_of(data):
                if own != at:
                    if rows:
                        yield out(rows)
                    at, frame, rows = own, frame_of(data, frames, own), []
                fields, http, payload = parsed(frame[offset : offset + size])
                revisit = fields["WARC-Type"] == "revisit"
                sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if not revisit and hashlib.sha1(payload).hexdigest() != sha1:
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                rows.append(
                    (number(fields["X-Source-Key"]), int(http["Content-Length"]), sha1, fields["WARC-Type"],
                     number(fields.get("X-Refers-To-Key")), fields.get("WARC-Target-URI"), None if revisit else payload)
                )
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all bundles, each frame decompressed once, digests confirmed."""
    return archive_files(spark, path).mapInArrow(_record_rows, RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = shared_folder(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).drop("url", "payload")


OP9_SQL = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
        sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as html from pages
), w as (
    select *, case when payload_bytes >= 1000 then max(page_id) over (partition by html) else page_id end as best from p
)
select page_id, payload_bytes, payload_digest,
    case when best = page_id then 'response' else 'revisit' end as record_type,
    case when best != page_id then best end as refers_to
from w
"""
