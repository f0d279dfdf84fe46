"""WARC archives as seekable Zstandard bundles.

Payloads are digested by Spark; of equal payloads of at least `revisit_from` bytes the record
with the smallest page_id is a response, the others revisit it. Each task writes its records
to bundles in the shared folder: records are grouped into independent frames, a footer holds
the seek table (the seekable format's skippable frame), and a manifest maps record ids to
frame-relative offsets. A reader takes a frame's place from the footer, decodes that frame
alone, and slices its records.

A bundle's name holds the task attempt, and only the manifest rows of a successful attempt
are kept, so lost or repeated tasks leave files that nothing refers to. The join that tells
first records from revisits is salted, so that a payload shared by many pages is dealt out.

Defined results: null html is an empty payload; payloads under the bound are all responses;
rows that repeat the smallest page_id of a payload are all responses; a null page_id is
always a response and never a revisit's target unless no other row has an id (then all are
responses); null urls are written as empty; an empty table writes nothing and gives no rows;
extra columns are ignored. A record larger than a frame has a frame of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, qualified

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "bundle string, frame int, records array<struct<record_id:string,offset:long,length:long>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def read_record(record: bytes) -> tuple:
    """The columns of RECORDS; a response's length and digest come from its payload itself."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.removesuffix(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    if kind == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    else:
        length, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return page_of(fields["WARC-Record-ID"]), length, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, fields["WARC-Target-URI"] or None


class BundleWriter:
    """Frames of about frame_bytes; close() appends the seek table."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        import zstandard

        self.path, self.frame_bytes = path, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        fs, place = file_system(path)
        fs.create_dir(place.rpartition("/")[0])
        self.out = fs.open_output_stream(place, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.held, self.size = [], [], 0
        self.manifest: list[tuple] = []

    def add(self, record_id: str, record: bytes) -> None:
        if self.size and self.size + len(record) > self.frame_bytes:
            self.frame()
        self.held.append((record_id, self.size, len(record)))
        self.buffer.append(record)
        self.size += len(record)

    def frame(self) -> None:
        if not self.size:
            return
        data = self.codec.compress(b"".join(self.buffer))
        self.out.write(data)
        self.manifest.append((self.path, len(self.frames), [{"record_id": i, "offset": o, "length": n} for i, o, n in self.held]))
        self.frames.append((len(data), self.size))
        self.buffer, self.held, self.size = [], [], 0

    def written(self) -> int:
        return sum(c for c, _ in self.frames)

    def close(self) -> list[tuple]:
        self.frame()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.manifest


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(end - 9 - n * entry)
    sizes = [struct.unpack_from("<II", e) for e in (f.read(entry) for _ in range(n))]
    out, at = [], 0
    for c, d in sizes:
        out.append((at, c, d))
        at += c
    return out


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, revisit_from: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, salts: int = 32, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The manifest of the bundles written under folder: one row per frame. A folder without a scheme is of the session's default file system, as for Spark's own writers."""
    folder = qualified(spark, folder)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    spread = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))
    shared = rows.where(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("digest", "first_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    joined = rows.withColumn("salt", spread.cast("long")).join(shared, ["digest", "salt"], "left")
    typed = joined.select("page_id", "url", "payload", "digest", F.when((F.col("bytes") >= revisit_from) & (F.col("page_id") > F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def manifest(rows: list[tuple]) -> pa.RecordBatch:
        record = pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        kinds = (pa.string(), pa.int32(), pa.list_(record))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bundle", "frame", "records"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number, bundle = TaskContext.get(), 0, None
        for b in batches:
            for page_id, url, text, digest, refers_to in zip(*b.columns, strict=True):
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:04d}.warc.zst", frame_bytes, level)
                    number += 1
                i = page_id.as_py()
                bundle.add(urn(i), write_record(i, url.as_py(), text.as_py().encode(), digest.as_py(), refers_to.as_py(), date))
                if bundle.written() >= bundle_bytes:
                    yield manifest(bundle.close())
                    bundle = None
        if bundle is not None:
            yield manifest(bundle.close())

    return typed.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Reads each frame of a manifest by its bundle's footer and returns its records' columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=64)
        def footer(bundle: str) -> list[tuple[int, int, int]]:
            fs, place = file_system(bundle)
            with fs.open_input_file(place) as f:
                return seek_table(f)

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for b in batches:
            for bundle, frame, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, size, plain = footer(bundle)[frame]
                fs, place = file_system(bundle)
                with fs.open_input_file(place) as f:
                    f.seek(at)
                    data = codec.decompress(f.read(size), max_output_size=plain)
                rows = [read_record(data[r["offset"] : r["offset"] + r["length"]]) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])

    return manifest.mapInArrow(read, RECORDS)


def fetch(manifest: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records that record_ids (record_id) names, read from their own frames alone: only their places are passed on.

    An id that stands on several records gives them all; an unknown or null id gives none, a repeated one counts once.
    """
    asked = record_ids.select("record_id").distinct()
    places = manifest.select("bundle", "frame", F.explode("records").alias("r")).select("bundle", "frame", "r", F.col("r.record_id").alias("record_id"))
    found = places.join(asked, "record_id", "left_semi").groupBy("bundle", "frame").agg(F.collect_list("r").alias("records"))
    return read_archives(found)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, one row per page."""
    scratch = Scratch(spark, "warc")
    manifest = scratch.cut(write_archives(spark, pages, scratch.path("bundles"), **options), "manifest")
    return read_archives(manifest)
