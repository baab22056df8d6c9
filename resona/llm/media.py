"""Media columns: payloads stored as lossless 8-bit images in archives, read back by byte range.

An archive is a file of members, one after another, followed by its directory
(one fixed-size entry per member, in order of offset) and a footer.  The data
source ``resona_media`` plans byte ranges over the archives from their sizes
alone; a task finds the members that start in its range by bisecting the
archive's directory, and reads them one by one by offset.  A member that comes
short or fails its checksum is read again by itself, from a newly opened file.

The writer is a data source too: tasks write archives under names of their own
attempt, and the commit records those of the attempts that counted, so lost
executors and repeated attempts leave no doubled members.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import scratch, whole_text

#: Bytes of an image row; payloads are padded to whole rows.
ROW = 576
PAD = b"\xff"
#: Members of a payload batch stay within this many bytes, where there is more than one.
BATCH_BYTES = 16 << 20
#: Bytes of a planned range.
RANGE_BYTES = 32 << 20
#: Times a member is read before its task fails.
ATTEMPTS = 4

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: offset, length, crc32 of the member, id present, id
_ENTRY = struct.Struct("<QQIBxxxq")
_FOOTER = struct.Struct("<QQ8s")
_MAGIC = b"RESMEDIA"
MANIFEST = "_committed.json"


# --- the stored form -------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ROW."""
    return raw + PAD * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG, ROW samples wide, unfiltered; the unpadded length is not in it."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> bytes:
    """The samples of an image of ``encode_image``; ValueError where it is damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, body, width, rows = 8, [], 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(part) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Features of the samples: count, mean, spread, zero crossings about the mean, entropy in bits."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float(counts @ np.arange(256) / len(x))
    spread = float(np.sqrt(max(0.0, counts @ (np.arange(256) - mean) ** 2 / len(x))))
    above = x > mean
    return f"n={len(x)};mean={mean:.4f};std={spread:.4f};crossings={int((above[1:] != above[:-1]).sum())};entropy={float(-(p * np.log2(p)).sum()):.4f}"


# --- archives --------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@dataclass
class _Written(WriterCommitMessage):
    archive: str
    members: int
    size: int


class MediaWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, text) as one archive per task."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"media-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        directory = []
        at = 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                ids, texts = batch.column("doc_id"), batch.column("text")
                for i in range(batch.num_rows):
                    raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                    media = struct.pack("<Q", len(raw)) + encode_image(padded(raw))
                    out.write(media)
                    known = ids[i].is_valid
                    directory.append(_ENTRY.pack(at, len(media), zlib.crc32(media), known, ids[i].as_py() if known else 0))
                    at += len(media)
            out.write(b"".join(directory))
            out.write(_FOOTER.pack(at, len(directory), _MAGIC))
        return _Written(name, len(directory), at + _ENTRY.size * len(directory) + _FOOTER.size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files = sorted((m.archive, m.size) for m in messages if m is not None and m.members)
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/{m.archive}")


@dataclass
class _Range(InputPartition):
    archive: str
    start: int
    end: int

    def __init__(self, archive: str, start: int, end: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


class Archive:
    """One archive, read by offset; ``opener`` is replaced in tests."""

    def __init__(self, uri: str, opener=None):
        system, path = _open(uri)
        self._new = (lambda: opener(path)) if opener else (lambda: system.open_input_file(path))
        self._file = None

    def read(self, offset: int, length: int, crc: int | None = None) -> bytes:
        """``length`` bytes at ``offset``, read anew from a newly opened file until they are whole."""
        for attempt in range(ATTEMPTS):
            try:
                if self._file is None:
                    self._file = self._new()
                self._file.seek(offset)
                got = self._file.read(length)
                if len(got) == length and (crc is None or zlib.crc32(got) == crc):
                    return got
                problem = f"{len(got)} of {length} bytes, or a wrong checksum"
            except OSError as e:
                problem = str(e)
            self._file = None
            time.sleep(0.05 * 2**attempt)
        raise OSError(f"member at {offset}: {problem}")

    def members(self, size: int, start: int, end: int) -> Iterator[tuple[int, int, int, bool, int]]:
        """Directory entries whose members start in [start, end)."""
        at, many, magic = _FOOTER.unpack(self.read(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise OSError("not a media archive")

        def entry(i: int) -> tuple:
            return _ENTRY.unpack(self.read(at + i * _ENTRY.size, _ENTRY.size))

        def first(bound: int) -> int:
            low, high = 0, many
            while low < high:
                mid = (low + high) // 2
                if entry(mid)[0] < bound:
                    low = mid + 1
                else:
                    high = mid
            return low

        low, high = first(start), first(end)
        for a in range(low, high, 4096):
            block = self.read(at + a * _ENTRY.size, (min(high, a + 4096) - a) * _ENTRY.size)
            yield from _ENTRY.iter_unpack(block)


class MediaReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path.rstrip("/"), size

    def partitions(self) -> list[InputPartition]:
        system, folder = _open(self.path)
        with system.open_input_file(f"{folder}/{MANIFEST}") as f:
            files = json.loads(f.read())
        self._sizes = dict(files)
        return [_Range(json.dumps([name, total]), a, a + self.size) for name, total in files for a in range(0, total, self.size)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        name, total = json.loads(partition.archive)
        archive = Archive(f"{self.path}/{name}")
        rows: list[tuple] = []
        held = 0
        for offset, length, crc, known, doc_id in archive.members(total, partition.start, partition.end):
            member = archive.read(offset, length, crc)
            (n_bytes,) = struct.unpack_from("<Q", member)
            rows.append((doc_id if known else None, n_bytes, member[8:]))
            held += length
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaSource(DataSource):
    """``spark.read/write.format("resona_media")``; reads (doc_id, n_bytes, media)."""

    @classmethod
    def name(cls) -> str:
        return "resona_media"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MediaWriter(self.options["path"])


def store(docs: DataFrame, path: str) -> None:
    """Writes the texts (null: empty) as archives below ``path``."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaSource)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    slim.write.format("resona_media").mode("append").save(path)


def load(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, media) of the committed archives below ``path``."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("resona_media").option("rangeBytes", range_bytes).load(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for media in batch.column("media"):
            stored = media.as_buffer().to_pybytes()
            samples = decode_image(stored)
            row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(samples))
            for into, v in zip(out, row, strict=True):
                into.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text as a media member, reads the members back and describes them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.  Null text counts as empty and gives one
    row of samples 255; null and repeated doc_ids keep their rows; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "media")
    store(docs, path)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return load(spark, path).mapInArrow(_digests, schema)
