"""Media columns: payloads as lossless 8-bit grey images in archives, and a
data source that reads them by byte ranges.

``write_archives`` stores each payload as a PNG, 64 samples a row, in ZIP
archives (members stored, not compressed again).  ``ArchiveSource`` reads any
directory of ZIP archives.  It plans one partition per byte range of each
archive; a task reads the archive's central directory, takes the members whose
headers start in its range, and streams them as Arrow batches.  An archive has
at most ``MOST_RANGES`` ranges, so its directory is read no more often.  Each member is fetched by its own
offset, checked against its crc and fetched again on its own if that fails.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common, files

WIDTH = 64
MOST_RANGES = 64
FILE_SCHEMA = "path string, members long, bytes long"
MEMBER_SCHEMA = "archive string, member string, offset long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """A grey 8-bit image of the padded bytes; the true length goes along."""
    payload = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(payload), WIDTH + 1), np.uint8)
    rows[:, 1:] = payload
    head = struct.pack(">IIBBBBB", WIDTH, len(payload), 8, 0, 0, 0, 0)
    note = b"Length\0" + str(len(data)).encode()
    return b"".join([_SIGNATURE, _chunk(b"IHDR", head), _chunk(b"tEXt", note), _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)), _chunk(b"IEND", b"")])


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples of an image written by ``to_png`` and the true length."""
    at, height, length, packed = len(_SIGNATURE), 0, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            height = struct.unpack_from(">II", data)[1]
        elif kind == b"tEXt":
            length = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    return np.ascontiguousarray(rows[:, 1:]), length


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread and a 16-bin histogram of the samples."""
    counts = np.bincount(samples.ravel() >> 4, minlength=16)
    share = np.floor(counts * 255 / samples.size).astype(int)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};hist={''.join(f'{x:02x}' for x in share)}"


def write_archives(docs: DataFrame, out_dir: str, archive_bytes: int = 256 << 20) -> list[dict]:
    """Store every text of ``docs`` (``doc_id, text``; other columns are
    ignored) as an image in archives under ``out_dir``; a task starts a new
    archive after ``archive_bytes``.

    Texts of any length are one member each.  A null text is an empty payload, stored as one row of zeros; a null id is
    kept.  Repeated rows are members of their own.  The manifest lists the
    archives of finished tasks, one row each; an empty table lists none.
    """
    common.session(docs)
    files.make_dir(out_dir)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = path = out = None
        members = 0

        def finish() -> pa.RecordBatch:
            archive.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "members": members, "bytes": size}])

        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if archive is None:
                    path, members = f"{out_dir}/{files.attempt_name('.zip')}", 0
                    store, inner = files.open_fs(path)
                    out = store.open_output_stream(inner)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                name = zipfile.ZipInfo(f"{members:09d}/{'null' if key is None else key}.png")
                archive.writestr(name, to_png((text.as_py() or "").encode()))
                members += 1
                if out.tell() >= archive_bytes:
                    yield finish()
                    archive = None
        if archive is not None:
            yield finish()

    written = [r.asDict() for r in docs.select("doc_id", "text").mapInArrow(task, FILE_SCHEMA).collect()]
    files.write_manifest(out_dir, written)
    return written


class ByteRange(InputPartition):
    """The members of an archive whose headers start in ``[start, end)``."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.directory = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangeBytes", 8 << 20))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives that a manifest lists, or else of all
        ZIP files of the directory."""
        listed = files.read_manifest(self.directory, missing=None)
        archives = files.list_files(self.directory, ".zip") if listed is None else [(r["path"], r["bytes"]) for r in listed]
        found = []
        for path, size in archives:
            step = max(self.range_bytes, -(-size // MOST_RANGES))
            found += [ByteRange(path, k, k + step) for k in range(0, size, step)]
        return found or [ByteRange("", 0, 0)]

    def fetch(self, path: str, member: zipfile.ZipInfo) -> bytes:
        """One member's bytes, by offset; a failed try opens the archive anew."""
        for attempt in range(self.retries):
            try:
                store, inner = files.open_fs(path)
                with store.open_input_file(inner) as got:
                    return read_member(got, member)
            except (OSError, ValueError):
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.2 * 2**attempt)
        raise AssertionError("unreachable")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, inner = files.open_fs(partition.path)
        rows, held = [], 0
        with store.open_input_file(inner) as got:
            for member in zipfile.ZipFile(got).infolist():
                if member.is_dir() or not partition.start <= member.header_offset < partition.end:
                    continue
                try:
                    data = read_member(got, member)
                except (OSError, ValueError):
                    data = self.fetch(partition.path, member)
                rows.append((partition.path, member.filename, member.header_offset, data))
                held += len(data)
                if held >= self.batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def read_member(archive, member: zipfile.ZipInfo) -> bytes:
    """A member, stored or deflated, read at its offset and checked."""
    name, extra = struct.unpack("<HH", archive.read_at(4, member.header_offset + 26))
    data = archive.read_at(member.compress_size, member.header_offset + 30 + name + extra)
    if member.compress_type == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompress(data, -15)
        except zlib.error as error:
            raise ValueError(f"{member.filename}: {error} at {member.header_offset}") from error
    elif member.compress_type != zipfile.ZIP_STORED:
        raise NotImplementedError(f"{member.filename}: compression {member.compress_type}")
    if zlib.crc32(data) != member.CRC:
        raise ValueError(f"{member.filename}: checksum differs at {member.header_offset}")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in MEMBER_SCHEMA.split(", ")])


class ArchiveSource(DataSource):
    """``spark.read.format("tracefield_archives").load(directory)``."""

    @classmethod
    def name(cls) -> str:
        return "tracefield_archives"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """``archive, member, offset, media`` of every member in a directory."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tracefield_archives").load(directory)


def features(members: DataFrame) -> DataFrame:
    """Decode the media column and compute each payload's digests and
    feature from the samples read back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch["member"].to_pylist(), batch["media"]):
                media = media.as_py()
                samples, length = from_png(media)
                payload = samples.tobytes()
                key = name.rpartition("/")[2].removesuffix(".png")
                rows.append({
                    "doc_id": None if key == "null" else int(key), "n_bytes": length, "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]),
                    "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(samples),
                })
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return members.mapInArrow(task, FEATURE_SCHEMA)
