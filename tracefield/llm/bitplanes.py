"""Token-id files in shuffled planes.

A file holds blocks of a fixed number of ids.  A block is transposed into byte
planes (the first bytes of all ids, then the second, ...) or bit planes, and
each plane is compressed with zstandard on its own.  Behind the blocks lie the
documents' ids and lengths and an index of all chunks, so a reader can seek to
any block::

    block 0 planes | block 1 planes | ... | documents | index | trailer
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common, files, tokens

MAGIC = b"TFPLANE1"
_TRAILER = struct.Struct("<QQ8s")
FILE_SCHEMA = "part int, path string, documents long, ids long, bytes long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, without the high ones that are all zero."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    width = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    if kind == "byte":
        return [octets[k].tobytes() for k in range(width)]
    return [np.packbits((octets[k] >> b) & 1).tobytes() for k in range(width) for b in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            octets[k] = np.frombuffer(plane, np.uint8)
    else:
        for k, plane in enumerate(planes):
            octets[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


class PlaneWriter:
    """Writes one file; holds one block of ids at a time."""

    def __init__(self, uri: str, kind: str, block_ids: int, level: int):
        store, path = files.open_fs(uri)
        self.out = store.open_output_stream(path)
        self.kind, self.block_ids = kind, block_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.held = self.total = self.at = 0
        self.index: list[list] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        at = self.at
        self.index.append([at, len(ids), [self._put(self.zstd.compress(p)) for p in to_planes(ids, self.kind)]])

    def add(self, key: int | None, data: bytes) -> None:
        """One document's ids, as little-endian unsigned 32-bit integers."""
        self.keys.append(key)
        self.sizes.append(len(data) // 4)
        self.total += len(data) // 4
        self.pending.append(data)
        self.held += len(data) // 4
        if self.held >= self.block_ids:
            ids = np.frombuffer(b"".join(self.pending), "<u4")
            whole = len(ids) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.pending, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> int:
        """Finish the file; its size in bytes."""
        if self.held:
            self._block(np.frombuffer(b"".join(self.pending), "<u4"))
        docs_at = self.at
        null = np.array([k is None for k in self.keys], np.uint8).tobytes()
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes()
        self._put(self.zstd.compress(null + keys + np.array(self.sizes, "<i8").tobytes()))
        index_at = self.at
        self._put(self.zstd.compress(json.dumps({"kind": self.kind, "documents": len(self.keys), "blocks": self.index}).encode()))
        self._put(_TRAILER.pack(docs_at, index_at, MAGIC))
        self.out.close()
        return self.at


class PlaneReader:
    """Reads a file by its index, one block at a time."""

    def __init__(self, uri: str):
        store, path = files.open_fs(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        docs_at, index_at, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a plane file: {uri}")
        self.zstd = zstandard.ZstdDecompressor()
        head = json.loads(self.zstd.decompress(self.file.read_at(size - _TRAILER.size - index_at, index_at)))
        self.kind, self.blocks, n = head["kind"], head["blocks"], head["documents"]
        data = self.zstd.decompress(self.file.read_at(index_at - docs_at, docs_at))
        nulls = np.frombuffer(data, np.uint8, n)
        keys, sizes = np.frombuffer(data, "<i8", 2 * n, n).reshape(2, n)
        self.keys = [None if null else key for null, key in zip(nulls, keys.tolist())]
        self.sizes = sizes.tolist()

    def block(self, k: int) -> np.ndarray:
        at, n, lengths = self.blocks[k]
        data, planes, begin = self.file.read_at(sum(lengths), at), [], 0
        for length in lengths:
            planes.append(self.zstd.decompress(data[begin : begin + length]))
            begin += length
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and its token ids, in file order."""
        k, data, at = 0, b"", 0
        for key, size in zip(self.keys, self.sizes):
            parts, need = [], 4 * size
            while need > len(data) - at:
                parts.append(data[at:])
                need -= len(data) - at
                data, at, k = self.block(k).tobytes(), 0, k + 1
            parts.append(data[at : at + need])
            at += need
            yield key, b"".join(parts)


def write_ids(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    end_id: int = 1,
    kind: str = "byte",
    block_ids: int = 1 << 16,
    level: int = 3,
) -> list[dict]:
    """Encode ``docs`` (``doc_id, text``; other columns are ignored) in
    ascending ``doc_id`` into plane files under ``out_dir``.

    A null or empty text is the end id alone; a null id sorts first; rows that
    repeat an id are documents of their own.  Each task streams its documents
    into a file of its own; the manifest lists the files of finished tasks, in
    order, one row per file.  An empty table gives an empty manifest.
    """
    common.session(docs)
    files.make_dir(out_dir)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        last = np.array([end_id], "<u4").tobytes()
        writer = path = None
        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if writer is None:
                    path = f"{out_dir}/{files.attempt_name('.planes')}"
                    writer = PlaneWriter(path, kind, block_ids, level)
                writer.add(key, encoder.encode(text.as_py()) + last)
        encoder.forget()
        if writer is not None:
            size = writer.close()
            row = {"part": TaskContext.get().partitionId(), "path": path, "documents": len(writer.keys), "ids": writer.total, "bytes": size}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    ordered = common.in_order(docs)
    written = sorted((r.asDict() for r in ordered.mapInArrow(task, FILE_SCHEMA).collect()), key=lambda r: r["part"])
    start = 0
    for row in written:
        row["start"] = start
        start += row["ids"]
    files.write_manifest(out_dir, written)
    return written


def read_ids(spark: SparkSession, in_dir: str) -> DataFrame:
    """Per document of a written folder: ``doc_id, start`` (ids of all
    documents before it), ``n_tokens`` and the crc32 of its ids."""
    listed = [(r["path"], r["start"]) for r in files.read_manifest(in_dir)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                rows = []
                for key, data in PlaneReader(path).documents():
                    rows.append((key, start, len(data) // 4, zlib.crc32(data)))
                    start += len(data) // 4
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(listed, "path string, start long")
    return table.repartition(max(1, len(listed))).mapInArrow(task, DOC_SCHEMA)
