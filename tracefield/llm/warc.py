"""WARC archives as a chunked record table.

``write_warc`` turns pages into gzipped WARC records, one archive per task;
pages that repeat a payload become revisit records.  ``read_chunks`` streams
archives back as rows of record id and chunk number.  Each chunk carries the
bytes and the SHA-1 of the payload so far, so a payload is never held whole
and the last chunk has the digest of all of it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

FILE_SCHEMA = "path string, records long, bytes long"
RECORD_ID = "urn:tracefield:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = pa.schema([
    ("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("url", pa.string()),
    ("refers_to", pa.string()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.binary()),
    ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_()),
])
CHUNK_SCHEMA = (
    "record_id string, chunk_no int, record_type string, url string, refers_to string, payload_length long,"
    " payload_digest string, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"
)


def with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with their payload's length and SHA-1 and, where an equal payload
    of at least ``least_bytes`` has a larger ``page_id``, that id."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        "page_id", F.col("url").alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"),
    )
    last = (
        pages.filter(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "keeper")
    )
    last = common.stage_table(last, "warc-keepers")
    return pages.join(common.broadcast_within(last, 500_000), "digest", "left").withColumn(
        "keeper", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper"))
    )


def head_of(page_id: int | None, url: str | None, digest: str, size: int, keeper: int | None, date: str) -> bytes:
    """What comes before the payload of a WARC record: its headers and the
    HTTP header.  A revisit has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <{RECORD_ID}{keeper}>", f"WARC-Profile: {REVISIT_PROFILE}"] if keeper is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (size if keeper is None else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_record(out, head: bytes, payload, step: int = 1 << 18) -> None:
    """Write one record as a gzip member, its payload in slices of ``step``
    bytes: no copy of the payload is made."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(packer.compress(head))
    view = memoryview(payload)
    for at in range(0, len(view), step):
        out.write(packer.compress(view[at : at + step]))
    out.write(packer.compress(b"\r\n\r\n") + packer.flush())


def write_warc(pages: DataFrame, out_dir: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> list[dict]:
    """Write every row of ``pages`` (``page_id, url, html``; other columns are
    ignored) as a record under ``out_dir``.

    Of equal payloads of at least ``least_bytes``, rows with the largest
    ``page_id`` are responses and all others revisits of it; smaller ones are
    all responses.  A null html is an empty payload, a null url has no target,
    a null id is kept and never referred to while the group has another.
    Rows that repeat an id are records of their own, so two responses can
    share an id.  Payloads of any length are streamed from the batch.
    Returns one row per archive; an empty table writes none.
    """
    common.session(pages)
    files.make_dir(out_dir)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = 0
        for batch in batches:
            ids, urls, digests, sizes, keepers = (batch[c].to_pylist() for c in ("page_id", "url", "digest", "size", "keeper"))
            for k, html in enumerate(batch["html"]):
                if out is None:
                    path = f"{out_dir}/{files.attempt_name('.warc.gz')}"
                    store, inner = files.open_fs(path)
                    out = store.open_output_stream(inner)
                payload = html.as_buffer() if keepers[k] is None else b""
                write_record(out, head_of(ids[k], urls[k], digests[k], sizes[k], keepers[k], date), payload)
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}])

    rows = with_revisits(pages, least_bytes).select("page_id", "url", "html", "digest", "size", "keeper")
    written = [r.asDict() for r in rows.mapInArrow(task, FILE_SCHEMA).collect()]
    files.write_manifest(out_dir, written)
    return written


class Unzipped:
    """Bytes of a file of gzip members, read in small steps."""

    def __init__(self, file, step: int = 1 << 16):
        self.file, self.step = file, step
        self.unzip, self.raw, self.data = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(self.step)
                if not self.raw:
                    return False
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.raw, self.step)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if got:
                self.data += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is consumed; None at the end."""
        while (at := self.data.find(mark)) < 0:
            if not self._more():
                return None
        got, self.data = self.data[:at], self.data[at + len(mark) :]
        return got

    def some(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes."""
        if not self.data and not self._more():
            raise EOFError("record cut short")
        got, self.data = self.data[:most], self.data[most:]
        return got


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def chunks_of(file, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of one archive."""
    source = Unzipped(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        warc = _headers(head)
        http = source.until(b"\r\n\r\n") or b""
        left = int(warc["content-length"]) - len(http) - 4
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        row = {
            "record_id": warc["warc-record-id"].strip("<>"), "record_type": warc["warc-type"], "url": warc.get("warc-target-uri"),
            "refers_to": warc["warc-refers-to"].strip("<>") if "warc-refers-to" in warc else None,
            "payload_length": int(_headers(http)["content-length"]), "payload_digest": digest,
        }
        sha, total, number = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while size < min(chunk_bytes, left):
                parts.append(source.some(min(chunk_bytes, left) - size))
                size += len(parts[-1])
            chunk = b"".join(parts)
            left -= size
            total += size
            sha.update(chunk)
            yield row | {"chunk_no": number, "chunk": chunk, "bytes_so_far": total, "sha1_so_far": sha.hexdigest(), "is_last": not left}
            number += 1
            if not left:
                break
        source.until(b"\r\n\r\n")


def read_chunks(spark: SparkSession, in_dir: str, chunk_bytes: int = 1 << 18, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunked record table of a written folder.

    One row per record and chunk of at most ``chunk_bytes``: ``record_id,
    chunk_no, record_type, url, refers_to, payload_length, payload_digest``
    (as declared), ``chunk, bytes_so_far, sha1_so_far, is_last``.  An empty
    payload and a revisit have one empty chunk.
    """
    listed = [(r["path"],) for r in files.read_manifest(in_dir)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, inner = files.open_fs(path)
                with store.open_input_stream(inner) as file:
                    rows, held = [], 0
                    for row in chunks_of(file, chunk_bytes):
                        rows.append(row)
                        held += len(row["chunk"]) + 300
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, CHUNKS)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, CHUNKS)

    table = spark.createDataFrame(listed, "path string")
    return table.repartition(max(1, len(listed))).mapInArrow(task, CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from the chunks that end them; ``intact`` says
    whether the payload read has the digest declared."""
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(RECORD_ID) + 1}) AS long)")
    response = F.col("record_type") == "response"
    return chunks.filter("is_last").select(
        page("record_id").alias("page_id"),
        "url",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        (~response | (F.col("sha1_so_far") == F.col("payload_digest"))).alias("intact"),
        (F.col("chunk_no") + 1).alias("chunks"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS size FROM pages
), k AS (
  SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS keeper FROM p
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""
