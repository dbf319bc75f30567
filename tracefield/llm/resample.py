"""Importance resampling towards a target text by hashed n-gram features.

A task runs DuckDB over the texts of its partition: SQL unnests the words,
windows join runs of one to three of them, and registered functions over
zlib's CRC tell their buckets.  The counts of a document's buckets are spilled
to Parquet in the shared folder; Spark merges them into the gain of each
bucket, scores the documents from the same counts, and ranks them over ranges
of the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 10_000
#: Bytes of a text that DuckDB gets as one row, and bytes it gets at a time.
PIECE, TAKEN = 1 << 18, 1 << 20
_TWO = re.compile(rb"(?: *[^ ]+){0,2}")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPILL_SCHEMA = "n_words long, n_features long, buckets binary, counts binary"

#: Counts of buckets per document; a row of ``texts`` with sign -1 takes back
#: what the words that two pieces share were counted twice.
COUNTS = f"""
WITH word AS MATERIALIZED (SELECT doc, part, sign, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT *, string_split(plain, ' ') AS words FROM texts)),
vocabulary AS MATERIALIZED (SELECT word, crc(word) AS c, strlen(word) AS n FROM (SELECT DISTINCT word FROM word WHERE word != '')),
run AS (SELECT doc, sign, c AS one, lead(c, 1) OVER w AS second, lead(n, 1) OVER w AS size2, lead(c, 2) OVER w AS third, lead(n, 2) OVER w AS size3
  FROM word JOIN vocabulary USING (word) WINDOW w AS (PARTITION BY part ORDER BY pos)),
pair AS (SELECT *, crc_append(one, second, size2) AS two FROM run),
feature AS (SELECT doc, sign, unnest([one, two, crc_append(two, third, size3)]) % {BUCKETS} AS bucket, unnest([1, 0, 0]) AS first FROM pair)
SELECT doc, bucket::USMALLINT AS bucket, sum(sign)::UINTEGER AS n, sum(sign * first)::UINTEGER AS words FROM feature WHERE bucket IS NOT NULL GROUP BY doc, bucket HAVING sum(sign) > 0 ORDER BY doc, bucket
"""


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """Lower-cased words of ``text`` between spaces, in pieces that are cut at
    spaces and go on for two words of the next; those two words as a piece of
    sign -1."""
    data = text.encode().translate(_PLAIN)
    begin = 0
    while (end := data.find(b" ", begin + PIECE)) >= 0:
        shared = _TWO.match(data, end)
        yield data[begin : shared.end()].decode(), 1
        yield shared[0].decode(), -1
        begin = end
    yield data[begin:].decode(), 1


def crc(words: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC of every word."""
    found = words.combine_chunks()
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].tolist()
    data = found.buffers()[2].to_pybytes() if ends[-1] else b""
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])], pa.uint32())


_SHIFTS: dict[int, np.ndarray] = {}


def _shift(n: int) -> np.ndarray:
    """Tables, per byte of a CRC, of what ``n`` zero bytes make of it."""
    if n not in _SHIFTS:
        zeros = bytes(n)
        base = zlib.crc32(zeros)
        bits = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.uint32)
        byte = np.arange(256)
        table = np.zeros((4, 256), np.uint32)
        for k in range(32):
            table[k // 8] ^= np.where(byte >> k % 8 & 1, bits[k], np.uint32(0)).astype(np.uint32)
        if len(_SHIFTS) > 4096:
            _SHIFTS.clear()
        _SHIFTS[n] = table
    return _SHIFTS[n]


def _numbers(x: pa.ChunkedArray, kind: type) -> np.ndarray:
    return x.combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(kind)


def crc_append(head: pa.ChunkedArray, tail: pa.ChunkedArray, size: pa.ChunkedArray) -> pa.Array:
    """CRC of two strings and a space between from theirs, where the second
    has ``size`` bytes; null where there is no second."""
    c, n = _numbers(head, np.uint32), _numbers(size, np.int64)
    lengths, at = np.unique(n, return_inverse=True)
    tables = np.stack([_shift(1), *[_shift(int(k)) for k in lengths]])
    space = np.uint32(zlib.crc32(b" "))

    def moved(x: np.ndarray, which: np.ndarray | int) -> np.ndarray:
        return tables[which, 0, x & 255] ^ tables[which, 1, x >> 8 & 255] ^ tables[which, 2, x >> 16 & 255] ^ tables[which, 3, x >> 24]

    out = moved(moved(c, 0) ^ space, at + 1) ^ _numbers(tail, np.uint32)
    return pa.array(out, mask=tail.combine_chunks().is_null().to_numpy(zero_copy_only=False))


def engine():
    """A DuckDB connection with the functions of ``COUNTS``; it holds a bounded
    number of bytes and writes no files."""
    import duckdb
    from duckdb import sqltypes as types

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    con.create_function("crc", crc, [types.VARCHAR], types.UINTEGER, type="arrow")
    con.create_function("crc_append", crc_append, [types.UINTEGER, types.UINTEGER, types.BIGINT], types.UINTEGER, type="arrow", null_handling="special")
    return con


class _Counter:
    """Counts of the texts of a batch, taken to DuckDB a bounded part at a
    time."""

    def __init__(self, con, texts: int):
        self.con = con
        self.found: list[list[tuple]] = [[] for _ in range(texts)]
        self.rows: list[tuple[int, str, int]] = []
        self.size = 0

    def add(self, doc: int, text: str) -> None:
        for plain, sign in pieces(text):
            self.rows.append((doc, plain, sign))
            self.size += len(plain)
            if self.size >= TAKEN:
                self.take()

    def take(self) -> None:
        if not self.rows:
            return
        doc, plain, sign = zip(*self.rows)
        arrays = [pa.array(doc, pa.int32()), pa.array(range(len(doc)), pa.int32()), pa.array(plain, pa.string()), pa.array(sign, pa.int32())]
        self.con.register("texts", pa.table(arrays, ["doc", "part", "plain", "sign"]))
        got = self.con.sql(COUNTS).to_arrow_table()
        self.con.unregister("texts")
        self.rows, self.size = [], 0
        of, bucket, n, words = (got[c].to_numpy() for c in ("doc", "bucket", "n", "words"))
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self.found[of[a]].append((bucket[a:b], n[a:b], words[a:b]))


def spill_counts(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` and with ``n_words``, ``n_features`` and the
    counts of its buckets as packed unsigned numbers (16 and 32 bits), as a
    table in the shared folder."""
    common.session(docs)
    names = [c.split()[0] for c in SPILL_SCHEMA.split(", ")]
    kept = [c for c in docs.columns if c not in {*names, "text"}]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        for batch in batches:
            counter = _Counter(con, batch.num_rows)
            for k, text in enumerate(batch["text"]):
                if text.is_valid:
                    counter.add(k, text.as_py())
            counter.take()
            rows = []
            for parts in counter.found:
                bucket, n, words = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint32),) * 3
                rows.append((int(words.sum()), int(n.sum()), bucket.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            extra = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *extra], names=[*kept, *names])

    schema = T.StructType([*docs.select(*kept).schema.fields, *T.StructType.fromDDL(SPILL_SCHEMA).fields])
    return common.stage_table(docs.select(*kept, "text").mapInArrow(task, schema), "bucket-counts")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and counts of a batch of packed rows, and each row's number."""
    buckets, counts = (np.frombuffer(b"".join(batch[c].to_pylist()), kind) for c, kind in (("buckets", "<u2"), ("counts", "<u4")))
    sizes = np.array([len(x.as_buffer()) // 2 for x in batch["buckets"]], np.int64)
    return buckets, counts, np.repeat(np.arange(batch.num_rows), sizes)


def bucket_totals(spilled: DataFrame, name: str) -> DataFrame:
    """``(bucket, name)`` of buckets that occur: a sum per task, merged."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buckets, counts, _ = _unpacked(batch)
            total += np.bincount(buckets, counts, BUCKETS).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    sums = spilled.select("buckets", "counts").mapInArrow(task, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, from spilled counts."""
    spark = docs.sparkSession
    found = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    found = found.join(bucket_totals(docs, "s"), "bucket", "left").join(bucket_totals(target, "t"), "bucket", "left").fillna(0)
    # one row a bucket, so the sums of all come with each
    both = found.crossJoin(F.broadcast(found.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS).cast("double")
    rows = both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")).toArrow()
    gains = np.zeros(BUCKETS, np.int64)
    gains[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return gains


def score_documents(spilled: DataFrame, gains: np.ndarray) -> DataFrame:
    """The spilled documents with ``weight`` instead of their counts."""
    kept = [c for c in spilled.columns if c not in ("buckets", "counts", "weight")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts, row = _unpacked(batch)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, row, gains[buckets] * counts)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(weight)], names=[*kept, "weight"])

    schema = T.StructType([*spilled.select(*kept).schema.fields, T.StructField("weight", T.LongType())])
    return spilled.select(*kept, "buckets", "counts").mapInArrow(task, schema)


def ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank`` for the drawn ones.

    Rows are dealt to ranges of the order and ranked in their range; the ranges'
    sizes, one row each, tell where each begins.
    """
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = scored.withColumn("fit", F.col("n_words") >= least_words)
    dealt = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = common.stage_table(dealt, "resample-ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"), F.count_if("fit").alias("fits")).collect()
    before, begins = 0, {}
    for r in sorted(sizes, key=lambda r: r["range"]):
        begins[r["range"]] = before
        before += r["n"]
    drawn = share * sum(r["fits"] for r in sizes) // 100
    offsets = scored.sparkSession.createDataFrame(list(begins.items()), "range int, begins long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("begins")
    out = dealt.join(F.broadcast(offsets), "range").withColumn("rank", place.cast("long"))
    return out.withColumn("rank", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank"))).drop("range", "begins", "fit")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id,
    text)``, drawn towards the texts of ``target(text)``.

    ``share`` percent of the documents with ``least_words`` words or more are
    drawn, by the highest score, ties to the smaller ``doc_id``; rows that tie
    in that too are ranked in any order.  A null or empty text, or one without
    words, has no features, weight 0 and no rank, in either table.  A row
    without an id draws its noise as the empty id and comes last of ties.
    Repeated rows get equal weights and scores and ranks of their own.  Texts
    are counted whole, long ones in pieces.  Empty tables give no rows or, of
    targets, gains from the corpus alone.  Other columns are ignored.
    """
    spilled = spill_counts(docs.select("doc_id", "text"))
    aim = spill_counts(target.select("text"))
    scored = score_documents(spilled, bucket_gains(spilled, aim))
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(noise, 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return ranked(scored.withColumn("score", score), share, least_words).select("doc_id", "n_features", "weight", "score", "rank")
