"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are told apart only through the first ``length`` bytes, by passes over
digits from the most significant on; a suffix alone in its group leaves the
sort, and groups left after the last digit are the repeated windows.

* Suffixes are sorted at anchors only.  The anchor of a window of ``length``
  bytes is the least hashed ``DIGIT``-byte string in it (the leftmost of ties),
  so equal windows have equal anchors at equal offsets, and each window has
  one.  An anchor carries the run of windows that it is the anchor of.
* First digit: the anchor's ``DIGIT`` bytes.  Anchors alone in it are done.
* Second digit: all bytes that the anchor's run of windows covers.  A group of
  two or more means that every window of the run is repeated.
* Last digit, for anchors alone after the second whose first digit also leads
  elsewhere: the windows one by one, against one member of each other group.

Digits are compared by 64-bit hashes, two of them for every decision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .grouped import sorted_groups

DIGIT = 128
#: Windows of a text are taken in pieces of so many.
PIECE = 1 << 22
#: Passages with more occurrences than ``HOT_ROWS`` are told by broadcast while
#: they are at most ``HOT_GROUPS``; beyond that both sides are shuffled.
HOT_ROWS, HOT_GROUPS = 10_000, 500_000
_MASK = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240103).integers(1, 2**64, 256, np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
ANCHOR_SCHEMA = "doc long, mark long, first long, second long, low int, high int"
SPAN = "array<struct<low:int,high:int>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: bytes) -> np.ndarray:
    """Sums from which the hash of any substring follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * _powers(len(data))[0], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and second digits of the anchors of ``data``, and the first and
    last start of the windows that each is the anchor of."""
    parts = []
    for begin in range(0, len(data) - length + 1, PIECE):
        piece = data[begin : begin + PIECE + length - 1]
        width, count = length - DIGIT + 1, len(piece) - length + 1
        sums = prefix_sums(piece)
        n = len(piece) - DIGIT + 1
        grams = _mix((sums[DIGIT:] - sums[:-DIGIT]) * _powers(len(sums))[1][:n])
        value = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        value[:n] = (grams & ~_MASK) | np.arange(n, dtype=np.uint64)
        blocks = value.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
        low = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        high = np.append(low[1:], count) - 1
        at = (least[low] & _MASK).astype(np.int64)
        shape = ((at - low) << 32 | (high - low)).astype(np.uint64)
        second = _mix(hashes(sums, low, high + length) + _mix(shape))
        parts.append((grams[at], second, low + begin, high + begin))
    return tuple(np.concatenate(x) for x in zip(*parts))


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts, parts = [], [], []
            for k, text in enumerate(batch["text"]):
                data = text.as_py().encode()
                if len(data) >= length:
                    parts.append(anchors(data, length))
                    rows.append(k)
                    counts.append(len(parts[-1][0]))
            if parts:
                at = np.repeat(rows, counts)
                first, second, low, high = (np.concatenate(x) for x in zip(*parts))
                arrays = [batch[c].to_numpy()[at] for c in ("doc", "mark")] + [first.view(np.int64), second.view(np.int64)]
                arrays += [low.astype(np.int32), high.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in ANCHOR_SCHEMA.split(", ")])

    return docs.mapInArrow(task, ANCHOR_SCHEMA)


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def window_hashes(data: bytes, length: int) -> np.ndarray:
    sums = prefix_sums(data)
    start = np.arange(len(data) - length + 1)
    return hashes(sums, start, start + length)


def cover(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The covered bytes of ``wanted`` anchors, cut from the texts."""
    per_doc = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "alone", "large", "low", "end")).alias("anchors"))
    per_doc = common.stage_table(per_doc, "repeats-wanted")
    out = "doc long, mark long, first long, alone boolean, large boolean, low int, cover binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c.split()[0]: [] for c in out.split(", ")}
            docs_, marks = batch["doc"].to_pylist(), batch["mark"].to_pylist()
            for k, (text, wants) in enumerate(zip(batch["text"], batch["anchors"])):
                data = text.as_py().encode()
                for want in wants.as_py():
                    rows["doc"].append(docs_[k])
                    rows["mark"].append(marks[k])
                    for c in ("first", "alone", "large", "low"):
                        rows[c].append(want[c])
                    rows["cover"].append(data[want["low"] : want["end"]])
            if rows["doc"]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), kinds)], names=list(rows))

    # rows alike in id and text have equal spans: one of them is enough
    return docs.join(per_doc, ["doc", "mark"]).mapInArrow(task, out)


def single_windows(covers: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows of lone anchors, in groups of a first
    digit small enough for a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["first"]):
            members = {}
            for k, key in enumerate(zip(group["doc"], group["mark"], group["low"])):
                members.setdefault(key, k)
            order = list(members.values())
            found = [window_hashes(group["cover"][k], length) for k in order]
            _, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            again, at, out = counts[inverse] > 1, 0, []
            for k, own in zip(order, found):
                if group["alone"][k]:
                    for a, b in zip(*runs(again[at : at + len(own)])):
                        out.append((group["doc"][k], group["mark"][k], group["low"][k] + a, group["low"][k] + b - 1 + length))
                at += len(own)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["doc", "mark", "low", "high"])

    dealt = covers.filter("NOT large").repartition("first").sortWithinPartitions("first")
    return dealt.mapInArrow(task, "doc long, mark long, low int, high int")


def many_windows(covers: DataFrame, length: int) -> DataFrame:
    """The same for first digits with very many groups: the windows' hashes
    meet in a shuffle of their own."""
    out = "doc long, mark long, first long, alone boolean, at int, window long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
            for k in range(batch.num_rows):
                found = window_hashes(columns["cover"][k], length)
                n = len(found)
                fixed = [pa.array(np.full(n, columns[c][k])) for c in ("doc", "mark", "first", "alone")]
                start = pa.array((columns["low"][k] + np.arange(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*fixed, start, pa.array(found.view(np.int64))], names=[c.split()[0] for c in out.split(", ")])

    windows = covers.filter("large").mapInArrow(task, out).distinct()
    again = windows.groupBy("first", "window").count().filter("count > 1").drop("count")
    hit = windows.filter("alone").join(again, ["first", "window"])
    return hit.select("doc", "mark", F.col("at").alias("low"), (F.col("at") + length).cast("int").alias("high"))


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key of their row: the id and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(common.NULL_KEY)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text")
    )


def repeated_spans(docs: DataFrame, length: int = 400, group_limit: int = 20_000) -> DataFrame:
    """``(doc, mark, spans)`` of every text with a byte in a string of
    ``length`` bytes that starts anywhere else too; spans may overlap.

    ``docs`` is from ``keyed``.  First digits with more than ``group_limit``
    groups take the shuffled path of ``many_windows``; both paths are exact.
    """
    if length < 2 * DIGIT:
        raise ValueError(f"length must be at least {2 * DIGIT} bytes")
    found = common.stage_table(find_anchors(docs, length), "repeats-anchors")
    shared = (
        found.groupBy("first")
        .agg(F.count("*").alias("n"), F.min("second").alias("least"), F.max("second").alias("most"))
        .filter("n > 1")
        .select("first", (F.col("least") != F.col("most")).alias("split"))
    )
    # staged, so that the join reads two shuffles and a hot digit can be split
    shared = common.stage_table(shared, "repeats-shared")
    left = common.stage_table(found.join(shared, "first"), "repeats-left")
    common.drop_staged(found)
    mixed = left.filter("split")
    groups = common.stage_table(
        mixed.groupBy("first", "second").agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "low", "high")).alias("one")), "repeats-groups"
    )
    end = (F.col("high") + length).cast("int")
    whole = left.filter("NOT split").select("doc", "mark", "low", end.alias("high"))
    # members of a hot passage are found by broadcast and are never shuffled
    hot = common.broadcast_within(groups.filter(F.col("n") > HOT_ROWS).select("first", "second"), HOT_GROUPS)
    others = groups.filter(F.col("n").between(2, HOT_ROWS)).select("first", "second")
    for members in (mixed.join(hot, ["first", "second"], "left_semi"), mixed.join(hot, ["first", "second"], "left_anti").join(others, ["first", "second"])):
        whole = whole.unionByName(members.select("doc", "mark", "low", end.alias("high")))
    open_keys = groups.groupBy("first").agg(F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("lone")).filter("lone > 0")
    wanted = groups.join(open_keys, "first").select(
        "one.*", "first", (F.col("n") == 1).alias("alone"), (F.col("size") > group_limit).alias("large")
    )
    covers = common.stage_table(cover(docs, wanted.select("doc", "mark", "first", "alone", "large", "low", end.alias("end"))), "repeats-covers")
    spans = whole.unionByName(single_windows(covers, length))
    if covers.filter("large").limit(1).count():
        spans = spans.unionByName(many_windows(covers, length))
    gathered = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    return common.stage_table(gathered.select("doc", "mark", F.col("spans").cast(SPAN).alias("spans")), "repeats-spans")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.join(spans, ["doc", "mark"], "left")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal runs."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for low, high in spans:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, length: int = 400, group_limit: int = 20_000) -> DataFrame:
    """Remove every byte in a string of ``length`` bytes that also starts
    anywhere else, in the same text or another.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  Strings are
    judged on the input, as UTF-8, and never cross texts.  Returns one row per
    input row: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs),
    ``kept_sha256``, ``kept`` (the remaining bytes) and ``spans``.  A null text
    counts as empty; texts shorter than ``length`` keep all.  A repeated row is
    a copy like any other.  An empty table gives an empty result.
    """
    common.session(docs)
    rows = keyed(docs)
    out = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary,"
        " spans array<struct<low:long,high:long>>"
    )
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns: list[list] = [[] for _ in range(7)]
            for key, text, spans in zip(batch["doc"].to_pylist(), batch["text"], batch["spans"]):
                data, found = text.as_py().encode(), merged(spans.as_py())
                kept = cut(data, found)
                row = (None if key == common.NULL_KEY else key, len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(columns, (*row, [{"low": a, "high": b} for a, b in found])):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            )

    return with_spans(rows, repeated_spans(rows, length, group_limit)).mapInArrow(task, out)



def cut_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut by ``spans`` (from ``with_spans``).  Bytes of
    a character that a cut split go with it; a null text stays null."""
    schema = docs.drop("spans").schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch["text"], batch["spans"]):
                text, found = text.as_py(), merged(spans.as_py())
                texts.append(cut(text.encode(), found).decode("utf-8", "ignore") if found else text)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch[f.name] for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*schema.names, "spans").mapInArrow(task, schema)
