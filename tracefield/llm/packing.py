"""Order-preserving packing of documents into fixed windows.

Documents are range-partitioned by id and each task packs its ids in order,
segment by segment.  Within a segment, dynamic programming chooses the cuts:
a window may end at a document's end for nothing, at a sentence's end for a
small penalty, and in a sentence, at fixed steps, for a larger one.  The cost
of a window is its padding; a window that is a power of two long has none.
``cost(i, j) = best[i] + position[i] + window - position[j]`` has its minimum
over the last ``window`` tokens at the head of a monotone queue, so the
transitions take constant time each.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " sequence_tokens long"
)
#: Vocabulary entries that close a sentence.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>", "...</w>", "!!</w>", ".", "!", "?")


def exact_powers(positions: list[int], powers: list[int]) -> dict[int, list[int]]:
    """Per index, the indexes that lie one of ``powers`` before it."""
    x = np.asarray(positions)
    out: dict[int, list[int]] = {}
    for length in powers:
        at = np.searchsorted(x, x - length)
        found = np.flatnonzero(x[at] == x - length)
        for j, k in zip(found.tolist(), at[found].tolist()):
            out.setdefault(j, []).append(k)
    return out


def choose_cuts(positions: list[int], penalties: list[float], window: int, least_power: int = 256) -> list[int]:
    """Indexes into ``positions`` (increasing, from 0 to the end) at which the
    cheapest windows end.  Neighbours must be at most ``window`` apart."""
    hits = exact_powers(positions, [1 << k for k in range(window.bit_length() - 1, -1, -1) if least_power <= 1 << k < window])
    n = len(positions)
    key, best, back = [0.0] * n, [0.0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - p
        if j in hits:
            for k in hits[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        best[j] = cost = cost + penalties[j]
        back[j] = i
        key[j] = cost = cost + p
        while queue and key[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, sentence: float, inside: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with their penalties."""
    end = len(ids)
    penalty = np.full(end + 1, np.inf, np.float32)
    penalty[step:end:step] = inside
    tail = max(0, end - 4 * step)
    penalty[end - 16 * ((end - tail) // 16) : end : 16] = inside
    stops = np.flatnonzero(closes[ids]) + 1
    if len(stops):
        # one candidate per eight tokens is as many as matter
        stops = stops[np.concatenate([[True], (stops[1:] >> 3) != (stops[:-1] >> 3)])]
    penalty[stops] = sentence
    penalty[doc_ends] = 0
    penalty[0] = 0
    found = np.flatnonzero(penalty != np.inf)
    return found, penalty[found]


def pack_segment(data: bytes, doc_sizes: list[int], closes: np.ndarray, window: int, sentence: float, inside: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of a segment: index of the document, start in it, length,
    sequence, offset in the sequence; then the sequence's length."""
    ids = np.frombuffer(data, "<u4")
    doc_ends = np.cumsum(doc_sizes)
    positions, penalties = candidates(ids, doc_ends, closes, sentence, inside, window // 16)
    cuts = positions[choose_cuts(positions.tolist(), penalties.tolist(), window)]
    ends = np.union1d(cuts, doc_ends)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, starts, "right")
    seq = np.searchsorted(cuts, starts, "right")
    doc_start = np.concatenate([[0], doc_ends[:-1]])[doc]
    seq_start = np.concatenate([[0], cuts[:-1]])[seq]
    yield from zip(
        doc.tolist(), (starts - doc_start).tolist(), (ends - starts).tolist(), seq.tolist(),
        (starts - seq_start).tolist(), (cuts[seq] - seq_start).tolist(), starts.tolist(),
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 4096,
    end_id: int = 2,
    segment_tokens: int = 1 << 19,
    sentence_penalty: float = 4.0,
    inside_penalty: float = 32.0,
) -> DataFrame:
    """Pack all documents, in ascending ``doc_id``, into windows.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  A document is
    its ids and ``end_id``; a null or empty text is the end id alone.  Returns
    one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens``.  Each id lies in exactly one piece
    and offsets are gapless.  Rows that repeat an id, or have none, are packed
    one after the other as documents of their own.  A task holds the ids of
    one segment: whole documents up to ``segment_tokens``, or one longer
    document.  An empty table gives no pieces.
    """
    common.session(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        closes = np.zeros(len(encoder.ends), bool)
        closes[encoder.ids_of(SENTENCE_ENDS)] = True
        last = np.array([end_id], "<u4").tobytes()
        base = (TaskContext.get().partitionId() + 1) << 40
        held, keys = [], []
        size = used = 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            data, sizes = b"".join(held), [len(x) // 4 for x in held]
            view, rows, top = memoryview(data), [], 0
            for d, start, length, seq, offset, whole, at in pack_segment(data, sizes, closes, window, sentence_penalty, inside_penalty):
                crc = zlib.crc32(view[4 * at : 4 * (at + length)])
                rows.append((keys[d], start, length, crc, sizes[d], base + used + seq, offset, whole))
                top = seq
            used += top + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")]
            )

        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                held.append(encoder.encode(text.as_py()) + last)
                keys.append(key)
                size += len(held[-1]) // 4
                if size >= segment_tokens:
                    yield flush()
                    held, keys, size = [], [], 0
        if held:
            yield flush()
        encoder.forget()

    ordered = common.in_order(docs)
    return ordered.mapInArrow(task, SCHEMA)


def padding(pieces: DataFrame, window: int = 4096) -> DataFrame:
    """Tokens, sequences and padded tokens of a packing."""
    length = F.first("sequence_tokens")
    power = F.bit_count(length) == 1
    each = pieces.groupBy("sequence_id").agg(length.alias("n"), F.when(power, 0).otherwise(window - length).alias("pad"))
    return each.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum("pad").alias("padded"))
