"""Groups from Arrow batches that Spark has sorted by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows with equal ``keys``; holds one group
    and one batch at a time."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= columns[k][1:] != columns[k][:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            key = tuple(columns[k][begin] for k in keys)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append({c: x[begin:end] for c, x in columns.items()})
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
