"""Audit of how quality filters interact, in every order they can be applied.

Texts are routed by fingerprint: a task keeps one entry per different text it
meets, an RDD sends the entries to the partition of their xxhash, and there a
chain of full texts per fingerprint tells equal texts from colliding ones and
keeps each text's least id.  A row's failed filters are the bits of a mask;
``combineByKey`` merges the vectors that count masks, and all orders follow
from a part's one vector of 96 counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from typing import Any

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "ABCDE"
DUPLICATE = 1 << 4
#: Bytes of text a task holds before it sends its entries on, and bytes that
#: a partition of the routed texts should hold.
HELD_BYTES, ROUTED_BYTES = 8 << 20, 48 << 20
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_mask(text: str) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), len(data.translate(None, _SIGNS)) < len(data))
    return sum(1 << k for k, x in enumerate(failed) if x)


def _entries(rows: Iterable[Any]) -> Iterator[tuple[int, tuple]]:
    """``(fingerprint, (text, least id, rows))`` of a task's texts.  Of a text
    met again only rows with its least id stay open; the others are duplicates
    whatever else there is and go on alone, without the text."""
    held: dict[str, list] = {}
    size = 0

    def out() -> Iterator[tuple[int, tuple]]:
        for text, (least, open_rows) in held.items():
            yield xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")), (text, least, open_rows)

    for r in rows:
        text = r["text"] or ""
        row = (r["doc_id"], r["lang"] or "", text_mask(text))
        found = held.get(text)
        if r["doc_id"] is None:
            yield _spread(row), (None, None, [row])
        elif found is None:
            held[text] = [r["doc_id"], [row]]
            size += len(text) + 200
        else:
            for late in _meet(found, r["doc_id"], [row]):
                yield _spread(late), (None, None, [late])
        if size > HELD_BYTES:
            yield from out()
            held, size = {}, 0
    yield from out()


def _spread(row: tuple) -> int:
    """A key that deals rows without an open question evenly."""
    return xxhash.xxh3_64_intdigest(repr(row))


def _meet(found: list, least: int, rows: list[tuple]) -> list[tuple]:
    """Add a text's ``rows`` of id ``least`` to the entry ``found``; the rows
    that are duplicates now, marked as such."""
    if least == found[0]:
        found[1] += rows
        return []
    late = rows
    if least < found[0]:
        late, found[:] = found[1], [least, rows]
    return [(i, part, mask | DUPLICATE) for i, part, mask in late]


def _chains(entries: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """The rows ``(doc_id, part, mask)`` of a partition's entries."""
    chains: dict[int, list[list]] = {}
    for key, (text, least, rows) in entries:
        if text is None:
            yield from rows
            continue
        chain = chains.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                yield from _meet(link[1], least, rows)
                break
        else:
            chain.append([text, [least, rows]])
    for chain in chains.values():
        for _, (_, rows) in chain:
            yield from rows


def failed_masks(docs: DataFrame) -> RDD:
    """``(doc_id, part, mask)`` of every row, the bit of E included."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(docs.sparkSession.sparkContext.defaultParallelism, size // ROUTED_BYTES + 1)
    return rows.rdd.mapPartitions(_entries).partitionBy(partitions, lambda key: key).mapPartitions(_chains)


def _vector(row: Any) -> np.ndarray:
    return _count(np.zeros((3, 32), np.int64), row)


def _count(vector: np.ndarray, row: Any) -> np.ndarray:
    mask, good, toxic = row
    vector[0, mask] += 1
    vector[1, mask] += good
    vector[2, mask] += toxic
    return vector


def order_rows(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """A part's rows from its counts of masks (all, good, toxic)."""
    masks = np.arange(32)
    rows, shapley = [], dict.fromkeys(LETTERS, 0)
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, gone = (masks & bit) != 0, (masks & before) != 0
            here = fails & ~gone
            before |= bit
            removed, good, toxic = (int(x) for x in vector[:, here].sum(axis=1))
            kept = int(vector[0, (masks & before) == 0].sum())
            shapley[letter] += removed
            rows.append(("".join(order), step, letter, kept, removed, int(vector[0, fails & gone].sum()), int(vector[0, bit]), good, toxic))
    for name, step, letter, *counts in rows:
        yield (part, name, step, *counts, shapley[letter])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs(doc_id, text, lang)`` with ``labels(doc_id, quality,
    toxic)``: 600 rows per part (the value of ``lang``).

    A null text is empty, a null ``lang`` is the part of the empty string.  An
    empty or any other repeated text fails E in all rows but those of its
    least id; rows that repeat an id and its text are all counted and none is
    the other's duplicate, and a row without an id never fails E and makes no
    other fail.  A document is good or toxic if any label of its id says so;
    labels of unknown or null ids, or with nulls, say nothing.  A text is
    judged whole, however long.  Without documents there are no parts and no
    rows.  Columns by other names are ignored.
    """
    spark = common.session(docs)
    masks = common.stage_table(spark.createDataFrame(failed_masks(docs), "doc_id long, part string, mask int"), "audit-masks")
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.groupBy("doc_id").agg(says("quality"), says("toxic"))
    rows = masks.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").select("part", "mask", "quality", "toxic")
    rows = rows.unionByName(masks.filter("doc_id IS NULL").select("part", "mask"), allowMissingColumns=True).fillna(0, ["quality", "toxic"])
    pairs = rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3])))
    vectors = pairs.combineByKey(_vector, _count, lambda a, b: a + b)
    return spark.createDataFrame(vectors.flatMap(lambda x: order_rows(*x)), SCHEMA)


ORACLE = r"""
WITH f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM f),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (least < doc_id)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a JOIN x b ON b.letter != a.letter JOIN x c ON c.letter NOT IN (a.letter, b.letter) JOIN x d ON d.letter NOT IN (a.letter, b.letter, c.letter)
  JOIN x e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM o, range(1, 6) r(step)),
t AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS removed,
  sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM t
"""
