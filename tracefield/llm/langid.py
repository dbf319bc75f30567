"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to order three with escape
probabilities (method C): a symbol seen ``c`` times in a context that saw
``t`` symbols, ``d`` of them distinct, has probability ``c / (t + d)``; an
unseen one escapes with ``d / (t + d)`` to the next shorter context, and below
order zero all bytes are alike.  Statistics are frozen after training, so a
text's code length in every language is exact and is looked up byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
_PAD = b"\n\n\n"
COUNT_SCHEMA = "lang string, gram long, n long"
PREDICTION_SCHEMA = "lang_pred string, score double, bits_per_byte double"
#: Bytes scored at a time, however long a text is.
SLICE = 1 << 18


def to_bytes(text: str) -> bytes:
    return text.lower().encode()


def gram_codes(data: bytes) -> np.ndarray:
    """Every symbol of ``data`` with its 0 to 3 preceding bytes, as order and
    packed bytes."""
    x = np.frombuffer(_PAD + data, np.uint8).astype(np.int64)
    one = x[3:]
    two = x[2:-1] << 8 | one
    three = x[1:-2] << 16 | two
    four = x[:-3] << 24 | three
    return np.concatenate([(k << 32) | g for k, g in enumerate((one, two, three, four))])


def count_grams(sample: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over ``sample(lang, text)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                texts.setdefault(lang, []).append(to_bytes(text.as_py()))
            for lang, found in texts.items():
                grams, counts = np.unique(np.concatenate([gram_codes(x) for x in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.mapInArrow(task, COUNT_SCHEMA).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen code lengths in bits; the last axis of each table is the
    language.  Row 0 of a table stands for what training never saw."""

    languages: list[str]
    order1: np.ndarray
    pairs: np.ndarray
    escape2: np.ndarray
    triples: np.ndarray
    order2: np.ndarray
    contexts: np.ndarray
    escape3: np.ndarray
    symbols: np.ndarray
    quads: np.ndarray
    order3: np.ndarray

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[bytes] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            # a piece comes with the three bytes before it
            for at in range(0, len(text), SLICE):
                held.append(text[at - 3 : at + SLICE] if at else _PAD + text[:SLICE])
                owners.append(k)
                size += len(held[-1])
                if size >= SLICE:
                    self._add(out, held, owners)
                    held, owners, size = [], [], 0
        if held:
            self._add(out, held, owners)
        return out

    def _add(self, out: np.ndarray, pieces: list[bytes], owners: list[int]) -> None:
        x = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) - 3 for p in pieces])
        edge = np.cumsum(sizes) - sizes
        at = np.arange(len(x) - 3 * len(pieces)) + np.repeat(np.arange(3, 3 * len(pieces) + 3, 3), sizes)
        np.add.at(out, owners, np.add.reduceat(self._bits(x, at), edge, axis=0, dtype=np.float64))

    def _bits(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        a, b, c, d = (x[at - k].astype(np.int32) for k in (3, 2, 1, 0))
        context = self.contexts[self.triples[self.pairs[a << 8 | b], c]]
        quad = self.quads[context, self.symbols[d]]
        bits = self.order3[quad]
        miss = np.flatnonzero(quad == 0)
        if len(miss):
            pair = self.pairs[b[miss] << 8 | c[miss]]
            triple = self.triples[pair, d[miss]]
            lower = self.order2[triple]
            none = np.flatnonzero(triple == 0)
            lower[none] = self.escape2[pair[none]] + self.order1[c[miss[none]], d[miss[none]]]
            bits[miss] = self.escape3[context[miss]] + lower
        return bits


def _tables(n: int, groups: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths of seen symbols (inf if unseen) and of escapes per group,
    for counts of shape (symbols, languages) in ``groups``."""
    total, distinct = np.zeros((size, n)), np.zeros((size, n))
    np.add.at(total, groups, counts)
    np.add.at(distinct, groups, counts > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = -np.log2(counts / (total + distinct)[groups])
        escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
    return np.where(counts > 0, seen, np.inf), escape


def build_model(rows: pa.Table) -> Model:
    """The frozen model of gram counts."""
    languages = sorted(set(rows["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    size = len(languages)

    def order(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = gram >> 32 == k
        codes, at = np.unique(gram[own] & 0xFFFFFFFF, return_inverse=True)
        counts = np.zeros((len(codes), size))
        counts[at, lang[own]] = n[own]
        return codes, counts

    codes, counts = order(0)
    seen, escape = _tables(size, np.zeros(len(codes), np.int64), counts, 1)
    order0 = np.tile(escape + 8, (256, 1))
    order0[codes] = np.where(np.isinf(seen), order0[codes], seen)
    codes, counts = order(1)
    seen, escape = _tables(size, codes >> 8, counts, 256)
    order1 = escape[:, None, :] + order0[None, :, :]
    first, symbol = codes >> 8, codes & 255
    order1[first, symbol] = np.where(np.isinf(seen), order1[first, symbol], seen)
    codes, counts = order(2)
    heads, group = np.unique(codes >> 8, return_inverse=True)
    pairs = np.zeros(1 << 16, np.int32)
    pairs[heads] = np.arange(1, len(heads) + 1)
    seen, escape = _tables(size, group + 1, counts, len(heads) + 1)
    triples = np.zeros((len(heads) + 1, 256), np.int32)
    triples[group + 1, codes & 255] = np.arange(1, len(codes) + 1)
    lower = escape[group + 1] + order1[codes >> 8 & 255, codes & 255]
    order2 = np.concatenate([np.zeros((1, size)), np.where(np.isinf(seen), lower, seen)])
    escape2 = escape
    codes, counts = order(3)
    heads, group = np.unique(codes >> 8, return_inverse=True)
    contexts = np.zeros(len(order2), np.int32)
    contexts[triples[pairs[heads >> 8], heads & 255]] = np.arange(1, len(heads) + 1)
    seen, escape3 = _tables(size, group + 1, counts, len(heads) + 1)
    # the widest table has columns for the symbols seen only
    symbols = np.zeros(256, np.int32)
    seen_symbols = np.unique(codes & 255)
    symbols[seen_symbols] = np.arange(1, len(seen_symbols) + 1)
    quads = np.zeros((len(heads) + 1, len(seen_symbols) + 1), np.int32)
    quads[group + 1, symbols[codes & 255]] = np.arange(1, len(codes) + 1)
    tail = triples[pairs[codes >> 8 & 0xFFFF], codes & 255]
    lower = escape3[group + 1] + order2[tail]
    order3 = np.concatenate([np.zeros((1, size)), np.where(np.isinf(seen), lower, seen)])
    # a pad at a text's start is a context but never a symbol: row 0 then
    contexts[0] = 0
    small = lambda x: x.astype(np.float32)
    return Model(languages, small(order1), pairs, small(escape2), triples, small(order2), contexts, small(escape3), symbols, quads, small(order3))


def sample_rows(labelled: DataFrame, rows_per_language: int, bytes_per_language: int) -> DataFrame:
    """``(lang, text)`` of whole rows with text and language: per language the
    first by a hash of text and, where there is one, id, up to both bounds but
    at least one.  Rows alike in both count as one.  Only hashes and lengths
    are ranked, and Spark cuts the ranks per task before it shuffles them."""
    ids = [c for c in ("doc_id",) if c in labelled.columns]
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    known = known.select("lang", "text", F.xxhash64("text", *ids).alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw")
    ranked = known.select("lang", "draw", F.octet_length("text").alias("size")).withColumn("rank", F.row_number().over(order))
    first = ranked.filter(F.col("rank") <= rows_per_language)
    fits = (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= bytes_per_language) | (F.col("rank") == 1)
    last = first.withColumn("fits", fits).filter("fits").groupBy("lang").agg(F.max("draw").alias("last"))
    last = {r["lang"]: r["last"] for r in last.collect()}
    if not last:
        return known.select("lang", "text").limit(0)
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(last.items()) for x in pair]), F.col("lang"))
    return known.filter(F.col("draw") <= bound).dropDuplicates(["lang", "draw"]).select("lang", "text")


def train(labelled: DataFrame, rows_per_language: int = 600, bytes_per_language: int = 32 << 20) -> Model | None:
    """Learn a model from ``labelled(text, lang)``.

    The model is fitted on a sample of whole texts: of each language all its
    rows up to ``rows_per_language`` or ``bytes_per_language``, and at least
    one, drawn by a hash of text and ``doc_id`` (see ``sample_rows``).  All
    strings of the sample count.  Rows without text or language are ignored;
    repeated rows are drawn like others.  The counts that come to the driver
    are bounded by the sample.  None if nothing can be learned.
    """
    common.session(labelled)
    sample = common.stage_table(sample_rows(labelled, rows_per_language, bytes_per_language), "langid-sample")
    rows = count_grams(sample).toArrow()
    common.drop_staged(sample)
    return build_model(rows) if rows.num_rows else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred, score, bits_per_byte`` behind its columns.

    ``docs`` needs ``text``.  Only the text is used, all of it.  The score is
    the posterior probability of the language of the least code length, all
    being equally likely beforehand.  A text that is null or has no letter, or
    any text when nothing was learned, is ``und`` with score 0.  Ties go to
    the first language by code point; repeated rows get equal results; long
    texts are scored in pieces, all of them.  An empty table gives an empty
    result.  Columns of ``docs`` by the names added
    here are replaced.
    """
    spark = common.session(docs)
    added = [c.split()[0] for c in PREDICTION_SCHEMA.split(", ")]
    kept = docs.drop(*added)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            langs, scores, rates = [UNKNOWN] * n, np.zeros(n), [None] * n
            texts = [(k, to_bytes(t)) for k, t in enumerate(x.as_py() for x in batch["text"]) if t and any(map(str.isalpha, t))]
            if model and texts:
                bits = model.code_lengths([t for _, t in texts])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                posterior = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
                for (k, text), b, p, x in zip(texts, best, posterior, least):
                    langs[k], scores[k], rates[k] = model.languages[b], p, x / len(text)
            extra = [pa.array(langs, pa.string()), pa.array(scores), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(PREDICTION_SCHEMA).fields])
    return kept.mapInArrow(task, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
