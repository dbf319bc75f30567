"""A hidden Markov language model of words.

Symbols are the most frequent words, and for all other words a class by their
last bytes; a class's words share it in proportion to their counts.  Latent
states are trained by Baum-Welch: tasks run forward-backward over their
documents and Spark adds up the expected counts.  A text's probability is that
of the scaled forward recursion over all its tokens.

Counts are of all training documents.  Words of a bounded lexicon are told by
broadcast, all others by a join on the word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

END = b""
_OTHER = (1 << 31) - 1
#: A task counts so many different words before it sends them on, and runs the
#: recursions over so many tokens at a time.
HELD_WORDS, TOKENS = 500_000, 1 << 20
#: Tokens that scoring takes at a time, so that few long documents go with many.
SCORED = 1 << 21
#: Training cuts documents into sequences of so many tokens; scoring does not.
SEQUENCE = 256
#: Frequent symbols whose neighbourhood tells how states begin.
CONTEXT = 16


@dataclass(frozen=True)
class Settings:
    """``words`` frequent words are symbols of their own and ``lexicon`` words
    are told by broadcast, at most; ``classes`` by endings hold the rest."""

    states: int = 8
    rounds: int = 3
    words: int = 1 << 14
    lexicon: int = 1 << 18
    classes: int = 1 << 10
    weight: float = 500.0


@dataclass
class Vocabulary:
    """What the counts of the training tokens tell: ``tokens`` of ``types``
    different words, the lexicon's counts, and shares of the symbols."""

    tokens: int
    types: int
    settings: Settings
    counts: dict[bytes, int] = field(default_factory=dict)
    symbols: dict[bytes, int] = field(default_factory=dict)
    base: np.ndarray = None
    #: Words of this band of counts and above are in the lexicon.
    band: int = 1 << 30

    @property
    def size(self) -> int:
        return len(self.symbols) + self.settings.classes

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def symbol(self, word: bytes) -> int:
        found = self.symbols.get(word)
        return len(self.symbols) + zlib.crc32(word[-3:]) % self.settings.classes if found is None else found


@dataclass
class Model:
    """Frozen tables.  ``unknown`` is the probability of any word that training
    never saw, in every state."""

    first: np.ndarray
    inner: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    unknown: float


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of all tokens of ``texts(text)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(tokens(text.as_py()))
                if len(found) > HELD_WORDS:
                    yield _word_rows(found)
                    found = Counter()
        yield _word_rows(found)

    return texts.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_rows(found: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])


def _band() -> Column:
    return F.floor(F.log2("n") * 64).cast("int")


def learn_vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """The bounded part of ``counts(word, n)``.

    Which counts are frequent enough is read off a histogram of their
    logarithms in 64ths, so no more words than ``settings`` says are sent to
    the driver and none is ranked.
    """
    band = _band()
    histogram = counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    out = Vocabulary(sum(r["n"] for r in histogram), sum(r["words"] for r in histogram), settings)
    if not out.tokens:
        return out

    def least(most: int) -> int:
        held, lowest = 0, 1 << 30
        for r in sorted(histogram, key=lambda r: -r["band"]):
            held += r["words"]
            if held > most:
                break
            lowest = r["band"]
        return lowest

    out.band = least(settings.lexicon)
    told = counts.filter((band >= out.band) | (F.col("word") == END)).withColumn("own", (band >= least(settings.words)) | (F.col("word") == END))
    rows = told.toArrow()
    words, n, own = rows["word"].to_pylist(), rows["n"].to_pylist(), rows["own"].to_pylist()
    out.counts = dict(zip(words, n))
    frequent = sorted((-c, w) for w, c, o in zip(words, n, own) if o)
    out.symbols = {w: k for k, (_, w) in enumerate(frequent)}
    rest = counts.filter((band < least(settings.words)) & (F.col("word") != END))
    ending = F.crc32(F.substring("word", -3, 3)) % settings.classes
    classes = rest.groupBy(ending.alias("class")).agg(F.sum(F.col("n") + 0.5).alias("mass")).toArrow()
    mass = np.zeros(out.size)
    mass[: len(frequent)] = [0.5 - c for c, _ in frequent]
    mass[len(frequent) + classes["class"].to_numpy()] = classes["mass"].to_numpy()
    out.base = mass / out.total
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` without ``text``, as a table with a ``row`` number, the numbers
    of its ``symbols``, and the counts of its words in the lexicon.

    Words outside the lexicon are listed once in ``others``; their tokens are
    numbered from -1 down."""
    common.session(docs)
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        number = {w: k for k, w in enumerate(vocabulary.counts)}
        for batch in batches:
            coded, others = [], []
            for text in batch["text"]:
                rare: dict[bytes, int] = {}
                words = tokens(text.as_py())
                found = np.fromiter(map(number.get, words, repeat(_OTHER)), "<i4", len(words))
                for k in np.flatnonzero(found == _OTHER).tolist():
                    found[k] = rare.setdefault(words[k], -1 - len(rare))
                coded.append(found.tobytes())
                others.append(list(rare))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(coded, pa.binary()), pa.array(others, pa.list_(pa.binary()))], names=[*kept, "coded", "others"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields] + ["coded binary", "others array<binary>"])
    rows = docs.select(*kept, "text").mapInArrow(task, schema).withColumn("row", F.monotonically_increasing_id())
    return common.stage_table(rows, "hmm-coded")


class Coder:
    """Symbols and base probabilities of coded tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.symbol = np.array([vocabulary.symbol(w) for w in vocabulary.counts], np.int32)
        self.count = np.array(list(vocabulary.counts.values()), np.float64)
        self.base = np.log((self.count + 0.5) / vocabulary.total)

    def symbols(self, coded: bytes, others: list[bytes]) -> np.ndarray:
        return _looked_up(self.symbol, coded, [self.vocabulary.symbol(w) for w in others])

    def logs(self, coded: bytes, others: list[int]) -> np.ndarray:
        """Logarithms of the base probabilities."""
        return _looked_up(self.base, coded, [math.log((n + 0.5) / self.vocabulary.total) for n in others])


def _looked_up(table: np.ndarray, coded: bytes, others: list) -> np.ndarray:
    """Entries of ``table`` by number, those of ``others`` from -1 down."""
    x = np.frombuffer(coded, "<i4")
    rare = x < 0
    if not others:
        return table[x]
    out = np.empty(len(x), table.dtype)
    out[~rare] = table[x[~rare]]
    out[rare] = np.array(others, table.dtype)[-1 - x[rare]]
    return out


def _layers(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from the longest on, as one array by position: its symbols,
    where each position begins, and the order taken."""
    sizes = np.array([len(x) for x in sequences])
    order = np.argsort(-sizes, kind="stable")
    flat, starts = np.concatenate([sequences[k] for k in order]), np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
    at = np.arange(len(flat)) - np.repeat(starts, sizes[order])
    # numbers of 16 bits are sorted by counting
    by = np.argsort(at.astype(np.uint16) if sizes[order[0]] <= 1 << 16 else at, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(at))])
    return flat[by], begins, order


def expected_counts(model: Model, sequences: list[np.ndarray], opens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of ``sequences``, and their log
    likelihood; ``opens`` are those that begin a document."""
    symbols, begins, order = _layers(sequences)
    emit = model.emits[symbols]
    states, layers = emit.shape[1], len(begins) - 1
    alpha, scale = np.empty_like(emit), np.empty(len(symbols), np.float32)
    opens = opens[order][:, None]
    last = np.where(opens, model.first, model.inner).astype(np.float32)
    ones, back = np.ones(states, np.float32), np.ascontiguousarray(model.moves.T)
    for t in range(layers):
        a, b = begins[t], begins[t + 1]
        now = (last if t == 0 else last[: b - a] @ model.moves) * emit[a:b]
        scale[a:b] = now @ ones
        last = np.divide(now, scale[a:b, None], out=alpha[a:b])
    moves = np.zeros((states, states))
    beta = np.ones((begins[layers] - begins[layers - 1], states), np.float32)
    for t in range(layers - 1, -1, -1):
        a, b = begins[t], begins[t + 1]
        if t < layers - 1:
            c = begins[t + 2]
            ahead = emit[b:c]
            ahead *= beta
            ahead /= scale[b:c, None]
            moves += alpha[a : a + c - b].T @ ahead
            beta = np.ones((b - a, states), np.float32)
            beta[: c - b] = ahead @ back
        alpha[a:b] *= beta  # now the probability of each state
    starts = (alpha[: begins[1]] * opens).sum(axis=0, dtype=np.float64)
    emissions = np.stack([np.bincount(symbols, alpha[:, k], size) for k in range(states)], axis=1)
    return starts, moves * model.moves, emissions, float(np.log(scale, dtype=np.float64).sum())


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of whole sequences of symbols; the number of all
    symbols stands for an unknown word."""
    symbols, begins, order = _layers(sequences)
    emits = np.concatenate([model.emits, np.full((1, model.emits.shape[1]), model.unknown)])
    out, ones = np.zeros(begins[1]), np.ones(emits.shape[1])
    last = None
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        now = (model.first if t == 0 else last[: b - a] @ model.moves) * emits[symbols[a:b]]
        scale = now @ ones
        out[: b - a] += np.log(scale)
        last = now / scale[:, None]
    found = np.empty(len(out))
    found[order] = out
    return found


def _grouped(rows: Iterator[tuple], most: int = TOKENS) -> Iterator[list[tuple]]:
    """Runs of rows whose first parts have ``most`` tokens or one row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sequences(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """Training sequences and whether they open a document, in groups."""

    def cut() -> Iterator[tuple[np.ndarray, bool]]:
        for batch in batches:
            for coded, others in zip(batch["coded"].to_pylist(), batch["others"].to_pylist()):
                x = coder.symbols(coded, others)
                for a in range(0, len(x), SEQUENCE):
                    yield x[a : a + SEQUENCE], a == 0

    return _grouped(cut())


def _summed(coded: DataFrame, task, columns: int) -> dict[str, np.ndarray]:
    """Tables that tasks give as ``{name: matrix}``, added up; a table has at
    most as many rows as there are symbols."""
    names = [f"v{k}" for k in range(columns)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, matrix in task(batches).items():
            at = np.flatnonzero(matrix.any(axis=1))
            values = [pa.array(matrix[at, k].astype(np.float64)) for k in range(columns)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), *values], names=["name", "at", *names])

    found = coded.select("coded", "others").mapInArrow(rows, "name string, at int, " + ", ".join(f"{c} double" for c in names))
    got = found.groupBy("name", "at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    name, at = np.array(got["name"].to_pylist(), object), got["at"].to_numpy()
    values = np.stack([got[c].to_numpy() for c in names], axis=1)
    out = {}
    for x in sorted(set(name)):
        own = name == x
        out[x] = np.zeros((at[own].max() + 1, columns))
        out[x][at[own]] = values[own]
    return out


def first_states(coded: DataFrame, coder: Coder) -> np.ndarray:
    """A state for every symbol to begin with: symbols are grouped by how often
    the most frequent symbols stand before and after them.

    The groups are k-means of those shares, weighted by counts, from seeds that
    are each the farthest from those before."""
    vocabulary, spark = coder.vocabulary, coded.sparkSession
    shared = spark.sparkContext.broadcast(coder)
    size, context = vocabulary.size, min(CONTEXT, vocabulary.size)

    def task(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros(size * 2 * context)
        for group in _sequences(batches, shared.value):
            x = np.concatenate([s for s, _ in group]).astype(np.int64)
            inside = np.ones(len(x), bool)
            inside[np.cumsum([len(s) for s, _ in group]) - 1] = False
            a, b = x[:-1][inside[:-1]], x[1:][inside[:-1]]
            for of, other, shift in ((a, b, 0), (b, a, context)):
                near = other < context
                total += np.bincount(of[near] * 2 * context + other[near] + shift, minlength=len(total))
        return {"near": total.reshape(size, -1)}

    near = _summed(coded, task, 2 * context).get("near", np.zeros((0, 2 * context)))
    near = np.concatenate([near, np.zeros((size - len(near), 2 * context))])
    share = np.sqrt((near + near.sum(axis=0) / max(near.sum(), 1) * 10) / (near.sum(axis=1, keepdims=True) + 10))
    weight = vocabulary.base
    states = vocabulary.settings.states
    centers = share[[int(weight.argmax())]]
    while len(centers) < states:
        far = ((share[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
        centers = np.concatenate([centers, share[[int((far * weight).argmax())]]])
    for _ in range(20):
        own = ((share[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        sums = np.stack([np.bincount(own, weight * share[:, k], states) for k in range(share.shape[1])], axis=1)
        mass = np.bincount(own, weight, states)
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centers)
    return own


def _model(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, vocabulary: Vocabulary) -> Model:
    """Probabilities from counts, smoothed: emissions towards the base."""
    unknown = 0.5 / vocabulary.total
    known = vocabulary.base / vocabulary.base.sum()
    weight = vocabulary.settings.weight
    emits = (emissions.T + weight * known) / (emissions.sum(axis=0)[:, None] + weight) * (1 - unknown)
    states = len(starts)
    share = lambda x: (x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True)
    occupied = emissions.sum(axis=0)
    return Model(share(starts), share(occupied), share(moves), np.ascontiguousarray(emits.T), unknown) if states else None


def _single(model: Model) -> Model:
    small = lambda x: x.astype(np.float32)
    return Model(small(model.first), small(model.inner), small(model.moves), small(model.emits), model.unknown)


def train(coded: DataFrame, vocabulary: Vocabulary) -> tuple[Model, list[float]]:
    """The model after ``rounds`` of Baum-Welch over all of ``coded``, and the
    log likelihood before each round."""
    spark = coded.sparkSession
    settings, size = vocabulary.settings, vocabulary.size
    coder = Coder(vocabulary)
    own = first_states(coded, coder)
    emissions = np.zeros((size, settings.states))
    mass = vocabulary.base * vocabulary.tokens
    emissions[np.arange(size), own] = 0.8 * mass
    emissions += (0.2 * mass / settings.states)[:, None]
    model = _model(np.zeros(settings.states), np.zeros((settings.states,) * 2), emissions, vocabulary)
    shared_coder, likelihoods = spark.sparkContext.broadcast(coder), []
    for _ in range(settings.rounds):
        shared = spark.sparkContext.broadcast(_single(model))

        def task(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            out = {"start": np.zeros((1, settings.states)), "moves": np.zeros((settings.states,) * 2), "emits": np.zeros((size, settings.states)), "fit": np.zeros((1, settings.states))}
            for group in _sequences(batches, shared_coder.value):
                starts, moves, emits, fit = expected_counts(shared.value, [x for x, _ in group], np.array([o for _, o in group]), size)
                out["start"] += starts
                out["moves"] += moves
                out["emits"] += emits
                out["fit"] += fit
            return out

        found = _summed(coded, task, settings.states)
        emissions = np.zeros((size, settings.states))
        emissions[: len(found["emits"])] = found["emits"]
        moves = np.zeros((settings.states,) * 2)
        moves[: len(found["moves"])] = found["moves"]
        likelihoods.append(float(found["fit"][0, 0]))
        model = _model(found["start"][0], moves, emissions, vocabulary)
        shared.unpersist()
    return model, likelihoods


def with_counts(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """``coded`` with ``known``: the counts of ``others``, 0 for unknown."""
    words = coded.select("row", F.posexplode("others").alias("k", "word"))
    told = words.join(counts, "word", "left").select("row", F.struct("k", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    lists = told.groupBy("row").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["n"]).alias("known"))
    return coded.join(lists, "row", "left")


def score(coded: DataFrame, vocabulary: Vocabulary, model: Model | None) -> DataFrame:
    """``coded(coded, others, known, ...)`` with ``n_tokens, n_known,
    train_tokens, base_score, score`` instead of the coded columns."""
    common.session(coded)
    kept = [c for c in coded.columns if c not in ("coded", "others", "known", "row")]
    shared = coded.sparkSession.sparkContext.broadcast((Coder(vocabulary), model))

    def scored(held: list[tuple], coder: Coder, model: Model | None) -> Iterator[pa.RecordBatch]:
        rows = [x for _, part in held for x in part]
        fits = forward(model, [x[0] for x in rows]) if model and rows else np.zeros(len(rows))
        k = 0
        for batch, part in held:
            n = np.array([len(x[0]) for x in part], np.int64)
            known, base, shares = (np.array([x[j] for x in part], kind) for j, kind in ((1, np.int64), (2, np.float64), (3, np.float64)))
            score = fits[k : k + len(part)] + shares if model else base
            k += len(part)
            arrays = [n, known, np.full(len(part), coder.vocabulary.tokens), base / math.log(10), np.round(score / math.log(10), 9)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *[pa.array(x) for x in arrays]], names=[*kept, *_ADDED])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, model = shared.value
        words, size, unseen = len(coder.vocabulary.symbols), coder.vocabulary.size, math.log(0.5 / coder.vocabulary.total)
        with np.errstate(divide="ignore"):
            masses = np.log(coder.vocabulary.base) if model else None
        held, tokens = [], 0
        for batch in batches:
            part = []
            for coded, others, known in zip(*(batch[c].to_pylist() for c in ("coded", "others", "known"))):
                base = coder.logs(coded, known or [])
                x, share = coder.symbols(coded, others), 0.0
                new = base <= unseen
                if model:
                    # a class's word has its share of the class in any state
                    split = np.flatnonzero((x >= words) & ~new)
                    share = (base[split] - masses[x[split]]).sum()
                    x[new] = size
                part.append((x, len(x) - np.count_nonzero(new), base.sum(), share))
                tokens += len(x)
            held.append((batch, part))
            if tokens >= SCORED:
                yield from scored(held, coder, model)
                held, tokens = [], 0
        yield from scored(held, coder, model)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in coded.select(*kept).schema.fields] + ["n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return coded.select(*kept, "coded", "others", "known").mapInArrow(task, schema)


_ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_corpus(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row of ``docs(doc_id, text)``; the model learns from all rows that
    are not held out.

    A null or empty text is its end token alone.  A row without an id is not
    held out.  Equal texts have equal scores, up to the last bits of sums;
    repeated rows count as often as they occur; long texts are scored whole, in
    one recursion.  A word that training did not see has the base's probability
    in every state, so a score differs from the base by what the states tell.
    If there is nothing to learn from, the score is the base score.  An empty
    table gives no rows.  Other columns are ignored.
    """
    settings = settings or Settings()
    common.session(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    counts = common.stage_table(count_words(rows.filter("NOT held_out")), "hmm-counts")
    vocabulary = learn_vocabulary(counts, settings)
    coded = encode(rows, vocabulary)
    model = train(coded.filter("NOT held_out"), vocabulary)[0] if vocabulary.tokens else None
    return score(with_counts(coded, counts.filter(_band() < vocabulary.band)), vocabulary, model).select("doc_id", "held_out", *_ADDED)
