"""Filter audit, importance resampling and the hidden Markov model against
brute force, on the tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracefield.llm import filteraudit, hmm, resample

WORDS = [f"word{k}" for k in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, quality int, n long, row long, rank int"
LABELS = "doc_id long, quality int, toxic int, part string"


def words(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def make(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 1, 0, 3, 4, 5) for i, t, lang in rows], SCHEMA)


ODD = [
    (1, words(1, 200), "en"), (2, words(1, 200), "de"), (2, words(1, 200), "en"), (3, None, None), (4, "", "en"), (5, "  \t\n ", None), (6, "", None),
    (7, "ABC def " * 60, "en"), (8, words(2, 130) + " $", "de"), (9, words(3, 40_000), "en"), (10, "É😀ß Zz9 " * 300, "fr"), (11, "?!", "en"), (12, words(2, 130) + " $", "en"),
    (None, words(1, 200), "en"), (None, None, None), (13, "a b c d\x0be", "en"), (14, "word1 " * 30, ""), (15, "word1 " * 30, "en"), (15, "word1 " * 30, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ODD)


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    masks = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        masks.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in own if letter in m[1] and not m[1] & before]
                out[part, "".join(order), step] = (
                    sum(not m[1] & (before | {letter}) for m in own), len(here), sum(letter in m[1] and bool(m[1] & before) for m in own),
                    sum(m[1] == {letter} for m in own), sum(m[2] for m in here), sum(m[3] for m in here),
                )
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("held", [1, 1 << 25])
def test_audit_of_odd_rows(spark, odd, monkeypatch, held):
    monkeypatch.setattr(filteraudit, "HELD_BYTES", held)
    labels = [(1, 1, 0), (1, None, 1), (2, 0, 0), (7, 1, 1), (None, 1, 1), (99, 1, 1), (15, 0, 1), (9, None, None)]
    got = filteraudit.audit(odd.repartition(4), spark.createDataFrame([(*x, "y") for x in labels], LABELS)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filteraudit.COUNTS) for r in got}
    assert len(got) == len(found) and found == brute_audit(ODD, labels)


def test_audit_of_empty_tables(spark, odd):
    labels = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(odd.limit(0), labels).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in filteraudit.audit(odd, labels).collect()} == {(0, 0)}


def test_equal_fingerprints_of_different_texts():
    entries = [(7, ("a", 3, [(3, "p", 0)])), (7, ("b", 1, [(1, "p", 1)])), (7, ("a", 2, [(2, "p", 0), (2, "q", 0)])), (7, ("a", 9, [(9, "p", 0)])), (8, (None, None, [(4, "p", 16)]))]
    assert sorted(filteraudit._chains(entries)) == [(1, "p", 1), (2, "p", 0), (2, "q", 0), (3, "p", 16), (4, "p", 16), (9, "p", 16)]


FEATURE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = FEATURE_WORD.findall((text or "").encode().lower())
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute_resample(rows, target, share=5, least=20):
    counted = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, f, _ in counted:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, f, n in counted:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: share * len(fit) // 100], 1):
        x[4] = k
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 20), (40, 90)])
def test_resampling_of_odd_rows(spark, odd, monkeypatch, sizes):
    monkeypatch.setattr(resample, "PIECE", sizes[0])
    monkeypatch.setattr(resample, "TAKEN", sizes[1])
    rows = ODD if sizes[0] > 1000 else [x for x in ODD if x[0] != 9]
    target = [words(2, 60), None, "", "É😀ß zz9", "?"]
    got = resample.resample(make(spark, rows), spark.createDataFrame([(x, 7) for x in target], "text string, n_words int"), share=45).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_resample([x[:2] for x in rows], target, share=45), key=key)


def test_resampling_of_the_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, resample.resample(docs, bench).collect()))
    expected = brute_resample([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in bench.select("text").collect()])
    assert got == sorted(expected) and sum(r[4] is not None for r in got) >= 5


def test_resampling_of_empty_tables(spark, odd):
    target = spark.createDataFrame([("word1 word2",)], "text string")
    assert resample.resample(odd.limit(0), target).count() == 0
    got = resample.resample(odd, target.limit(0), share=100).collect()
    assert len(got) == len(ODD) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(features(t)[1] >= 20 for _, t, _ in ODD)))


def test_crc_of_joined_words():
    parts = [("", "a"), ("x", "y" * 300), ("é", "ß"), ("abc", "d"), ("k" * 70_000, "z" * 70_000)]
    crc = lambda x: zlib.crc32(x.encode())
    columns = [pa.chunked_array([pa.array(x, t)]) for x, t in (([crc(a) for a, _ in parts] + [1], pa.uint32()), ([crc(b) for _, b in parts] + [None], pa.uint32()), ([len(b.encode()) for _, b in parts] + [None], pa.int64()))]
    assert resample.crc_append(*columns).to_pylist() == [crc(f"{a} {b}") for a, b in parts] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute_base(rows):
    split = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        x = split(t)
        out.append((i, held(i), len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)))
    return out


SMALL = hmm.Settings(states=3, rounds=3, words=60, lexicon=150, classes=8)


def plain_forward(model, x):
    """Log likelihood of one sequence, one step after the other."""
    size, total, last = len(model.emits), 0.0, None
    for t, s in enumerate(x):
        e = model.emits[s] if s < size else np.full(model.emits.shape[1], model.unknown)
        last = (model.first if t == 0 else last @ model.moves) * e
        total += math.log(last.sum())
        last = last / last.sum()
    return total


@pytest.fixture(scope="module")
def learned(spark, odd):
    rows = odd.select("doc_id", hmm.held_out().alias("held_out"), "text")
    counts = hmm.count_words(rows.filter("NOT held_out"))
    vocabulary = hmm.learn_vocabulary(counts, SMALL)
    coded = hmm.encode(rows, vocabulary)
    model, fits = hmm.train(coded.filter("NOT held_out"), vocabulary)
    return counts, vocabulary, coded, model, fits


def test_model_is_a_distribution(learned):
    counts, vocabulary, _, model, fits = learned
    assert vocabulary.tokens == sum(r["n"] for r in counts.collect()) and len(vocabulary.symbols) <= 61 and len(vocabulary.counts) <= 151
    assert vocabulary.base.sum() + model.unknown == pytest.approx(1)
    assert np.allclose(model.emits.sum(axis=0) + model.unknown, 1) and np.allclose(model.moves.sum(axis=1), 1) and model.first.sum() == pytest.approx(1)
    assert fits == sorted(fits)


def test_scores_against_a_plain_recursion(spark, odd, learned):
    _, vocabulary, _, model, _ = learned
    got = sorted(hmm.score_corpus(odd, SMALL).collect(), key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))
    texts = sorted(((i, t) for i, t, _ in ODD), key=lambda x: (x[0] or -1, len((x[1] or "").split())))
    base = brute_base([(i, t) for i, t, _ in ODD])
    exact = sorted(base, key=lambda x: (x[0] or -1, x[2]))
    counts = Counter(w for i, t, _ in ODD if not held(i) for w in hmm.tokens(t))
    for r, b, (i, t) in zip(got, exact, texts):
        assert tuple(r)[:5] == b[:5] and r["base_score"] == pytest.approx(b[5], abs=1e-6)
        x = hmm.tokens(t)
        symbols = [vocabulary.symbol(w) if counts[w] else vocabulary.size for w in x]
        shares = sum(math.log((counts[w] + 0.5) / vocabulary.total / vocabulary.base[s]) for w, s in zip(x, symbols) if counts[w] and s >= len(vocabulary.symbols))
        assert r["score"] == pytest.approx((plain_forward(model, symbols) + shares) / math.log(10), rel=1e-4, abs=1e-3)


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(1)
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(share(rng.random(2)), share(rng.random(2)), share(rng.random((2, 2))), share(rng.random((2, 4))).T.copy(), 0.0)
    sequences, opens = [np.array([0, 1, 3, 2]), np.array([2]), np.array([1, 1, 0])], np.array([True, False, False])
    starts, moves, emits, fit = hmm.expected_counts(hmm._single(model), sequences, opens, 4)
    want = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    total = 0.0
    for x, o in zip(sequences, opens):
        paths = list(np.ndindex(*[2] * len(x)))
        begin = model.first if o else model.inner
        p = np.array([begin[s[0]] * np.prod([model.moves[a, b] for a, b in zip(s, s[1:])]) * np.prod([model.emits[c, k] for c, k in zip(x, s)]) for s in paths])
        total += math.log(p.sum())
        for s, w in zip(paths, p / p.sum()):
            want[0][s[0]] += w * o
            for a, b in zip(s, s[1:]):
                want[1][a, b] += w
            for c, k in zip(x, s):
                want[2][c, k] += w
    for got, exact in zip((starts, moves, emits), want):
        assert np.allclose(got, exact, atol=1e-5)
    assert fit == pytest.approx(total, abs=1e-4)
    assert hmm.forward(model, sequences)[0] == pytest.approx(plain_forward(model, sequences[0]))


def test_model_of_the_table_beats_the_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = hmm.score_corpus(docs).collect()
    exact = {x[0]: x for x in brute_base([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])}
    assert all(tuple(r)[:5] == exact[r["doc_id"]][:5] and r["base_score"] == pytest.approx(exact[r["doc_id"]][5], abs=1e-6) for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert len(unseen) > 20 and sum(r["score"] > r["base_score"] for r in unseen) >= 0.9 * len(unseen)


def test_nothing_to_learn(spark, odd):
    assert hmm.score_corpus(odd.limit(0)).count() == 0
    i = next(k for k in range(100) if held(k))
    r = hmm.score_corpus(make(spark, [(i, "some words", "en"), (i, None, None)])).collect()
    assert all(x["score"] == x["base_score"] == 0.0 and x["train_tokens"] == 0 and x["n_known"] == 0 for x in r)


def test_audit_sends_texts_on_before_they_fill_a_worker():
    from tracefield.llm import filteraudit

    read = []

    def rows():
        for k in range(40):
            read.append(k)
            yield {"doc_id": k, "lang": "en", "text": f"{k} " + "x" * (1 << 20)}

    found = filteraudit._entries(rows())
    next(found)
    assert len(read) < 10 and len(list(found)) == 39
