"""The stages of the pipeline, each on what its predecessor left."""

import random
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds, before = docs.dtypes, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert [c for c, _ in after.dtypes] == [c for c, _ in kinds], name
        if name in ("language ID", "MinHash near-dedup"):
            assert 0 < after.count() <= before.count()
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "suffix-array dedup":
            assert after.count() == before.count() and after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert packed.filter("start = 0").count() == before.count()


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    n = min(5, len(parts))
    return {tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if parts else set()


def brute_kept(rows):
    """The first of ``rows(doc_id, text)``, ids least first and null last, of
    each class linked at a similarity of 0.8; texts without words stay."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((r for k, r in enumerate(rows) if find(k) == k), key=repr)


def kept(spark, sf_dir, docs):
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()), key=repr)


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def words(seed, n=104):
    return " ".join(random.Random(seed).choices([f"word{k}" for k in range(400)], k=n))


def test_near_copies_at_four_fifths_go(spark, sf_dir):
    at = lambda k: " ".join([*words(1).split()[: 104 - k], *words(2).split()[:k]])
    # of 100 shingles all but 10, 11 and 12 are shared: 90/110, 89/111, 88/112
    rows = [(1, at(0)), (2, at(10)), (3, words(3)), (4, at(12)), (5, at(11))]
    assert [i for i, _ in brute_kept(rows)] == [i for i, _ in kept(spark, sf_dir, make(spark, rows))]
    assert [i for i, _ in kept(spark, sf_dir, make(spark, rows[:3]))] == [1, 3]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert kept(spark, sf_dir, docs) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_by_text(spark, sf_dir):
    near = words(10).replace(words(10).split()[50], "changed", 1)
    rows = [
        (None, words(10)), (None, words(11)), (None, words(12)), (7, words(12)), (None, words(12)), (8, words(13)), (8, words(14)),
        (9, words(15)), (9, words(15)), (None, words(15).upper()), (None, "one two"), (6, words(14)),
    ]
    left = [(None, words(10)), (None, words(11)), (None, "one two"), (6, words(14)), (7, words(12)), (8, words(13)), (9, words(15))]
    assert kept(spark, sf_dir, make(spark, rows)) == sorted(left, key=repr) == brute_kept(rows)
    # near, not equal, copies without an id
    found = kept(spark, sf_dir, make(spark, [*rows, (None, near)]))
    assert len(found) == len(left) and ((None, near) in found) != ((None, words(10)) in found)


def test_stages_keep_rows_without_an_id(spark, sf_dir):
    docs = make(spark, [(None, words(k)) for k in range(20, 32)] + [(5, words(40)), (5, words(41))]).withColumn("source", F.lit("web"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        left = stage(spark, left, sf_dir).cache()
        assert {r["text"] for r in left.select("text").collect()} >= {words(k) for k in [*range(20, 32), 40, 41]}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir)
    assert packed.filter("start = 0").count() == left.count()


ODD = [(1, words(60)), (2, None), (3, ""), (None, " \t"), (4, "?! 12"), (5, words(61, 30_000)), (6, words(60)), (6, words(62)), (None, words(63)), (None, None), (7, "kurz")]


def odd(spark):
    """Odd rows with columns whose names clash with inner ones."""
    rows = make(spark, ODD)
    return rows.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("row", "mark", "doc", "class", "size", "taken", "copy", "spans", "key", "lang_pred"))])


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    docs, columns = odd(spark), list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        texts = [r["text"] for r in after.collect()] if name != "packing" else None
        if texts is None:
            assert after.filter("start = 0").count() == len(ODD)
            continue
        assert after.columns == columns, name
        if name == "language ID":
            assert None not in texts and "" not in texts and words(62) in texts
        if name == "suffix-array dedup":
            assert len(texts) == len(ODD) and texts.count(None) == 2 and words(62) in texts


def test_passages_are_cut_as_by_brute_force(spark, sf_dir):
    passage = words(70, 60)
    rows = [(1, "a " + passage + " b é"), (2, "c " + passage), (3, words(71)), (4, passage[:200]), (None, passage + words(72, 20))]
    data = [t.encode() for _, t in rows]
    seen = {}
    for d in data:
        for k in range(len(d) - 255):
            seen[d[k : k + 256]] = seen.get(d[k : k + 256], 0) + 1
    expected = []
    for d in data:
        gone = set()
        for k in range(len(d) - 255):
            if seen[d[k : k + 256]] > 1:
                gone.update(range(k, k + 256))
        expected.append(bytes(x for k, x in enumerate(d) if k not in gone).decode("utf-8", "ignore"))
    got = [r["text"] for r in corpus_pipeline.cut_repeats(spark, make(spark, rows), sf_dir).collect()]
    assert sorted(got) == sorted(expected) and len(expected[0]) < 20


def test_mix_takes_whole_copies_and_first_words(spark, sf_dir):
    docs = spark.createDataFrame([(k, words(80 + k, 30 + k), "en", s, 0) for k, s in enumerate(["a"] * 6 + ["b"] * 3 + [None] * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in corpus_pipeline.mixing.mix(docs).collect()}
    expected = []
    for r in docs.collect():
        parts, left = r["text"].split(" "), taken[r["doc_id"]]
        while left > 0:
            expected.append((r["doc_id"], " ".join(parts[:left])))
            left -= len(parts)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(expected)


def test_languages_decide_who_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    wrong = [r["doc_id"] for r in docs.collect() if r["lang"] and len(r["text"] or "") > 40 and kept.get(r["doc_id"], r["lang"]) != r["lang"]]
    lost = [r["doc_id"] for r in docs.collect() if r["lang"] and len(r["text"] or "") > 40 and r["doc_id"] not in kept]
    assert len(wrong) <= 0.02 * len(kept) and len(lost) <= 0.02 * len(kept)
