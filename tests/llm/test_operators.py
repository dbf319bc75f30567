"""The corpus operators against brute force, round trips and odd tables."""

import hashlib
import random
import tracemalloc
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefield.llm import bitplanes, common, files, langid, media, merkle, mixing, neardup, packing, queries, repeats, sitetree, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, first int, mark int, id long"
WORDS = [f"word{k}" for k in range(400)]


def words(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def make(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "aa", s, 0, "x", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    base = words(1, 200)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [
        (1, base, "a"), (2, base.upper(), "a"), (3, near, "b"), (4, None, None), (5, "", "b"), (6, "  \t\n ", "c"),
        (7, "one two", "c"), (8, "ONE  two", None), (9, words(2, 30_000), "a"), (10, "é😀ß " * 300, "b"), (11, "?!", "a"),
        (12, words(3, 90) + "\n\n" + words(4, 90), "a"), (12, words(3, 90) + "\n\n" + words(4, 90), "a"), (None, base, "a"), (None, None, None),
    ]
    return make(spark, rows)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def shingles(text):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", parts) if w]
    n = min(5, len(parts))
    return {tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if parts else set()


def brute_classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("blocks", [(2048, 512), (4, 3)])
def test_near_duplicates(docs, texts, blocks):
    found = neardup.near_duplicates(docs, block_rows=blocks[0], family_rows=blocks[1]).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_odd_rows(odd):
    rows = neardup.near_duplicates(odd).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == odd.count()
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 1, 1, 4, 5, 6, 7, 7]
    assert got[4]["n_shingles"] == 0 and got[7]["n_shingles"] == 1
    assert sorted((r["component_id"] or -1) for r in rows if r["doc_id"] is None) == [-1, 1]


def test_odd_sketch_estimates_high_similarity():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 2000, np.uint64))
    b = np.concatenate([a[:1900], a[:100] + np.uint64(1)])
    bits = np.bitwise_count(neardup.odd_sketch(neardup.min_samples(a)) ^ neardup.odd_sketch(neardup.min_samples(np.unique(b)))).sum()
    assert abs(neardup.estimated_similarity(np.array([bits]))[0] - 1900 / 2100) < 0.12


def brute_cut(data, length):
    """Covered bytes per text, from all windows of all texts."""
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                hit[k : k + length] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_repeats(spark, limit):
    passage, other = words(7, 90), words(8, 70)
    parts = [words(k, 120) for k in range(20, 32)]
    made = [a + passage[k * 7 :] + b for k, (a, b) in enumerate(zip(parts[:4], parts[4:8]))]
    made += [other + parts[8] + other, parts[9] + other, "ab" * 900, passage[:255], passage[3:300] + "é" * 400, "x" * 256, "", parts[10]]
    made += [passage[10:280] + "q", "z" + passage[10:290]]
    df = make(spark, [(k, t, "a") for k, t in enumerate(made)])
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, 256, limit).collect()}
    data = [t.encode() for t in made]
    for k, (d, hit) in enumerate(zip(data, brute_cut(data, 256))):
        kept = np.frombuffer(d, np.uint8)[~hit].tobytes()
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        assert (got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()), k


def test_repeats_on_the_table(docs, texts):
    ids = sorted(texts)
    data = [texts[i].encode() for i in ids]
    short = [k for k in range(len(ids)) if len(data[k]) < 20_000]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs.filter(F.octet_length("text") < 20_000)).collect()}
    expected = {ids[k]: int(hit.sum()) for k, hit in zip(short, brute_cut([data[k] for k in short], 400))}
    assert {i: n for i, n in got.items()} == {i: n for i, n in expected.items() if i in got}


def test_repeats_of_odd_rows(odd):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    twelve = [r for r in rows if r["doc_id"] == 12]
    assert len(twelve) == 2 and all(r["n_removed"] == r["n_bytes"] for r in twelve)
    assert next(r for r in rows if r["doc_id"] == 9)["n_removed"] == 0


def test_encoder_equals_the_library(docs, texts):
    encoder = tokens.Encoder(queries.tokenizer_path(), 500, 500)
    odd = ["", "It's a TEST... don't!", "ÀÉ naïve ﬁ ½ 😀", "a b c", "x" * 500, "İ ı ß ẞ", "<|endoftext|> <|startoftext|>", "é e ́"]
    for text in odd + list(texts.values())[:120]:
        expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected, text[:80]


def ids_of(text, end):
    return np.frombuffer(tokens.encoder(queries.tokenizer_path()).encode(text), "<u4").tolist() + [end]


def check_pieces(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = ids_of(texts[i], 2), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 4096 - at)
    return padded / (padded + total)


def test_packing(docs, texts):
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    assert check_pieces(rows, texts) < 0.02


def test_packing_of_odd_rows(odd, spark):
    unique = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(unique, queries.tokenizer_path()).collect(), {r["doc_id"]: r["text"] for r in unique.collect()})
    assert packing.pack(odd, queries.tokenizer_path()).filter("start = 0").count() == odd.count()


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(30):
        steps = [rng.randint(1, 6) for _ in range(25)]
        positions = [0, *np.cumsum(steps).tolist()]
        penalties = [0.0] + [rng.choice([0.0, 1.0, 3.0]) for _ in steps]
        cost = lambda i, j: 0 if (n := positions[j] - positions[i]) in (8, 4) else 16 - n  # noqa: E731, B023
        best = [0.0] + [float("inf")] * len(steps)
        for j in range(1, len(positions)):
            best[j] = min(best[i] + cost(i, j) + penalties[j] for i in range(j) if positions[j] - positions[i] <= 16)
        cuts = [0, *packing.choose_cuts(positions, penalties, 16, 4)]
        assert sum(cost(i, j) + penalties[j] for i, j in zip(cuts, cuts[1:])) == pytest.approx(best[-1])


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(spark, odd, kind):
    folder = common.fresh_dir(spark, "planes")
    bitplanes.write_ids(odd, folder, queries.tokenizer_path(), kind=kind, block_ids=1000)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"], r["start"]) for r in bitplanes.read_ids(spark, folder).collect()), key=lambda r: r[4])
    expected = []
    for r in sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = ids_of(r["text"], 1)
        expected.append((r["doc_id"] is not None, r["doc_id"] or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[:4] for r in got] == expected
    assert [r[4] for r in got] == [0, *np.cumsum([r[2] for r in expected])[:-1].tolist()]


def test_media(spark, odd):
    folder = common.fresh_dir(spark, "media")
    media.write_archives(odd, folder)
    rows = media.features(media.read_archives(spark, folder)).collect()
    key = lambda i, n, h: (i is not None, i or 0, n, h)
    expected = []
    for r in odd.collect():
        data = (r["text"] or "").encode()
        expected.append(key(r["doc_id"], len(data), hashlib.sha256(data + bytes(-len(data) % 64 or (0 if data else 64))).hexdigest()))
    assert sorted(key(r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in rows) == sorted(expected)
    assert len({r["feature"] for r in rows if r["n_bytes"] == 0}) == 1


def test_media_member_is_fetched_again(spark, odd, monkeypatch):
    folder = common.fresh_dir(spark, "media")
    media.write_archives(odd, folder)
    reader = media.ArchiveReader({"path": folder, "rangeBytes": "2000"})
    failed, read = set(), media.read_member

    def flaky(archive, member):
        if member.header_offset not in failed:
            failed.add(member.header_offset)
            raise OSError("lost")
        return read(archive, member)

    monkeypatch.setattr(media, "read_member", flaky)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == odd.count()


def test_media_digests_and_feature(spark, odd):
    folder = common.fresh_dir(spark, "media")
    media.write_archives(odd, folder, archive_bytes=3000)
    stored = {}
    for path, _ in files.list_files(folder, ".zip"):
        with zipfile.ZipFile(path.removeprefix("file://")) as archive:
            for name in archive.namelist():
                stored.setdefault(name.rpartition("/")[2], []).append(archive.read(name))
    expected = []
    for r in odd.collect():
        data = (r["text"] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        samples = np.frombuffer(payload, np.uint8)
        bins = [int((samples // 16 == k).sum()) * 255 // len(samples) for k in range(16)]
        feature = f"mean={samples.mean():.4f};std={samples.std():.4f};hist=" + bytes(bins).hex()
        image = stored[f"{'null' if r['doc_id'] is None else r['doc_id']}.png"]
        own = next(x for x in image if media.from_png(x)[0].tobytes() == payload and media.from_png(x)[1] == len(data))
        expected.append((r["doc_id"] or -1, len(data), len(payload), zlib.crc32(payload[-64:]), len(own), hashlib.sha256(own).hexdigest(), feature))
    columns = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = [(r["doc_id"] or -1, *(r[c] for c in columns)) for r in media.features(media.read_archives(spark, folder)).collect()]
    assert sorted(got) == sorted(expected)


def test_archives_of_others(spark, tmp_path):
    data = {f"a/{k}.bin": random.Random(k).randbytes(k * 300) for k in range(40)}
    for part, kind in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"{part}.zip", "w", kind) as archive:
            archive.writestr("a/", b"")
            for name, content in list(data.items())[part::2]:
                archive.writestr(name, content)
    rows = media.read_archives(spark, f"file://{tmp_path}").collect()
    assert {r["member"]: bytes(r["media"]) for r in rows} == data and len(rows) == len(data)
    reader = media.ArchiveReader({"path": str(tmp_path), "rangeBytes": "500"})
    ranges = reader.partitions()
    assert 2 < len(ranges) <= 2 * media.MOST_RANGES
    assert sum(b.num_rows for p in ranges for b in reader.read(p)) == len(data)


def test_records_are_written_without_a_copy():
    class Sink:
        size = 0

        def write(self, data):
            self.size += len(data)

    payload, sink = bytes(range(256)) * (1 << 18), Sink()
    tracemalloc.start()
    warc.write_record(sink, b"head", payload)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sink.size > 0 and peak < len(payload) / 16


def test_records_of_odd_rows(spark):
    big = "<p>" + "x" * 2000
    rows = [(None, "a", big), (None, "b", big), (4, "c", big), (4, "d", big), (5, "e", None), (6, None, None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.fresh_dir(spark, "warc")
    warc.write_warc(pages, folder)
    got = warc.records(warc.read_chunks(spark, folder)).collect()
    assert sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, "response", 0), (0, "revisit", 4), (0, "revisit", 4), (4, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0),
    ]
    assert all(r["intact"] for r in got)


def test_warc(spark):
    big, small = "<p>" + "x" * 2000, "<p>y"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, small), (4, "http://c", small), (5, "http://d", None), (6, "", ""), (7, "u", "é" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = common.fresh_dir(spark, "warc")
    warc.write_warc(pages, folder)
    chunks = warc.read_chunks(spark, folder)
    assert chunks.filter("chunk_no > 0").count() > 0
    got = {r["page_id"]: r for r in warc.records(chunks).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert [got[i]["record_type"] for i in range(1, 8)] == ["revisit"] + ["response"] * 6
    assert got[1]["refers_to"] == 2 and got[2]["refers_to"] is None


def test_mix(odd, docs):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    one, two = ({(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs, range_rows=n).collect()} for n in (2000, 10))
    assert one == two
    sums = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 1 for r in sums)


def test_merkle(odd):
    rows = merkle.compare_with_edits(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(prints[12]) == 1 and prints[4] == prints[5] and prints[1] != prints[3]
    long = next(r for r in rows if r["doc_id"] == 9)
    assert long["near_edited"] > 0.5


def test_language(docs, odd):
    rows = docs.withColumn("held_out", langid.held_out())
    model = langid.train(rows.filter("NOT held_out"))
    found = langid.predict(rows.filter("held_out AND lang IS NOT NULL"), model)
    known = [r for r in found.collect() if r["lang_pred"] != "und" and len(r["text"]) > 40]
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.95 * len(known)
    got = {r["doc_id"]: r for r in langid.predict(odd.filter("doc_id < 12"), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 11))
    assert langid.train(odd.limit(0)) is None and langid.predict(odd, None).filter("lang_pred != 'und'").count() == 0


def test_every_language_is_learned(spark):
    made = spark.range(20_000).selectExpr("id AS doc_id", "'der alte hund schläft in der sonne' AS text", "'de' AS lang")
    other = spark.range(900).selectExpr("id + 50000 AS doc_id", "concat('the old dog sleeps in the sun ', id) AS text", "'en' AS lang")
    alike = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "'le vieux chien dort au soleil' AS text", "'fr' AS lang")
    rows = made.unionByName(other).unionByName(alike)
    sizes = {r["lang"]: r["count"] for r in langid.sample_rows(rows, 600, 1 << 30).groupBy("lang").count().collect()}
    assert sizes == {"de": 600, "en": 600, "fr": 1}
    few = {r["lang"]: r["count"] for r in langid.sample_rows(rows, 600, 100).groupBy("lang").count().collect()}
    assert few["de"] == 2 and few["fr"] == 1
    model = langid.train(rows)
    assert model.languages == ["de", "en", "fr"]
    asked = spark.createDataFrame([(1, "der hund in der sonne"), (2, "the dog in the sun"), (3, "le chien au soleil " * 40_000), (2, "the dog in the sun")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(asked, model).collect()) == [(1, "de"), (2, "en"), (2, "en"), (3, "fr")]


def test_code_lengths_are_those_of_a_plain_context_tree(monkeypatch):
    model_text, text = b"abracadabra abracadabra", b"abra cad"
    grams, counts = np.unique(langid.gram_codes(model_text), return_counts=True)
    import pyarrow as pa

    model = langid.build_model(pa.table({"lang": ["aa"] * len(grams), "gram": grams, "n": counts.astype(np.int64)}))
    seen = [Counter() for _ in range(4)]
    padded = b"\n\n\n" + model_text
    for k in range(3, len(padded)):
        for n in range(4):
            seen[n][padded[k - n : k], padded[k]] += 1

    def bits(context, symbol, n):
        if n < 0:
            return 8.0
        own = {s: c for (x, s), c in seen[n].items() if x == context}
        total, distinct = sum(own.values()), len(own)
        if symbol in own:
            return -np.log2(own[symbol] / (total + distinct))
        return (-np.log2(distinct / (total + distinct)) if own else 0) + bits(context[1:], symbol, n - 1)

    padded = b"\n\n\n" + text
    expected = sum(bits(padded[k - 3 : k], padded[k], 3) for k in range(3, len(padded)))
    assert model.code_lengths([text])[0, 0] == pytest.approx(expected, rel=1e-5)
    monkeypatch.setattr(langid, "SLICE", 5)
    assert model.code_lengths([text, b"", text])[2, 0] == pytest.approx(expected, rel=1e-5)


@pytest.mark.parametrize(
    "run",
    [
        neardup.near_duplicates, repeats.remove_repeats, mixing.mix, merkle.compare_with_edits,
        lambda d: packing.pack(d, queries.tokenizer_path()), lambda d: langid.predict(d, langid.train(d)),
        lambda d: sitetree.extract(d.selectExpr("doc_id AS page_id", "text AS url", "text AS html")),
    ],
)
def test_empty_tables(odd, run):
    assert run(odd.limit(0)).count() == 0


def test_empty_tables_as_files(spark, odd):
    none = odd.limit(0)
    a, b, c = (common.fresh_dir(spark, x) for x in "abc")
    assert media.write_archives(none, a) == [] and media.features(media.read_archives(spark, a)).count() == 0
    assert bitplanes.write_ids(none, b, queries.tokenizer_path()) == [] and bitplanes.read_ids(spark, b).count() == 0
    warc.write_warc(none.selectExpr("doc_id AS page_id", "source AS url", "text AS html"), c)
    assert warc.records(warc.read_chunks(spark, c)).count() == 0
