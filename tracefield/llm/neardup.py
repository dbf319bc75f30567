"""Near-duplicate classes by MinHash, odd sketches and exact confirmation.

1. Each text becomes the set of hashes of its distinct word shingles, MinHash
   samples of it, band keys over the samples, and an odd sketch: the samples
   folded into a parity bitmap.  Texts with equal sets become one node.
2. Rows of a band key held by several nodes meet in blocks.  The population
   count of two sketches' XOR estimates their similarity; pairs well below the
   threshold are dropped, and a block emits a spanning forest of the rest, not
   its pairs.  Of a key with many rows each row meets the key's hub first, and
   only rows that are not near it meet the others.  The components of all
   forests are families.
3. The texts of a family are confirmed on full sets.  In a large family every
   text meets the family's hub, the member nearest to a sample of it, so copies
   of one template are joined by one copy of each text.  Only families that
   this leaves in several classes meet in pairs of blocks, most similar pairs
   first, and a pair is skipped only if confirmed links already join it.  The
   components of the confirmed links are the classes.

Blocks have bounded size, so a hot key or a family that holds a third of all
rows is spread over many tasks, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .grouped import sorted_groups

BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
#: A pair whose similarity is estimated this far below the threshold is
#: dropped before confirmation: five standard errors of ``SAMPLES`` samples.
SLACK = 0.17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_K = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240101).integers(1, 2**31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = np.random.default_rng(20240102).integers(1, 2**63, SAMPLES, np.uint64)
SKETCH_SCHEMA = (
    "doc_id long, n_shingles long, fp_hi long, fp_lo long, bands array<long>, s0 long, s1 long, s2 long, s3 long"
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text, A-Z lower-cased,
    words cut at ASCII white space; a shorter text is one shingle, a text
    without words has none."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = (x ^ (x >> np.uint64(29))) * _K + ids[k : k + n]
    return np.unique(_mix(x))


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` MinHash samples of a non-empty set, each by a permutation
    of 32 bits, in which processors multiply several at once."""
    low, high = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), 512):
        np.minimum(low, np.multiply.outer(high[k : k + 512], _SEEDS).min(axis=0), out=low)
    return low.astype(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    mixed = _mix(samples ^ _SALTS).reshape(BANDS, ROWS)
    return _mix(mixed.sum(axis=1, dtype=np.uint64) + _SALTS[:BANDS])


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The samples folded into ``SKETCH_BITS`` parity bits."""
    bits = np.bincount((_mix(samples + _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.uint64)


def estimated_similarity(different_bits: np.ndarray) -> np.ndarray:
    left = np.maximum(1 - 2 * different_bits / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


def most_bits(least: float) -> int:
    """The largest bit difference at which the estimate reaches ``least``."""
    return int(np.flatnonzero(estimated_similarity(np.arange(SKETCH_BITS // 2)) >= least).max(initial=0))


def sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """``SKETCH_SCHEMA`` rows of ``docs(doc_id, text)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            keys, sketches = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
            for k, text in enumerate(batch["text"]):
                found = shingle_set(text.as_py(), words)
                sizes[k] = len(found)
                if len(found):
                    prints[k] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.uint64)
                    samples = min_samples(found)
                    keys[k], sketches[k] = band_keys(samples), odd_sketch(samples)
            offsets = pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
            longs = [pa.array(x.copy().view(np.int64)) for x in (*prints.T, *sketches.T)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes), *longs[:2], bands, *longs[2:]], names=[c.split()[0] for c in SKETCH_SCHEMA.split(", ")]
            )

    return docs.mapInArrow(task, SKETCH_SCHEMA)


def block_pairs(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Deal the rows of each ``key`` into ``blocks`` blocks by id and give each
    row to every pair of blocks it belongs to, as ``i <= j`` and ``block``."""
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.uint16)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def likely_forest(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a row and a column within ``limit``
    bits."""
    index: dict[int, int] = {}
    at = [index.setdefault(x, len(index)) for x in ids.tolist()]
    parent, out = list(range(len(index))), []
    for k in range(0, len(rows), 256):
        near = _different(sketches[rows[k : k + 256]], sketches[columns]) <= limit
        for x, y in zip(*np.nonzero(near)):
            p, q = int(rows[k + x]), int(columns[y])
            a, b = _root(parent, at[p]), _root(parent, at[q])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[p], ids[q]))
    return out


def different_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches, given as prefixes of their
    columns."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(4)), F.lit(0))


def likely_links(nodes: DataFrame, limit: int, block_rows: int) -> DataFrame:
    """Edges whose components are those of all pairs that share a band key and
    are within ``limit`` bits."""
    sketch_columns = ["s0", "s1", "s2", "s3"]
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1")
    shared = common.stage_table(shared, "neardup-shared")
    found = keyed.join(shared, "key").join(nodes.select("id", *sketch_columns), "id")
    small = found.filter(F.col("n") <= block_rows)
    dealt = small.select("key", "id", *sketch_columns, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(True).alias("row_side"), F.lit(True).alias("column_side"))
    hubs = shared.filter(F.col("n") > block_rows).select("key", "hub")
    edges = None
    if hubs.limit(1).count():
        # at most one key in block_rows rows is hot
        hubs = hubs.join(nodes.select(F.col("id").alias("hub"), *[F.col(c).alias(f"h{k}") for k, c in enumerate(sketch_columns)]), "hub")
        met = found.filter(F.col("n") > block_rows).drop("hub").join(common.broadcast_within(hubs, 200_000), "key")
        met = met.withColumn("near", different_bits("s", "h") <= limit).drop("h0", "h1", "h2", "h3")
        met = common.stage_table(met, "neardup-hot")
        edges = met.filter("near AND id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        left = met.filter("NOT near").groupBy("key").agg(F.count("*").alias("left"))
        met = met.join(common.broadcast_within(left, 200_000), "key")
        blocks, parts = F.ceil(F.col("n") / block_rows), F.ceil(F.col("left") / block_rows)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        all_rows = met.withColumn("i", F.pmod(F.xxhash64("id"), blocks)).withColumn("j", every(parts)).withColumn("row_side", F.lit(True)).withColumn("column_side", F.lit(False))
        rest = met.filter("NOT near").withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), parts)).withColumn("i", every(blocks))
        rest = rest.withColumn("row_side", F.lit(False)).withColumn("column_side", F.lit(True))
        dealt = dealt.unionByName(all_rows.select(dealt.columns)).unionByName(rest.select(dealt.columns))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["key", "i", "j"]):
            if len(group["id"]) > 1:
                sketches = np.stack([group[s] for s in sketch_columns], axis=1).view(np.uint64)
                out += likely_forest(group["id"], np.flatnonzero(group["row_side"]), np.flatnonzero(group["column_side"]), sketches, limit)
            if len(out) > 5000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    found = dealt.select("key", "i", "j", "row_side", "column_side", "id", *sketch_columns).mapInArrow(task, "a long, b long")
    return (found.unionByName(edges) if edges is not None else found).distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed_forest(
    ids: np.ndarray, blocks: np.ndarray, classes: np.ndarray, texts: list[str], percent: int, limit: int, words: int
) -> list[tuple[int, int]]:
    """Confirmed links that join whatever confirmed links join in the group
    beside those of ``classes``."""
    sets = [shingle_set(t, words) for t in texts]
    sketches = np.stack([odd_sketch(min_samples(x)) for x in sets])
    sizes = np.array([len(x) for x in sets])
    first = blocks == blocks.min()
    whole = first.all()
    rows, columns = (np.arange(len(ids)),) * 2 if whole else (np.flatnonzero(first), np.flatnonzero(~first))
    pairs = []
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        bits = _different(sketches[part], sketches[columns])
        small, large = np.minimum.outer(sizes[part], sizes[columns]), np.maximum.outer(sizes[part], sizes[columns])
        open_ = classes[part][:, None] != classes[columns][None, :]
        x, y = np.nonzero(open_ & (bits <= limit) & (100 * small >= percent * large))
        pairs.append(np.stack([part[x], columns[y], bits[x, y]], axis=1))
    pairs = np.concatenate(pairs)
    if whole:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    # one parent for all members of a class
    _, leader, member = np.unique(classes, return_index=True, return_inverse=True)
    parent, out = leader[member].tolist(), []
    for p, q, _ in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist():
        a, b = _root(parent, p), _root(parent, q)
        if a != b and linked(sets[p], sets[q], percent):
            parent[max(a, b)] = min(a, b)
            if ids[p] != ids[q]:
                out.append((ids[p], ids[q]))
    return out


def hubs_of(members: DataFrame) -> DataFrame:
    """``(family, hub)``: of each family the member whose sketch is nearest to
    those of eight members drawn by a hash."""
    sketch_columns = ["s0", "s1", "s2", "s3"]
    order = Window.partitionBy("family").orderBy(F.xxhash64("id"), "id")
    drawn = members.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")
    drawn = drawn.groupBy("family").agg(F.collect_list(F.struct(*sketch_columns)).alias("drawn"))
    apart = F.aggregate(
        "drawn", F.lit(0),
        lambda total, x: total + sum((F.bit_count(F.col(c).bitwiseXOR(x[c])) for c in sketch_columns), F.lit(0)),
    )
    scored = members.join(common.broadcast_within(drawn, 100_000), "family").select("family", "id", apart.alias("apart"))
    return scored.groupBy("family").agg(F.min_by("id", F.struct("apart", "id")).alias("hub"))


def hub_links(texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Confirmed edges of every text of ``texts(family, hub, parts, id, text)``
    with its family's hub.  Texts are dealt to blocks once; the hub goes to
    each block of its family."""
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("is_hub", F.lit(False))
    hub = texts.filter("id = hub").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.unionByName(hub.withColumn("is_hub", F.lit(True)).select(dealt.columns))
    dealt = dealt.select("family", "block", "is_hub", "id", "text").repartition("family", "block").sortWithinPartitions("family", "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["family", "block"]):
            hubs = np.flatnonzero(group["is_hub"])
            hub, own = group["id"][hubs[0]], [shingle_set(group["text"][k], words) for k in hubs]
            found = []
            for x, text in zip(group["id"].tolist(), group["text"]):
                if x != hub:
                    met = shingle_set(text, words)
                    if any(linked(o, met, percent) for o in own):
                        found.append((hub, x))
            if found:
                yield _edges(found)

    return dealt.mapInArrow(task, "a long, b long")


def confirmed_links(docs: DataFrame, families: DataFrame, percent: int, limit: int, words: int, block_rows: int, block_shingles: int) -> DataFrame:
    """Confirmed edges within ``families(id, n_shingles, family, s0 to s3)``
    whose components are those of all confirmed links."""
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / block_rows, F.col("shingles") / block_shingles))
    placed = common.stage_table(families.join(sizes.withColumn("parts", blocks), "family").drop("shingles", "n_shingles"), "neardup-families")
    large = placed.filter("parts > 1")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    placed_ids = placed.select("id", "family", "n", "parts")
    open_rows, star = placed_ids.withColumn("class", F.col("id")), None
    if large.limit(1).count():
        hubs = common.stage_table(hubs_of(large), "neardup-hubs")
        headed = large.select("family", "id", "parts").join(common.broadcast_within(hubs, 200_000), "family")
        star = common.stage_table(hub_links(texts.join(common.broadcast_within(headed, 1_000_000), "id"), percent, words), "neardup-star")
        in_class = star.select(F.col("b").alias("id"), F.col("a").alias("hub")).distinct()
        classed = placed_ids.join(in_class, "id", "left").withColumn("class", F.coalesce("hub", "id")).drop("hub")
        joined = classed.groupBy("family").agg(F.count_if(F.col("class") != F.col("id")).alias("joined"), F.max("n").alias("n"), F.max("parts").alias("parts"))
        done = joined.filter("parts > 1 AND joined = n - 1").select("family")
        open_rows = common.stage_table(classed.join(common.broadcast_within(done, 200_000), "family", "left_anti"), "neardup-open")
    open_rows = common.broadcast_within(open_rows.select("id", "family", "class", "parts"), 1_000_000)
    dealt = block_pairs(texts.join(open_rows, "id"), "family", F.col("parts"))
    dealt = dealt.select("family", "i", "j", "block", "id", "class", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["family", "i", "j"]):
            found = confirmed_forest(group["id"], group["block"], group["class"], list(group["text"]), percent, limit, words)
            if found:
                yield _edges(found)

    found = dealt.mapInArrow(task, "a long, b long")
    return found.unionByName(star) if star is not None else found


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    words: int = 5,
    block_rows: int = 2048,
    family_rows: int = 512,
    family_shingles: int = 1_000_000,
) -> DataFrame:
    """Near-duplicate classes of all documents.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  Two documents
    are linked if 100 times the intersection of their shingle sets is at least
    ``percent`` times the union.  Returns one row per input row: ``doc_id,
    n_shingles, component_id`` (the least id reachable) and ``kept``.  A null,
    empty or blank text has no shingles and is its own class.  Rows that repeat
    an id count as one document; a row without an id joins the class of equal
    texts, and is kept if none of them has an id.  An empty table gives an
    empty result.
    """
    common.session(docs)
    docs = docs.select("doc_id", "text")
    sketches = common.stage_table(sketch(docs, words), "neardup-sketches")
    copies = sketches.filter("n_shingles > 0").groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("rep"))
    # staged, so that the join reads two shuffles and hot copies can be split
    copies = common.stage_table(copies, "neardup-copies")
    tagged = sketches.join(copies, ["fp_hi", "fp_lo"], "left")
    nodes = common.stage_table(
        tagged.filter("doc_id = rep").select(F.col("rep").alias("id"), "n_shingles", "bands", "s0", "s1", "s2", "s3"), "neardup-nodes"
    )
    limit = most_bits(percent / 100 - SLACK)
    likely = common.stage_table(likely_links(nodes, limit, block_rows), "neardup-likely")
    roots = connected_components(likely)
    members = roots.select(F.col("node").alias("id"), F.col("root").alias("family"))
    heads = roots.select(F.col("root").alias("id"), F.col("root").alias("family")).distinct()
    sizes = nodes.groupBy("id").agg(F.max(F.struct("n_shingles", "s0", "s1", "s2", "s3")).alias("x")).select("id", "x.*")
    families = members.unionByName(heads).join(sizes, "id")
    confirmed = common.stage_table(
        confirmed_links(docs, families, percent, limit, words, family_rows, family_shingles), "neardup-links"
    )
    classes = connected_components(confirmed)
    ids = tagged.select("doc_id", "n_shingles", "rep")
    placed = ids.join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
