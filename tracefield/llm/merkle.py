"""Merkle-tree fingerprints of documents.

A text is cut into sections at blank lines, sections into paragraphs at line
ends, and paragraphs into leaves of up to four words that also end with a
sentence.  All cuts are lossless.  Each node hashes its children, so equal
roots mean equal texts and a walk down differing branches finds an edit.
The fingerprint writes the tree out::

    <root>:<section>(<paragraph>[<leaf>.<leaf>],...)/...

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAF = r"(?:[^ .!?]+ +){0,3}(?:[^ .!?]+[.!?]* *|[.!?]+ *| +)"
#: Hexadecimal digits of a leaf and of an inner node as written out.
LEAF_DIGITS, NODE_DIGITS = 7, 8


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def leaf_hashes(text: Column) -> Column:
    """Sections of paragraphs of full leaf hashes."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), _md5)
    paragraphs = lambda s: F.transform(F.split(s, "\n"), leaves)
    return F.transform(F.split(text, "\n\n"), paragraphs)


def fingerprint(tree: Column) -> Column:
    """The written-out tree of ``leaf_hashes``."""
    paragraph = lambda p: F.struct(
        _md5(F.array_join(p, "")).alias("hash"),
        F.array_join(F.transform(p, lambda x: F.substring(x, 1, LEAF_DIGITS)), ".").alias("leaves"),
    )
    section = lambda ps: F.struct(
        _md5(F.array_join(F.transform(ps, lambda x: x["hash"]), "")).alias("hash"),
        F.array_join(
            F.transform(ps, lambda x: F.concat(F.substring(x["hash"], 1, NODE_DIGITS), F.lit("["), x["leaves"], F.lit("]"))),
            ",",
        ).alias("paragraphs"),
    )
    sections = F.transform(F.transform(tree, lambda s: F.transform(s, paragraph)), section)
    write = lambda ss: F.concat(
        _md5(F.array_join(F.transform(ss, lambda x: x["hash"]), "")),
        F.lit(":"),
        F.array_join(
            F.transform(ss, lambda x: F.concat(F.substring(x["hash"], 1, NODE_DIGITS), F.lit("("), x["paragraphs"], F.lit(")"))),
            "/",
        ),
    )
    return F.element_at(F.transform(F.array(sections), write), 1)


def leaf_set(tree: Column) -> Column:
    """The distinct leaves as the fingerprint writes them, as integers."""
    short = lambda x: F.conv(F.substring(x, 1, LEAF_DIGITS), 16, 10).cast("int")
    return F.array_distinct(F.transform(F.flatten(F.flatten(tree)), short))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over all leaves of two leaf sets; two empty
    sets are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(docs: DataFrame) -> DataFrame:
    """``(key, next_key, prev_key, prev_need)`` per distinct document id in
    ascending order, round the end; ``prev_need`` is a quarter of the previous
    text's length.  Ids are range-partitioned and only the partitions' first
    and last ids meet."""
    needs = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"), F.count("*").alias("rows"))
    placed = common.stage_table(
        needs.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "merkle-ids"
    )
    within = Window.partitionBy("part").orderBy("key")
    inner = placed.withColumn("prev_key", F.lag("key").over(within)).withColumn("prev_need", F.lag("need").over(within))
    tails = placed.groupBy("part").agg(F.max("key").alias("tail_key"), F.max_by("need", "key").alias("tail_need"))
    across, every = Window.orderBy("part"), Window.partitionBy()
    for name in ("tail_key", "tail_need"):
        last = F.max_by(name, "part").over(every)
        tails = tails.withColumn(f"{name}_before", F.coalesce(F.lag(name).over(across), last))
    tails = tails.select("part", "tail_key_before", "tail_need_before")
    linked = inner.join(tails, "part").select(
        "key",
        F.coalesce("prev_key", "tail_key_before").alias("prev_key"),
        F.coalesce("prev_need", "tail_need_before").alias("prev_need"),
        "rows",
    )
    return common.stage_table(linked, "merkle-links")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and their likeness.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  The edited
    text replaces the last quarter of the code points by the start of the next
    document in ascending ``doc_id`` (after the last, the first; alone, its
    own).  A null text counts as empty; a null ``doc_id`` sorts first.  Where
    rows repeat an id each is fingerprinted, and the document before them sees
    the least of their texts.  An empty table gives an empty result.
    """
    common.session(docs)
    docs = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(common.NULL_KEY)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    links = with_next(docs)
    repeated = links.filter("rows > 1").limit(1).count() > 0
    joined = docs.join(links.drop("rows"), "key")
    ahead = joined.select(
        F.col("prev_key").alias("key"),
        F.col("text").substr(F.lit(1), F.col("prev_need")).alias("next_start"),
        leaf_set(leaf_hashes(F.col("text"))).alias("next_leaves"),
        *([F.col("text").alias("next_text")] if repeated else []),
    )
    if repeated:
        ahead = ahead.groupBy("key").agg(F.min_by(F.struct("next_start", "next_leaves"), "next_text").alias("x")).select("key", "x.*")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - quarter), F.col("next_start").substr(F.lit(1), quarter)
    )
    trees = (
        joined.select("key", "text")
        .join(ahead, "key")
        .withColumn("edited", edited)
        .withColumn("tree", leaf_hashes(F.col("text")))
        .withColumn("edited_tree", leaf_hashes(F.col("edited")))
        .withColumn("leaves", leaf_set(F.col("tree")))
    )
    return trees.select(
        F.when(F.col("key") != common.NULL_KEY, F.col("key")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaf_set(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def _sql_tree(text: str) -> str:
    return (
        f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),"
        f" lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: md5(l))))"
    )


def _sql_print(tree: str) -> str:
    para = "md5(array_to_string(p, ''))"
    sect = f"md5(array_to_string(list_transform(s, lambda p: {para}), ''))"
    leaves = f"array_to_string(list_transform(p, lambda l: substr(l, 1, {LEAF_DIGITS})), '.')"
    paras = f"array_to_string(list_transform(s, lambda p: substr({para}, 1, {NODE_DIGITS}) || '[' || {leaves} || ']'), ',')"
    return (
        f"md5(array_to_string(list_transform({tree}, lambda s: {sect}), '')) || ':' || "
        f"array_to_string(list_transform({tree}, lambda s: substr({sect}, 1, {NODE_DIGITS}) || '(' || {paras} || ')'), '/')"
    )


def _sql_leaves(tree: str) -> str:
    return f"list_distinct(list_transform(flatten(flatten({tree})), lambda l: substr(l, 1, {LEAF_DIGITS})))"


def _sql_like(a: str, b: str) -> str:
    both = f"(len({a}) + len({b}))"
    return f"CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / {both} END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT *, length(text) AS n,
         coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d
), e AS (
  SELECT *, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited FROM n
), t AS (
  SELECT *, {_sql_tree("text")} AS tree, {_sql_tree("edited")} AS edited_tree, {_sql_tree("next_text")} AS next_tree FROM e
), l AS (
  SELECT *, {_sql_leaves("tree")} AS a, {_sql_leaves("edited_tree")} AS b, {_sql_leaves("next_tree")} AS c FROM t
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_sql_print("tree")} AS fingerprint,
       {_sql_print("edited_tree")} AS edited_fingerprint, {_sql_like("a", "b")} AS near_edited,
       {_sql_like("a", "c")} AS near_next
FROM l
"""
