"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the keys are cut into
ranges by their leading hexadecimal digits, the ranges' token counts are
prefix-summed, and each range is prefix-summed on its own: together a
distributed prefix sum, in which a source that holds a third of all rows is
spread over many tasks.  The mix takes whole epochs of a source and then the
prefix of one more epoch, cut at the source's exact budget.

Only DataFrame functions run here; texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets per source from ``(src, src_null, source_size)``.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes.  A target stops at ``cap`` times the source's size
    and the excess is reshared by weight: with sources ordered by cap/weight
    those that stop are a prefix, so two running sums settle it.
    """
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy("src_null", "src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    before = Window.orderBy("ratio", "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    given = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("limit_before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn(
            "full",
            F.col("ratio") * (F.col("all_weight") - F.col("weight_before")) <= F.col("budget") - F.col("limit_before"),
        )
    )
    left = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0)))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return given.withColumn("left", left).withColumn("open_weight", open_weight).select(
        "src",
        "src_null",
        "source_size",
        F.when(F.col("full"), F.col("limit"))
        .otherwise(F.col("weight") * F.col("left") / F.col("open_weight"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    range_rows: int = 2000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words the mix takes of every document.

    ``docs`` needs ``doc_id, text, source``; other columns are ignored,
    whatever their names.  Returns one row per input row: ``doc_id, source,
    size, source_size, target, taken``.  Size is the number of words; a null,
    empty or blank text has size 0 and nothing is taken of it.  A null source
    is a source of its own, ordered last.  Rows with the same ``doc_id`` are
    separate documents; rows alike in id and size are interchangeable, so
    reruns agree.  Rows without an id are keyed by their texts.  An empty table gives an empty result.  ``range_rows`` sets
    how finely keys are cut, never which rows count; columns named in
    ``carry`` come along behind the others.
    """
    spark = common.session(docs)
    text_mark = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = common.stage_table(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("src_null"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), text_mark), F.lit(":" + seed)).cast("binary")).alias("key"),
            *carry,
        ),
        "mix-sizes",
    )
    rows = sized.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / range_rows, 16))) if rows > range_rows else 1
    sized = sized.withColumn("cut", F.substring("key", 1, digits))
    ranges = sized.groupBy("src_null", "src", "cut").agg(F.sum("size").alias("range_size"))
    ranges = common.stage_table(ranges, "mix-ranges")
    # ranges are prefix-summed within heads, and heads within the source: each
    # window sees about the square root of the source's ranges
    ranges = ranges.withColumn("head", F.substring("cut", 1, max(1, digits // 2)))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before_all = lambda size, window: F.coalesce(F.sum(size).over(window), F.lit(0))
    heads = ranges.groupBy("src_null", "src", "head").agg(F.sum("range_size").alias("head_size"))
    heads = heads.withColumn("head_offset", before_all("head_size", earlier(("src_null", "src"), "head")))
    offsets = (
        ranges.withColumn("in_head", before_all("range_size", earlier(("src_null", "src", "head"), "cut")))
        .join(heads, ["src_null", "src", "head"])
        .withColumn("offset", F.col("head_offset") + F.col("in_head"))
        .drop("head", "head_size", "head_offset", "in_head")
    )
    totals = ranges.groupBy("src_null", "src").agg(F.sum("range_size").alias("source_size"))
    placed = offsets.join(source_targets(totals, weights, share, cap), ["src_null", "src"])
    within = (
        Window.partitionBy("src_null", "src", "cut")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    budget = F.floor(F.col("target") + 0.5).cast("long")
    size, source_size = F.col("size"), F.col("source_size")
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("long")
    rest = budget - epochs * source_size
    before = F.col("offset") + F.col("running") - size
    return (
        sized.withColumn("running", F.sum("size").over(within))
        .join(placed, ["src_null", "src", "cut"])
        .select(
            "doc_id",
            F.when(~F.col("src_null"), F.col("src")).alias("source"),
            size.alias("size"),
            source_size.alias("source_size"),
            F.col("target"),
            (epochs * size + F.greatest(F.lit(0), F.least(size, rest - before))).cast("long").alias("taken"),
            *carry,
        )
    )


def first_words(text: Column, words: Column, size: Column) -> Column:
    """The text up to the end of its first ``words`` words; all of it if those
    are all ``size``."""
    parts = F.slice(F.regexp_extract_all(text, F.lit(WORD + r"|[\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words * 2)
    # the parts alternate; a leading gap shifts the last word by one
    lead = F.when(F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")), words * 2).otherwise(words * 2 - 1)
    return F.when(words >= size, text).otherwise(F.array_join(F.slice(parts, F.lit(1), lead), ""))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':mix') AS key
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM s GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight
  FROM t
), f AS (
  SELECT *, coalesce(sum(lim) OVER o, 0) AS lim_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, ratio * (all_weight - weight_before) <= budget - lim_before AS is_full FROM f
), h AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN lim
              ELSE weight * (budget - coalesce(sum(lim) FILTER (is_full) OVER (), 0))
                   / (sum(weight) FILTER (NOT is_full) OVER ()) END AS target
  FROM g
), p AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, floor(h.target + 0.5)::BIGINT AS words,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                            ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (words // source_size) * size
                 + greatest(0, least(size, words % source_size - before)) END::BIGINT AS taken
FROM p
"""
