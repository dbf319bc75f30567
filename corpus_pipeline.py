"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``: ``doc_id, text, lang, source,
n_chars``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefield.llm import common, langid, mixing, neardup, packing, repeats
from tracefield.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A repeated passage has at least so many bytes, whatever its words: a run of
#: more than 50 words that average under about four bytes can be shorter.
PASSAGE_BYTES = 256
#: A document needs a language that is at least so probable.
LEAST_SCORE = 0.5
#: Documents are near copies from this similarity of their word shingles on.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the training rows teach, under the
    language predicted; null, empty and letterless texts go.  Rows may repeat
    an id or have none; an empty table gives an empty one."""
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.predict(docs.select(*COLUMNS), model)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: the one with the least id, a
    null id last, and of rows that share it one by the hash of its text.  Rows
    are told apart by a number of their own, so what repeats an id or has none
    is judged by its text; a text without words is its own class."""
    numbered = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"), F.xxhash64("text", "lang", "source", "n_chars").alias("mark"))
    rows = common.stage_table(numbered, "pipeline-rows")
    classes = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    classes = classes.select(F.col("doc_id").alias("row"), F.col("component_id").alias("class"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "row").alias("order")
    first = classes.join(rows.select("row", order), "row").groupBy("class").agg(F.min("order").alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def ids_repeat(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occur more than once, then characters that a cut
    through their bytes left broken.  A document that is cut empty stays, as
    an empty text."""
    common.session(docs)
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(common.NULL_KEY)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    spans = repeats.repeated_spans(repeats.keyed(docs), PASSAGE_BYTES)
    return repeats.cut_texts(repeats.with_spans(rows, spans)).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut documents to the words the mix takes of each: whole
    copies, and for the rest the document's first words.  Nothing is taken of a
    null, empty or blank text, so it goes; rows without an id, or with a
    repeated one, are documents of their own; a null source is a source."""
    keys = ["doc_id", "mark", "copy_no"]
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).alias("mark"))
    taken = mixing.mix(rows, carry=("mark",)).select("doc_id", "mark", "size", "taken")
    if ids_repeat(docs):
        alike = Window.partitionBy("doc_id", "mark")
        taken = taken.withColumn("copy_no", F.row_number().over(alike.orderBy(F.desc("taken"))))
        rows = rows.withColumn("copy_no", F.row_number().over(alike.orderBy("lang", "n_chars")))
    else:
        taken, rows = taken.withColumn("copy_no", F.lit(1)), rows.withColumn("copy_no", F.lit(1))
    taken = taken.filter("taken > 0").select(*[F.col(k).alias(f"of_{k}") for k in keys], "size", "taken")
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))
    parts = (
        rows.join(taken, reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]))
        .withColumn("copy", F.explode(copies))
        .withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size")))
    )
    return parts.withColumn("text", mixing.first_words(F.col("text"), F.col("words"), F.col("size"))).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 4096 tokens.  Every row is packed, a
    null or empty text as its end id alone; rows may repeat an id or have
    none."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Not expressible in SQL; the tests hold each stage against a brute-force
#: version or, for packing, an exact account of all ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``.  A stage's own tables
    and its input are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, last = common.staged_so_far(), docs
        docs = common.stage_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        common.drop_staged_since(spark, before, docs)
        common.drop_staged(last)
    return STAGES[-1][1](spark, docs, sf_dir)
