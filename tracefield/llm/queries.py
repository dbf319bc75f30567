"""The contract queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, common, filteraudit, hmm, langid, media, merkle, mixing, neardup, packing, repeats, resample, sitetree, warc


def tokenizer_path() -> str:
    """The vocabulary file the packing and token-id queries name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_read(spark, sf_dir, "pages"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "media")
    media.write_archives(_read(spark, sf_dir, "documents"), folder)
    return media.features(media.read_archives(spark, folder))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", text.alias("text"))


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "planes")
    bitplanes.write_ids(_read(spark, sf_dir, "documents"), folder, tokenizer_path())
    return bitplanes.read_ids(spark, folder)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(_read(spark, sf_dir, "documents"))


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), folder)
    found = warc.records(warc.read_chunks(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_corpus(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_site_style_tree,
        op3_ppm_language,
        op4_ordered_packing,
        op5_media_columns,
        op6_repeated_passages,
        op7_token_planes,
        op8_source_mix,
        op9_merkle_fingerprint,
        op10_warc_chunks,
        op11_filter_audit,
        op12_importance_resampling,
        op13_hidden_markov,
    )
}

ORACLES = {
    "op8_source_mix": mixing.ORACLE,
    "op9_merkle_fingerprint": merkle.ORACLE,
    "op10_warc_chunks": warc.ORACLE,
    "op11_filter_audit": filteraudit.ORACLE,
}
