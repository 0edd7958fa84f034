"""One query per operator of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, media, mixing, ngram_join, pii, quality, training_order, warc, wrapper
from .common import shared_dir, table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprint_column(media.wav_column(table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(5)) == 0
    model = language_id.Model(language_id.sample(docs.where(~held_out)))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_pseudonyms")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents")).drop("ok")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_media_columns, op2_warc, op3_training_order, op4_quality_rules, op5_html_main_text, op6_language_id, op7_ngram_jaccard, op8_pii_pseudonyms, op9_byte_bpe, op10_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
