"""A corpus pipeline: quality rules, near-duplicate removal, pseudonyms, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpulse.llm import bpe, mixing, ngram_join, pii, quality
from sparkpulse.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and don't diverge from every language's reference.

    Null and empty texts, and texts of under ten words, go; equal rows are judged alike and all stay or go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 connect: that with the smallest id (null last).

    Of rows that repeat that id the one with the smallest hash stays, of wholly equal rows one.  Documents without words (null
    and empty texts) link with nothing and all stay."""
    return ngram_join.representatives(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, validated numbers, dates and addresses replaced; null and empty texts stay as they are."""
    return with_chars(pii.pseudonymise(docs), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: documents as often, and as much of them, as it takes.

    Texts without words (null and empty ones) have nothing to take and go; equal rows count as documents of their own."""
    return with_chars(mixing.mixed_documents(docs), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 16-bit) of each row's text; a null text has none."""
    return bpe.encode_column(docs, keep=["doc_id", "source"], dtype="<u2")


def with_chars(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where there is one, made to fit the text again."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixing", mixed), ("byte_bpe", token_ids)]
#: SQL can't express the similarity join, the keyed permutations or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
