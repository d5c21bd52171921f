"""A corpus pipeline: quality rules, SimHash near-dedup, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findloom.llm import packing, pii, quality, simhash
from findloom.sources.storage import new_folder, spread


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the others go.

    A null or empty text fails the rules. Ids, repeated or null, play no part,
    repeated rows stay or go together, whatever other columns there are pass
    through untouched, and an empty table gives an empty one.
    """
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Null texts count as empty, and all texts without words are one group. The
    row with the smallest id stays (null ids come last; then the smallest hash
    of the row), so unlike texts under one id, or without ids, all stay, and of
    rows equal in every column one stays. Other columns pass through, also with
    names used inside; an empty table gives an empty one.
    """
    groups = simhash.similar_groups(docs, words=5, min_similarity=0.8)
    return simhash.keep_one_of_each(docs, groups)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the personal data in its text masked and its length counted anew.

    A null text stays null, and so does its length; every row stays, whatever
    its id; other columns pass through; an empty table gives an empty one.
    """
    return pii.redact(docs, pii.train(docs), length_col="n_chars")


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in token-budget batches of its length bucket.

    A null or empty text has length 0 and a place like any other; rows with
    equal id and length may swap places; columns other than the id and the text
    are not read; an empty table gives an empty one.
    """
    return packing.pack(docs, packing.word_count(docs["text"]))


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_dedup", distinct_documents),
    ("pii", masked_documents),
    ("packing", packed_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again.

    The folder is the caller's to clear: the result is read from it.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
