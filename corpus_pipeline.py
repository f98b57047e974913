"""A corpus pipeline of five stages over the training-data operators.

Quality rules, exact dedup, near dedup, mixing, tokenising: each stage works on
all that its predecessor kept and is written as Parquet before the next reads it.

Edge cases: null and empty texts fail the quality rules; repeated rows and rows
without an id pass or go by their texts, and of equal or near texts one row
stays; a very long text is a document like others; an empty table passes
through all stages; all stages but the last return the columns of the input,
whatever their names, with the text and its count of characters as the quality
stage cleaned them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_bpe
from cohortlens.llm.common import dealt_evenly, new_path, table, working_tables
from cohortlens.llm.queries import model_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return quality.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked at 0.8 of five-word shingles stays."""
    return ngram_join.representatives(dealt_evenly(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text."""
    return sentencepiece_bpe.encoded(dealt_evenly(docs), model_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", source_mix),
    ("SentencePiece", token_ids),
]

#: The later stages (near copies, the mix, pieces) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's working tables are deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with working_tables(spark):
            path = new_path(spark, name.replace(" ", "-"))
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
