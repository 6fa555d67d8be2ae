"""Training-data pipeline over ``documents``: reject, deduplicate, mix, tokenise.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents. ``n_chars`` follows
the text where a stage changes it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import minhash_dedup, quality_classifier, sentencepiece_fst, source_mix, suffix_dedup
from patronage.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.keep_one(docs, shingle_words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 200 bytes or more that occur more than once."""
    return _counted(suffix_dedup.without_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for every copy taken, so a doc_id may repeat."""
    return _counted(source_mix.mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies as piece ids in place of their text."""
    return sentencepiece_fst.encoded(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("source_mix", mix),
    ("sentencepiece", tokens),
]

#: No SQL expresses the trained classifier or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
