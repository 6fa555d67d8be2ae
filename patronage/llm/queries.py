"""Registered queries of the corpus operators and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (centroid_clusters, chat_format, decontaminate, embedding_dedup, importance_resample, line_quality,
               minhash_dedup, quality_classifier, sentencepiece_fst, source_mix, sql, suffix_dedup, template_extract,
               wordpiece_count)
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classify(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_wordpiece_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_count.counts(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.plan(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.formatted(chat_format.as_parts(turns.unionByName(more))))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classify(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.digest(table(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extract.extract(table(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_wordpiece_count": op3_wordpiece_count,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_source_mix": op5_source_mix,
        "op6_chat_format": op6_chat_format,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_sentencepiece_fst": op8_sentencepiece_fst,
        "op9_line_quality": op9_line_quality,
        "op10_template_extract": op10_template_extract,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_decontaminate": op12_decontaminate,
        "op13_importance_resample": op13_importance_resample,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": sql.NEAR_DUPLICATES,
        "op4_suffix_dedup": sql.REPEATED_STRINGS,
        "op5_source_mix": source_mix.PLAN_SQL,
        "op6_chat_format": sql.chat_digest(),
        "op7_embedding_dedup": sql.VECTOR_LINKS,
        "op11_centroid_clusters": centroid_clusters.cluster_sql(),
        "op12_decontaminate": decontaminate.DIGEST_SQL,
        "op13_importance_resample": importance_resample.SCORE_SQL,
    }
