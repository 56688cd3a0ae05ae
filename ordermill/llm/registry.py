"""Registered queries of this folder, each over whole tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordermill.llm import (
    chat_pairs,
    conversation_repair,
    decontamination,
    lm_ppm,
    merkle,
    near_dup,
    packing,
    part_enum,
    quality,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from ordermill.llm.inputs import prepare, table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the distances stay out: their last digits depend on the order of summation
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "word_distance")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs.stale_answer_pairs(table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ppm.score(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.similar_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES: dict[str, Query] = {
    name: _prepared(query)
    for name, query in {
        "op1_token_counts": op1_token_counts,
        "op2_url_filter": op2_url_filter,
        "op3_warc": op3_warc,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_preference_pairs": op7_preference_pairs,
        "op8_decontamination": op8_decontamination,
        "op9_lm_scores": op9_lm_scores,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_ngram_join": op12_ngram_join,
        "op13_conversation_repair": op13_conversation_repair,
    }.items()
}
ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_quality": quality.ORACLE_SQL,
    "op7_preference_pairs": chat_pairs.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
    "op10_near_duplicates": near_dup.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_ngram_join": part_enum.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
