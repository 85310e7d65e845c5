"""Queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldspark.llm import ann, bpe, collocations, importance_resampling, kneser_ney, language_codes, mixing, mpeg_audio, near_duplicates, pii_crf, quality_gam, repair_shards, toxicity_crf
from foldspark.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary file; ``FOLDSPARK_TOKENIZER`` names another one."""
    if named := os.environ.get("FOLDSPARK_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.per_document(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_shards.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.held_out_languages(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"), order=3)


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.per_document(table(spark, sf_dir, "documents"))


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_crf.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.digests(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


def op12_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_search": op1_graph_search,
    "op2_bpe": op2_bpe,
    "op3_mix": op3_mix,
    "op4_token_shards": op4_token_shards,
    "op5_language_codes": op5_language_codes,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_quality_gam": op7_quality_gam,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity_crf": op9_toxicity_crf,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_collocations": op11_collocations,
    "op12_pii_crf": op12_pii_crf,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {"op3_mix": mixing.ORACLE, "op11_collocations": collocations.ORACLE, "op13_importance_resampling": importance_resampling.ORACLE}
