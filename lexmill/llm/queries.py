"""The subpackage's queries: name -> (spark, sf_dir) -> DataFrame, each over its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import document_classes

    return document_classes(table(spark, sf_dir, "documents"))


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_decisions

    return line_decisions(table(spark, sf_dir, "documents"))


def op4_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_plan

    return shard_plan(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"))


def op6_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import token_records

    return token_records(table(spark, sf_dir, "documents"))


def op8_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .anomalies import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill_digests

    return infill_digests(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_entropy_mixing": op2_entropy_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_shuffle_shards": op4_shuffle_shards,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_audio_media": op6_audio_media,
    "op7_token_records": op7_token_records,
    "op8_secret_owners": op8_secret_owners,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_quality_forest": op11_quality_forest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The others: their results hang on a generator (4), an iteration (2), a trained model (10, 11), a tokenizer (7) or spectra (6).
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": oracles.NEAR_DEDUP,
    "op3_line_dedup": oracles.LINE_DEDUP,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_secret_owners": oracles.SECRET_OWNERS,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op12_fill_in_middle": oracles.INFILL,
    "op13_spelling_variants": oracles.SPELLING,
}
