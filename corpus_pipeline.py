"""A training-data pipeline: every stage takes what the one before it kept, and its decisions take effect.

All stages but the last return the columns of documents. Null or letterless texts go in the first stage; empty tables pass through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import materialize, table
from lexmill.llm.decontaminate import keep_clean
from lexmill.llm.language_id import keep_identified
from lexmill.llm.mixing import mix
from lexmill.llm.near_dup import keep_one
from lexmill.llm.token_records import token_records


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model gives no language go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token records and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return token_records(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
