"""Test collections (topics, judgements, corpora), result files and the checked write of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.ranking import postings


def _columns(lines: DataFrame, separator: str, n: int) -> DataFrame:
    parts = F.split(F.trim("value"), separator, n if separator == "\t" else -1)
    wrong = F.raise_error(F.concat(F.lit(f"not {n} columns: "), F.col("value"))).cast("array<string>")
    return lines.where(F.trim("value") != "").select(F.when(F.size(parts) == n, parts).otherwise(wrong).alias("c"))


def topics(lines: DataFrame) -> DataFrame:
    """value: id, tab, query -> query_id, text."""
    return _columns(lines, "\t", 2).select(F.col("c")[0].alias("query_id"), F.trim(F.col("c")[1]).alias("text"))


def judgements(lines: DataFrame) -> DataFrame:
    """value: query, Q0, document, relevance -> query_id, doc_id, relevance; only relevant ones."""
    c = _columns(lines, r"\s+", 4)
    return c.select(F.col("c")[0].alias("query_id"), F.col("c")[2].alias("doc_id"), F.col("c")[3].cast("int").alias("relevance")).where("relevance > 0")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gzip or plain) of docid, title, text."""
    return spark.read.schema("docid string, title string, text string").option("mode", "FAILFAST").json(path).where("docid is not null")


def append_results(rows: DataFrame, path: str) -> None:
    """Typed rows as JSON lines; a job's files appear only when it commits."""
    rows.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_postings(chunks: DataFrame, path: str) -> DataFrame:
    """Writes the postings of chunks(chunk_id, content) sorted by term, and fails unless every chunk with a token is in them."""
    p = postings(chunks)
    p.repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)
    written = chunks.sparkSession.read.parquet(path)
    lost = postings(chunks).select("chunk_id").distinct().join(written.select("chunk_id").distinct(), "chunk_id", "left_anti").count()
    if lost:
        raise RuntimeError(f"{lost} chunks are not in the index at {path}")
    return written
