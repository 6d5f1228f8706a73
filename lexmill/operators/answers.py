"""Answerability, citations and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def query_parts(query: Column, most: int = 6) -> Column:
    """A query cut at question marks, semicolons and 'vs'; parts without significant terms go. One part: the whole query."""
    flat = F.trim(F.regexp_replace(query, T.SPACE, " "))
    parts = F.filter(F.transform(F.split(flat, r"(?i)\?|;|\bvs\b|\bversus\b"), lambda p: F.btrim(p, F.lit(" ?!."))), lambda p: F.size(T.significant_terms(p)) > 0)
    return F.when(F.size(parts) <= 1, F.array(flat)).otherwise(F.slice(parts, 1, most))


def rank_confidence(ranks: dict[str, Column]) -> Column:
    """1 - (rank - 1) / scale of the first lane that has a rank."""
    scales = {"rerank": 20.0, "fusion": 30.0, "dense": 50.0, "bm25": 50.0}  # fixed values
    found = [F.when(ranks[k] >= 1, F.greatest(F.lit(0.0), 1 - (ranks[k] - 1) / s)) for k, s in scales.items() if k in ranks]
    return F.round(F.coalesce(*found, F.lit(0.0)), 6)


def conflicts(evidence: DataFrame) -> DataFrame:
    """evidence(query_id, doc_id, text) -> query_id, conflict: a document's values share none with those of the first one that has any."""
    v = evidence.select("query_id", "doc_id", F.explode(T.values(F.col("text"))).alias("value")).distinct()
    first = v.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    base = v.join(first, ["query_id", "doc_id"]).select("query_id", "value", F.lit(True).alias("shared"))
    others = v.join(first.withColumnRenamed("doc_id", "first_id"), "query_id").where("doc_id <> first_id")
    per = others.join(base, ["query_id", "value"], "left").groupBy("query_id", "doc_id").agg(F.coalesce(F.bool_or("shared"), F.lit(False)).alias("agrees"))
    found = per.groupBy("query_id").agg(F.bool_or(~F.col("agrees")).alias("conflict"))
    return evidence.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def citations(answer: Column, allowed: Column) -> Column:
    """struct(cited, unknown) of [S1]-like marks: how many different ones there are, and how many the evidence lacks."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1)))
    return F.struct(F.size(cited).cast("long").alias("cited"), F.size(F.array_except(cited, allowed)).cast("long").alias("unknown"))


def claim_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims(claim_id, text, evidence_ids), evidence(evidence_id, text) -> claim_id, status, confidence."""
    links = claims.select("claim_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")).join(evidence, "evidence_id")
    terms = F.array_distinct(F.filter(T.tokens(F.col("c.text")), lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\p{N}+$")))
    parts = links.join(claims.alias("c"), "claim_id").select("claim_id", terms.alias("terms"), T.normalize(links["text"]).alias("body"))
    hits = parts.select("claim_id", F.explode(F.filter("terms", lambda w: F.contains(F.col("body"), w))).alias("term")).distinct()
    hits = hits.groupBy("claim_id").agg(F.count("*").alias("hits"))
    known = links.select("claim_id").distinct().withColumn("known", F.lit(True))
    rows = claims.alias("c").select("claim_id", F.size(terms).alias("n")).join(known, "claim_id", "left").join(hits, "claim_id", "left")
    n, h = F.col("n"), F.coalesce("hits", F.lit(0))
    status = F.when(F.col("known").isNull(), "unsupported").when((n == 0) | (h >= F.greatest(F.lit(1), F.least(F.lit(3), n))), "supported").when(h > 0, "partially_supported").otherwise("unsupported")
    sure = F.when(F.col("known").isNull(), 0.9).when(status == "supported", 0.75).when(status == "partially_supported", 0.45).otherwise(0.8)
    return rows.select("claim_id", status.alias("status"), sure.alias("confidence"))


def first_failure(checks: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The code of the first check that holds."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in checks), F.lit(otherwise).cast("string"))


def packed(rows: DataFrame, by: str, order: list, size: str, budget: int) -> DataFrame:
    """The longest prefix of each group, best first, whose sizes stay in the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
