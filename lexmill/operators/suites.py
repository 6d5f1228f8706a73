"""Whole suites of tasks: every check of their parts as rows, and every metric of a configuration in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RETRIEVAL = (
    "page_recall_at_1", "page_recall_at_5", "page_recall_at_10", "page_recall_at_20", "document_recall_at_1", "document_recall_at_5", "document_recall_at_10",
    "document_mrr_at_10", "document_ndcg_at_10", "section_recall_at_5", "section_recall_at_10", "section_recall_at_20", "chunk_recall_at_5", "chunk_recall_at_10",
    "chunk_recall_at_20", "mrr_at_10", "ndcg_at_10", "full_hop_recall", "path_completion", "reranker_gold_delta",
)
ANSWER = (
    "exact_match", "token_f1", "rouge_l", "citation_precision", "citation_recall", "document_citation_precision", "document_citation_recall", "unsupported_claim_rate",
    "cited_hard_negative_rate", "model_calls", "tokens",
)
UNANSWERABLE = ("unanswerable_accuracy", "soft_unanswerable_context_rate")


def score_rollup(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores(by, unanswerable, latency, metrics) -> one row per group: the mean of every metric, 0 where no task has it.

    Retrieval metrics are over answerable tasks, or over all of a group that has none; answer metrics over all; the last two over
    unanswerable tasks. latency_p50 and latency_p95 are values at nearest ranks.
    """
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    own = F.count_if(~F.col("unanswerable")) > 0
    return scores.groupBy(*by).agg(
        F.count("*").alias("tasks"),
        *(F.when(own, mean(F.when(~F.col("unanswerable"), F.col(m)))).otherwise(mean(F.col(m))).alias(m) for m in RETRIEVAL),
        *(mean(F.col(m)).alias(m) for m in ANSWER),
        *(mean(F.when(F.col("unanswerable"), F.col(m))).alias(m) for m in UNANSWERABLE),
        *(F.expr(f"percentile_disc({p / 100}) within group (order by latency)").alias(f"latency_p{p}") for p in (50, 95)),
    )


def _coded(rows: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    codes = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in checks)))
    return rows.select(F.col(key).alias("task_id"), F.explode(codes).alias("code"))


def _repeated(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Tasks whose key another row has too."""
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return rows.join(again, key, "left_semi").select("task_id", F.lit(code).alias("code"))


def suite_violations(tasks: DataFrame, evidence: DataFrame, claims: DataFrame, sources: DataFrame, families: list[str], languages: list[str], schema: str) -> DataFrame:
    """What is wrong with a suite: (task_id, code), each once.

    tasks(task_id, schema, family, language, outcome, split, reviewed, sources, required, forbidden, scope, scope_count), the last but one arrays of ids;
    evidence(task_id, evidence_id, source_id, sha256, start, end, locator, page, cell), claims(task_id, claim_id, evidence_id), sources(source_id, sha256).
    Nulls fail where something must be stated, and pass elsewhere.
    """
    c = F.col
    reviewed = c("family").isin("partial", "conflicting", "not_found_in_scope", "freshness")
    out = _coded(tasks, "task_id", [
        ("SCHEMA_VERSION_INVALID", ~c("schema").eqNullSafe(schema)), ("FAMILY_INVALID", ~F.coalesce(c("family").isin(*families), F.lit(False))),
        ("LANGUAGE_INVALID", ~F.coalesce(c("language").isin(*languages), F.lit(False))), ("OUTCOME_MISSING", c("outcome").isNull()), ("SPLIT_INVALID", ~F.coalesce(c("split").isin("dev", "test"), F.lit(False))),
        ("REVIEW_MISSING", ~F.coalesce(c("reviewed"), F.lit(False))), ("SOURCE_SCOPE_OVERLAP", F.arrays_overlap("required", "forbidden")),
        ("SOURCE_SCOPE_INVALID", F.size(F.array_except(F.array_union("required", "forbidden"), "sources")) > 0),
        ("SCOPE_REVIEW_INCOMPLETE", reviewed & ((F.size(F.array_except("scope", "sources")) > 0) | (F.size(F.array_except("sources", "scope")) > 0))),
        ("SCOPE_REVIEW_COUNT_INVALID", reviewed & (c("scope_count") != F.size(F.array_distinct("sources")))),
    ])
    out = out.unionByName(_repeated(tasks.select("task_id"), "task_id", "TASK_ID_DUPLICATE"))
    named = tasks.select("task_id", F.explode(F.array_union("sources", F.array_union("required", "forbidden"))).alias("source_id"))
    out = out.unionByName(named.join(sources, "source_id", "left_anti").select("task_id", F.lit("SOURCE_ID_UNKNOWN").alias("code")))
    out = out.unionByName(_coded(evidence, "task_id", [
        ("EVIDENCE_RANGE_INVALID", c("end") < c("start")), ("EVIDENCE_PAGE_MISSING", (c("locator") == "page") & c("page").isNull()), ("EVIDENCE_TABLE_LOCATOR_MISSING", (c("locator") == "table") & c("cell").isNull()),
    ]))
    out = out.unionByName(_repeated(evidence.select("task_id", "evidence_id"), "evidence_id", "EVIDENCE_ID_DUPLICATE"))
    out = out.unionByName(evidence.where("source_id is not null").join(sources, "source_id", "left_anti").select("task_id", F.lit("EVIDENCE_SOURCE_UNKNOWN").alias("code")))
    hashed = evidence.select("task_id", "source_id", F.col("sha256").alias("claimed")).join(sources, "source_id").where(F.col("claimed") != F.col("sha256"))
    out = out.unionByName(hashed.select("task_id", F.lit("EVIDENCE_SOURCE_HASH_MISMATCH").alias("code")))
    own = claims.select("task_id", "claim_id").distinct().groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1").select("claim_id")
    out = out.unionByName(claims.join(own, "claim_id", "left_semi").select("task_id", F.lit("CLAIM_ID_DUPLICATE").alias("code")))
    lost = claims.where("evidence_id is not null").join(evidence, ["task_id", "evidence_id"], "left_anti")
    return out.unionByName(lost.select("task_id", F.lit("CLAIM_EVIDENCE_MISSING").alias("code"))).distinct()
