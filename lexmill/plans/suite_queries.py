"""Queries on whole suites: orders as tasks, their lines as evidence and claims, suppliers as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import suites as S
from lexmill.plans.catalog import query
from lexmill.plans.relations import table

_FAMILIES, _LANGUAGES = ("partial", "conflicting", "freshness", "fact"), ("1", "2", "3", "4")
_METRICS = (*S.RETRIEVAL, *S.ANSWER, *S.UNANSWERABLE)


def _value(i: int) -> str:
    """A metric as an expression that both engines read: every seventh task lacks every third metric."""
    plain = f"((o_orderkey * {2 * i + 3}) % 127) / 128e0"
    return f"CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {plain} END" if i % 3 == 0 else plain


_GROUP = "concat('c', CAST(o_orderkey % 3 AS VARCHAR(9)))"


def _mean(x: str) -> str:
    return f"round(coalesce(avg({x}), 0e0), 6)"


@query(
    "WITH s AS (SELECT " + _GROUP + " AS config, o_orderkey % 3 = 2 OR o_orderkey % 5 = 0 AS unanswerable, o_totalprice AS latency, " + ", ".join(f"{_value(i)} AS {m}" for i, m in enumerate(_METRICS)) + " FROM orders) "
    "SELECT config, count(*) AS tasks, "
    + ", ".join(f"CASE WHEN count(*) FILTER (NOT unanswerable) > 0 THEN {_mean(f'CASE WHEN NOT unanswerable THEN {m} END')} ELSE {_mean(m)} END AS {m}" for m in S.RETRIEVAL)
    + ", " + ", ".join(f"{_mean(m)} AS {m}" for m in S.ANSWER) + ", " + ", ".join(f"{_mean(f'CASE WHEN unanswerable THEN {m} END')} AS {m}" for m in S.UNANSWERABLE)
    + ", quantile_disc(latency, 0.5) AS latency_p50, quantile_disc(latency, 0.95) AS latency_p95 FROM s GROUP BY config"
)
def g_score_rollup(spark, sf_dir):
    """One configuration has no answerable task."""
    s = table(spark, sf_dir, "orders").selectExpr(
        f"{_GROUP} AS config", "o_orderkey % 3 = 2 OR o_orderkey % 5 = 0 AS unanswerable", "o_totalprice AS latency", *(f"{_value(i)} AS {m}" for i, m in enumerate(_METRICS))
    )
    return S.score_rollup(s, ["config"])


_SUITE = (
    "tk AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS task_id, CASE WHEN o_orderkey % 50 = 0 THEN 'v0' ELSE 'v1' END AS schema, "
    "CASE o_orderkey % 6 WHEN 0 THEN 'partial' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'freshness' WHEN 3 THEN 'other' WHEN 4 THEN 'fact' END AS family, substr(o_orderpriority, 1, 1) AS language, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN 'answer' END AS outcome, CASE WHEN o_orderkey % 13 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN o_orderkey % 17 = 0 THEN FALSE WHEN o_orderkey % 19 <> 0 THEN TRUE END AS reviewed, "
    "[o_custkey % 100 + 1, o_custkey % 90 + 2] AS sources, [o_custkey % 100 + 1] AS required, [CASE WHEN o_orderkey % 23 = 0 THEN o_custkey % 100 + 1 WHEN o_orderkey % 29 = 0 THEN 999999 ELSE o_custkey % 90 + 2 END] AS forbidden, "
    "[o_custkey % 90 + 2, CASE WHEN o_orderkey % 31 = 0 THEN 5 ELSE o_custkey % 100 + 1 END] AS scope, o_orderkey % 3 AS scope_count FROM orders), "
    "ev AS (SELECT l_orderkey AS task_id, l_orderkey * 10 + CASE WHEN l_partkey % 37 = 0 THEN 1 ELSE l_linenumber END AS evidence_id, CASE WHEN l_partkey % 41 = 0 THEN 888888 WHEN l_partkey % 43 <> 0 THEN l_suppkey END AS source_id, "
    "CASE WHEN l_partkey % 47 = 0 THEN 'x' ELSE sha256(CAST(l_suppkey AS VARCHAR)) END AS sha256, l_linenumber AS start, CAST(l_quantity AS BIGINT) AS \"end\", CASE l_partkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'table' ELSE 'text' END AS locator, "
    "CASE WHEN l_partkey % 2 = 0 THEN 1 END AS page, CASE WHEN l_partkey % 5 <> 0 THEN 'c' END AS cell FROM lineitem), "
    "cl AS (SELECT l_orderkey AS task_id, CASE WHEN l_partkey % 53 = 0 THEN 7 ELSE l_orderkey END AS claim_id, CASE WHEN l_partkey % 59 = 0 THEN -1 ELSE l_orderkey * 10 + l_linenumber END AS evidence_id FROM lineitem), "
    "so AS (SELECT s_suppkey AS source_id, sha256(CAST(s_suppkey AS VARCHAR)) AS sha256 FROM supplier)"
)
_SCOPED = "family IN ('partial', 'conflicting', 'freshness', 'not_found_in_scope')"


@query(
    f"WITH {_SUITE} SELECT task_id, 'SCHEMA_VERSION_INVALID' AS code FROM tk WHERE schema <> 'v1' UNION SELECT task_id, 'FAMILY_INVALID' FROM tk WHERE family IS NULL OR family NOT IN {_FAMILIES} "
    f"UNION SELECT task_id, 'LANGUAGE_INVALID' FROM tk WHERE language NOT IN {_LANGUAGES} UNION SELECT task_id, 'OUTCOME_MISSING' FROM tk WHERE outcome IS NULL UNION SELECT task_id, 'SPLIT_INVALID' FROM tk WHERE split NOT IN ('dev', 'test') "
    "UNION SELECT task_id, 'REVIEW_MISSING' FROM tk WHERE NOT coalesce(reviewed, FALSE) UNION SELECT task_id, 'SOURCE_SCOPE_OVERLAP' FROM tk WHERE list_has_any(required, forbidden) "
    "UNION SELECT task_id, 'SOURCE_SCOPE_INVALID' FROM tk WHERE NOT list_has_all(sources, list_concat(required, forbidden)) "
    f"UNION SELECT task_id, 'SCOPE_REVIEW_INCOMPLETE' FROM tk WHERE {_SCOPED} AND NOT (list_has_all(sources, scope) AND list_has_all(scope, sources)) UNION SELECT task_id, 'SCOPE_REVIEW_COUNT_INVALID' FROM tk WHERE {_SCOPED} AND scope_count <> len(list_distinct(sources)) "
    "UNION SELECT task_id, 'TASK_ID_DUPLICATE' FROM tk GROUP BY task_id HAVING count(*) > 1 UNION SELECT task_id, 'SOURCE_ID_UNKNOWN' FROM (SELECT task_id, unnest(list_concat(sources, required, forbidden)) AS s FROM tk) WHERE s NOT IN (SELECT source_id FROM so) "
    "UNION SELECT task_id, 'EVIDENCE_RANGE_INVALID' FROM ev WHERE \"end\" < start UNION SELECT task_id, 'EVIDENCE_PAGE_MISSING' FROM ev WHERE locator = 'page' AND page IS NULL UNION SELECT task_id, 'EVIDENCE_TABLE_LOCATOR_MISSING' FROM ev WHERE locator = 'table' AND cell IS NULL "
    "UNION SELECT task_id, 'EVIDENCE_ID_DUPLICATE' FROM ev WHERE evidence_id IN (SELECT evidence_id FROM ev GROUP BY evidence_id HAVING count(*) > 1) UNION SELECT task_id, 'EVIDENCE_SOURCE_UNKNOWN' FROM ev WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM so) "
    "UNION SELECT ev.task_id, 'EVIDENCE_SOURCE_HASH_MISMATCH' FROM ev JOIN so USING (source_id) WHERE ev.sha256 <> so.sha256 UNION SELECT task_id, 'CLAIM_ID_DUPLICATE' FROM cl WHERE claim_id IN (SELECT claim_id FROM cl GROUP BY claim_id HAVING count(DISTINCT task_id) > 1) "
    "UNION SELECT task_id, 'CLAIM_EVIDENCE_MISSING' FROM cl WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.task_id = cl.task_id AND ev.evidence_id = cl.evidence_id)"
)
def m_suite_checks(spark, sf_dir):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_partkey")
    family = F.when(k % 6 == 0, "partial").when(k % 6 == 1, "conflicting").when(k % 6 == 2, "freshness").when(k % 6 == 3, "other").when(k % 6 == 4, "fact")
    tasks = table(spark, sf_dir, "orders").select(
        F.when(k % 97 == 0, k - 1).otherwise(k).alias("task_id"), F.when(k % 50 == 0, "v0").otherwise("v1").alias("schema"), family.alias("family"), F.substring("o_orderpriority", 1, 1).alias("language"),
        F.when(k % 11 != 0, "answer").alias("outcome"), F.when(k % 13 == 0, "train").otherwise("test").alias("split"), F.when(k % 17 == 0, False).when(k % 19 != 0, True).alias("reviewed"),
        F.array(c % 100 + 1, c % 90 + 2).alias("sources"), F.array(c % 100 + 1).alias("required"), F.array(F.when(k % 23 == 0, c % 100 + 1).when(k % 29 == 0, 999999).otherwise(c % 90 + 2)).alias("forbidden"),
        F.array(c % 90 + 2, F.when(k % 31 == 0, 5).otherwise(c % 100 + 1)).alias("scope"), (k % 3).alias("scope_count"),
    )
    line = table(spark, sf_dir, "lineitem")
    sha = lambda x: F.sha2(x.cast("string"), 256)
    evidence = line.select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 10 + F.when(p % 37 == 0, 1).otherwise(F.col("l_linenumber"))).alias("evidence_id"),
        F.when(p % 41 == 0, 888888).when(p % 43 != 0, F.col("l_suppkey")).alias("source_id"), F.when(p % 47 == 0, "x").otherwise(sha(F.col("l_suppkey"))).alias("sha256"),
        F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("long").alias("end"), F.when(p % 3 == 0, "page").when(p % 3 == 1, "table").otherwise("text").alias("locator"),
        F.when(p % 2 == 0, 1).alias("page"), F.when(p % 5 != 0, "c").alias("cell"),
    )
    claims = line.select(
        F.col("l_orderkey").alias("task_id"), F.when(p % 53 == 0, 7).otherwise(F.col("l_orderkey")).alias("claim_id"),
        F.when(p % 59 == 0, -1).otherwise(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"),
    )
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), sha(F.col("s_suppkey")).alias("sha256"))
    return S.suite_violations(tasks, evidence, claims, sources, list(_FAMILIES), list(_LANGUAGES), "v1")
