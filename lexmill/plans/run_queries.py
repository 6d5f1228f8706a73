"""Queries on research runs, context policies, stage events and what surrounds retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import ranking as R
from lexmill.operators import runs as U
from lexmill.plans.catalog import query
from lexmill.plans.relations import CHUNKS, DENSE, GOLD, chunks, dense, gold, lexical, lexical_sql, table

_HITS = f"{CHUNKS}, {lexical_sql()}"
_RUNS = (
    "runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'completed_partial' ELSE 'running' END AS status, o_custkey % 9 = 0 AS wants_conflict FROM orders), "
    "questions AS (SELECT l_orderkey AS run_id, l_orderkey * 10 + l_linenumber AS question_id, l_linenumber <= 2 AS required, CASE l_linestatus WHEN 'F' THEN 'done' ELSE 'pending' END AS state, "
    "CASE l_returnflag WHEN 'A' THEN 'covered' WHEN 'N' THEN 'partial' ELSE CASE WHEN l_suppkey % 4 = 0 THEN 'conflicting' ELSE 'missing' END END AS coverage FROM lineitem), "
    "evidence AS (SELECT l_orderkey AS run_id, l_partkey AS evidence_id, l_suppkey % 5 <> 0 AS visible, l_linenumber <= 3 AS wanted FROM lineitem), "
    "claims AS (SELECT l_orderkey AS run_id, CASE WHEN l_suppkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS evidence_id FROM lineitem)"
)


def _runs(spark, sf_dir):
    """Orders as runs, their lines as questions, evidence and claims."""
    s, l, k = F.col("o_orderstatus"), table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(s == "F", "completed").when(s == "P", "completed_partial").otherwise("running").alias("status"), (F.col("o_custkey") % 9 == 0).alias("wants_conflict")
    )
    f = F.col("l_returnflag")
    coverage = F.when(f == "A", "covered").when(f == "N", "partial").when(k % 4 == 0, "conflicting").otherwise("missing")
    questions = l.select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"), (F.col("l_linenumber") <= 2).alias("required"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("state"), coverage.alias("coverage"),
    )
    evidence = l.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("evidence_id"), (k % 5 != 0).alias("visible"), (F.col("l_linenumber") <= 3).alias("wanted"))
    claims = l.select(F.col("l_orderkey").alias("run_id"), F.when(k % 7 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("evidence_id"))
    return runs, questions, evidence, claims


@query(
    f"WITH {_RUNS}, q AS (SELECT run_id, count(*) AS total, count(*) FILTER (coverage = 'covered') AS covered, count(*) FILTER (coverage = 'partial') AS part, count(*) FILTER (coverage = 'conflicting') AS conflicting, count(*) FILTER (required AND state <> 'done') AS open_required FROM questions GROUP BY run_id), "
    "e AS (SELECT run_id, count(*) FILTER (wanted) AS wanted, count(*) FILTER (wanted AND visible) AS found FROM evidence GROUP BY run_id), "
    "c AS (SELECT run_id, count(*) AS unsupported FROM claims c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.run_id = c.run_id AND e.evidence_id = c.evidence_id AND e.visible) GROUP BY run_id), "
    "j AS (SELECT run_id, status, wants_conflict, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, coalesce(part, 0) AS part, coalesce(conflicting, 0) AS conflicting, coalesce(open_required, 0) AS open_required, coalesce(unsupported, 0) AS unsupported, "
    "CASE WHEN coalesce(wanted, 0) = 0 THEN 1.0::DOUBLE ELSE found / wanted END AS recall FROM runs LEFT JOIN q USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN c USING (run_id)), "
    "k AS (SELECT *, concat_ws(',', CASE WHEN starts_with(status, 'completed') AND open_required > 0 THEN 'required_open' END, CASE WHEN recall < 1 THEN 'evidence_missing' END, CASE WHEN covered + part < 1 THEN 'coverage_low' END, "
    "CASE WHEN wants_conflict AND conflicting = 0 THEN 'conflict_unseen' END, CASE WHEN unsupported > 0 THEN 'unsupported_claims' END) AS failures FROM j) "
    "SELECT run_id, round(CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE (covered + 0.5::DOUBLE * part) / total END, 6) AS coverage, round(recall, 6) AS evidence_recall, unsupported, open_required, failures, failures = '' AS passed FROM k"
)
def m_run_scores(spark, sf_dir):
    return U.run_scores(*_runs(spark, sf_dir))


@query(
    f"WITH {_HITS}, {GOLD}, pol(policy, budget, most) AS (VALUES ('narrow', 200, 5), ('middle', 800, 10), ('wide', 3000, 20)), "
    "u AS (SELECT policy, budget, query_id, h.doc_id, sum(c.n_words) OVER (PARTITION BY policy, query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM hits h JOIN chunks c USING (chunk_id) JOIN pol ON rank <= most), "
    "p AS (SELECT policy, query_id, max(used) AS used, max(CASE WHEN (query_id, u.doc_id) IN (SELECT query_id, doc_id FROM gold) THEN 1 ELSE 0 END) AS hit FROM u WHERE used <= budget GROUP BY policy, query_id), "
    "g AS (SELECT policy, round(avg(hit), 6) AS recall, CAST(sum(used) AS BIGINT) AS tokens, CAST(max(used) AS BIGINT) AS most_tokens FROM p GROUP BY policy) SELECT *, row_number() OVER (ORDER BY recall DESC, tokens, policy) AS place FROM g"
)
def m_policy_matrix(spark, sf_dir):
    policies = spark.createDataFrame([("narrow", 200, 5), ("middle", 800, 10), ("wide", 3000, 20)], "policy string, budget long, most long")
    h = lexical(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", F.col("n_words").alias("size")), "chunk_id")
    return U.policy_matrix(h.select("query_id", "doc_id", "rank", "size"), gold(spark, sf_dir), policies)


@query(
    f"WITH {_HITS}, {DENSE}, f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) "
    "SELECT 'lexical' AS stage, 1 AS stage_no, query_id, chunk_id, rank, 'candidate' AS decision FROM hits UNION ALL SELECT 'dense', 2, query_id, chunk_id, rank, 'candidate' FROM dense "
    "UNION ALL SELECT 'fused', 3, query_id, chunk_id, rank, CASE WHEN rank <= 10 THEN 'kept' ELSE 'beyond_limit' END FROM r"
)
def r_stage_events(spark, sf_dir):
    a, b = lexical(spark, sf_dir).select("query_id", "chunk_id", "rank"), dense(spark, sf_dir).select("query_id", "chunk_id", "rank")
    fused = R.rrf(a.unionByName(b), ["query_id"], ["chunk_id"]).withColumn("decision", F.when(F.col("rank") <= 10, "kept").otherwise("beyond_limit"))
    candidate = lambda x: x.withColumn("decision", F.lit("candidate"))
    return U.stage_events({"lexical": candidate(a), "dense": candidate(b), "fused": fused})


@query(
    f"WITH {_RUNS}, e AS (SELECT run_id, 'deadline' AS reason FROM runs WHERE status = 'completed_partial') SELECT question_id, run_id, CASE WHEN reason IS NOT NULL AND state = 'pending' THEN 'skipped' ELSE state END AS state, CASE WHEN state = 'pending' THEN reason END AS reason FROM questions LEFT JOIN e USING (run_id)"
)
def d_partial_finish(spark, sf_dir):
    runs, questions, *_ = _runs(spark, sf_dir)
    return U.finished_partially(questions, runs.where("status = 'completed_partial'").select("run_id", F.lit("deadline").alias("reason")))


@query(
    f"WITH {_HITS}, k AS (SELECT h.query_id, h.chunk_id, h.rank, c.n_words AS size, CASE WHEN h.ordinal = 0 THEN 'lead' ELSE 'body' END AS kind FROM hits h JOIN chunks c USING (chunk_id)), "
    "o AS (SELECT *, sum(size) OVER (PARTITION BY query_id, kind ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM k), "
    "u AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM o WHERE own <= CASE kind WHEN 'lead' THEN 600 ELSE 400 END) SELECT query_id, chunk_id, kind, CAST(used AS BIGINT) AS used FROM u WHERE used <= 900"
)
def d_pack_kinds(spark, sf_dir):
    """First chunks and others have budgets of their own."""
    h = lexical(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", F.col("n_words").alias("size")), "chunk_id")
    h = h.withColumn("kind", F.when(F.col("ordinal") == 0, "lead").otherwise("body"))
    return U.budgeted(h, "query_id", ["rank"], "kind", "size", {"lead": 600, "body": 400}, 900).select("query_id", "chunk_id", "kind", "used")


@query("SELECT doc_id FROM documents WHERE doc_id > 50 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def j_unseen_page(spark, sf_dir):
    """The second page of documents without a label: the limit is the feature."""
    from lexmill.operators.changes import missing

    return U.after_cursor(missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id"), "doc_id", 50, 100)


@query(
    f"WITH {_HITS} SELECT h.query_id, h.chunk_id, c.chunk_id AS neighbor_id, c.ordinal - h.ordinal AS step FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.ordinal <> h.ordinal AND abs(c.ordinal - h.ordinal) <= 2"
)
def r_walk(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", "doc_id", "ordinal")
    return U.walked(c, lexical(spark, sf_dir).select("query_id", "chunk_id"), 2)


@query(
    f"WITH {_HITS} SELECT query_id, min_by(chunk_id, rank) AS chunk_id, min(rank) AS rank, coalesce(array_to_string(list_slice(list(chunk_id ORDER BY rank), 2, 1000), ','), '') AS supporting FROM hits GROUP BY query_id, md5(content)"
)
def r_supporting(spark, sf_dir):
    return U.merged_support(lexical(spark, sf_dir).withColumn("unit", F.md5("content")), "query_id", "unit", "chunk_id", "rank").select("query_id", "chunk_id", "rank", "supporting")


@query(
    "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"n_chars\":' || n_chars || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}') AS hash FROM documents"
)
def t_canonical_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    columns = {"source": ("text", F.col("source")), "lang": ("text", F.col("lang")), "doc_id": ("number", F.col("doc_id")), "n_chars": ("number", F.col("n_chars"))}
    return d.select("doc_id", U.canonical_hash(columns).alias("hash"))
