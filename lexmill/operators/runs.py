"""Research runs: scores, context policies, stage events, partial finishes; and small set operations around retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.answers import packed


def run_scores(runs: DataFrame, questions: DataFrame, evidence: DataFrame, claims: DataFrame, least_covered: int = 1) -> DataFrame:
    """runs(run_id, status, wants_conflict), questions(run_id, required, state, coverage), evidence(run_id, evidence_id, visible, marker, wanted),
    claims(run_id, evidence_id) -> a row per run: coverage, evidence_recall, unsupported, open_required, failures (codes, joined), passed.

    coverage: share of questions covered, partly ones count a half. evidence_recall: found markers of those wanted. A claim is
    unsupported if its evidence isn't visible in its run. A run without questions, evidence or claims has none to fail.
    """
    q = questions.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("coverage") == "covered").alias("covered"), F.count_if(F.col("coverage") == "partial").alias("partial"),
        F.count_if(F.col("coverage") == "conflicting").alias("conflicting"), F.count_if(F.col("required") & (F.col("state") != "done")).alias("open_required"),
    )
    e = evidence.groupBy("run_id").agg(F.count_if("wanted").alias("wanted"), F.count_if(F.col("wanted") & F.col("visible")).alias("found"))
    seen = evidence.where("visible").select("run_id", "evidence_id").distinct()
    c = claims.join(seen, ["run_id", "evidence_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("unsupported"))
    r = runs.join(q, "run_id", "left").join(e, "run_id", "left").join(c, "run_id", "left").na.fill(0, ["total", "covered", "partial", "conflicting", "open_required", "wanted", "found", "unsupported"])
    recall = F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("found") / F.col("wanted"))
    done = F.col("status").startswith("completed")
    checks = [
        ("required_open", done & (F.col("open_required") > 0)), ("evidence_missing", recall < 1), ("coverage_low", F.col("covered") + F.col("partial") < least_covered),
        ("conflict_unseen", F.col("wants_conflict") & (F.col("conflicting") == 0)), ("unsupported_claims", F.col("unsupported") > 0),
    ]
    failures = F.concat_ws(",", *(F.when(cond, F.lit(code)) for code, cond in checks))
    share = F.when(F.col("total") == 0, 0.0).otherwise((F.col("covered") + 0.5 * F.col("partial")) / F.col("total"))
    return r.select("run_id", F.round(share, 6).alias("coverage"), F.round(recall, 6).alias("evidence_recall"), "unsupported", "open_required", failures.alias("failures"), (failures == "").alias("passed"))


def policy_matrix(hits: DataFrame, gold: DataFrame, policies: DataFrame) -> DataFrame:
    """hits(query_id, doc_id, rank, size), gold(query_id, doc_id), policies(policy, budget, most) -> policy, recall, tokens, most_tokens, place.

    Every policy packs every query's context; policies are few and stated, more than 1,000 of them an error. Best recall first, then fewest tokens, then the name.
    """
    if policies.limit(1001).count() > 1000:
        raise ValueError("more than 1,000 policies")
    h = hits.join(F.broadcast(policies), F.col("rank") <= F.col("most"))
    w = Window.partitionBy("policy", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = h.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= F.col("budget"))
    marked = kept.join(gold.select("query_id", "doc_id", F.lit(1).alias("good")).distinct(), ["query_id", "doc_id"], "left")
    per = marked.groupBy("policy", "query_id").agg(F.max("used").alias("used"), F.coalesce(F.max("good"), F.lit(0)).alias("hit"))
    g = per.groupBy("policy").agg(F.round(F.avg("hit"), 6).alias("recall"), F.sum("used").alias("tokens"), F.max("used").alias("most_tokens"))
    place = F.row_number().over(Window.orderBy(F.desc("recall"), "tokens", "policy")).cast("long")  # one row a policy
    return g.withColumn("place", place)


def stage_events(stages: dict[str, DataFrame]) -> DataFrame:
    """Each stage's (query_id, chunk_id, rank, decision) as one long table: stage, n (of the stage), ...; a stage keeps its order."""
    out = None
    for n, (name, rows) in enumerate(stages.items(), 1):
        one = rows.select(F.lit(name).alias("stage"), F.lit(n).cast("long").alias("stage_no"), "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "decision")
        out = one if out is None else out.unionByName(one)
    return out


def finished_partially(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """questions(question_id, run_id, state), runs(run_id, reason) that end early -> questions with state and reason: what was still open is skipped."""
    q = questions.join(runs, "run_id", "left")
    closes = F.col("reason").isNotNull() & ~F.col("state").isin("done", "skipped", "failed")
    return q.select("question_id", "run_id", F.when(closes, "skipped").otherwise(F.col("state")).alias("state"), F.when(closes, F.col("reason")).alias("reason"))


def budgeted(rows: DataFrame, by: str, order: list, kind: str, size: str, budgets: dict[str, int], total: int) -> DataFrame:
    """The longest prefix of each kind that stays in the kind's own budget, then of all together in the whole one."""
    w = Window.partitionBy(by, kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.create_map(*(F.lit(x) for pair in budgets.items() for x in pair))[F.col(kind)]
    kept = rows.withColumn("kind_used", F.sum(size).over(w)).where(F.col("kind_used") <= F.coalesce(own, F.lit(0)))
    return packed(kept, by, order, size, total)


def after_cursor(rows: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next n rows by key behind the cursor (null: from the start): keyset paging, no offset is counted."""
    left = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return left.orderBy(key).limit(n)


def walked(chunks: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """chunks(chunk_id, doc_id, ordinal), hits(query_id, chunk_id) -> query_id, chunk_id, neighbor_id, step: up to ``window`` chunks back and on in the document."""
    near = hits.join(chunks, "chunk_id").select("query_id", "chunk_id", "doc_id", "ordinal")
    steps = F.array(*(F.lit(s) for s in range(-window, window + 1) if s))
    asked = near.withColumn("step", F.explode(steps)).withColumn("ordinal", F.col("ordinal") + F.col("step"))
    other = chunks.select("doc_id", "ordinal", F.col("chunk_id").alias("neighbor_id"))
    return asked.join(other, ["doc_id", "ordinal"]).select("query_id", "chunk_id", "neighbor_id", F.col("step").cast("long").alias("step"))


def canonical_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys and no spaces; null values are null."""
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(v.cast("string"), r"\\", r"\\\\"), '"', r"\\\""), "\n", r"\\n"), F.lit('"'))
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(quoted(v) if kind == "text" else v.cast("string"), F.lit("null"))) for k, (kind, v) in sorted(columns.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def merged_support(rows: DataFrame, by: str, unit: str, key: str, rank: str) -> DataFrame:
    """The first of each unit, with the other keys of it (in order) as supporting."""
    g = rows.groupBy(by, unit).agg(F.sort_array(F.collect_list(F.struct(rank, key))).alias("x"))
    return g.select(by, F.col("x")[0][key].alias(key), F.col("x")[0][rank].alias(rank), F.array_join(F.transform(F.slice("x", 2, 1 << 30), lambda v: v[key]), ",").alias("supporting"))
