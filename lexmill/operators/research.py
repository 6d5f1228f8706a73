"""Search in several steps and the records of a research run: every step serves all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.answers import query_parts

# Fixed values.
SEVERAL_STEPS = (
    "сравни", "сравнение", "отличается", "почему", "как связано", "между", "multi-hop", "несколько", "конфликт", "что общего",
    "название которой начинается", "название которого начинается", "название начинается", "те же цифры", "тех же цифр",
    "вышедшего на экраны", "вышедший на экраны",
)
TRANSIENT_STATUS = (408, 429, 500, 502, 503, 504)
UNSAFE = ("s1", "s2", "tenant_id", "object_key", "provider", "storage_key")
UUID = r"(?i)\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b"
REFERENCE = r"\[(E-[0-9a-fA-F]{32})\]"


def needs_steps(query: Column) -> Column:
    """A marker of comparison or of several hops, or more than one question mark."""
    return F.coalesce(F.lower(query).rlike("|".join(SEVERAL_STEPS)) | (F.regexp_count(query, F.lit(r"\?")) > 1), F.lit(False))


def _compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, T.SPACE, " "))


def _once(values: Column, key: Callable[[Column], Column]) -> Column:
    """First of the values with an equal key, blank keys dropped."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: (key(v) != "") & (F.array_position(keys, key(v)) == i + 1))


def subqueries(query: Column, most: int = 6) -> Column:
    """The query, its parts, and each one's six first long words, different after normalization."""
    whole = _compact(F.coalesce(query, F.lit("")))
    parts = F.transform(F.split(whole, r"(?i)\?|;|\bvs\b|\bversus\b"), lambda p: F.regexp_replace(p, r"^[ ?]+|[ ?]+$", ""))
    each = F.concat(F.array(whole), F.filter(parts, lambda p: p != ""))
    long = lambda p: F.array_join(F.slice(F.filter(T.tokens(p), lambda w: F.length(w) >= 6), 1, 6), " ")
    return F.slice(_once(F.flatten(F.transform(each, lambda p: F.array(p, long(p)))), T.normalize), 1, most)


def gap_query(query: Column, additions: Column, most: int = 8, length: int = 500) -> Column:
    """The query with what it still lacks: up to some additions that it does not contain."""
    lacking = F.filter(F.array_distinct(additions), lambda a: (F.trim(a) != "") & ~F.contains(F.lower(query), F.lower(a)))
    return F.left(_compact(F.concat_ws(" ", query, F.array_join(F.slice(lacking, 1, most), " "))), F.lit(length))


def coverage(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries(query_id, text), evidence(query_id, chunk_id, content) -> query_id, part, status, evidence_ids (at most six).

    A part is covered if one chunk has all of its terms, mentioned if a chunk contains a term of five and more characters.
    """
    p = queries.select("query_id", F.posexplode(query_parts(F.col("text"))).alias("part_no", "part"))
    x = p.join(evidence.select("query_id", "chunk_id", "content"), "query_id", "left")
    terms, has = T.distinct_tokens(F.col("part")), T.distinct_tokens(F.col("content"))
    common = F.array_intersect(terms, has)
    x = x.withColumn("whole", (F.size(terms) > 0) & (F.size(common) == F.size(terms))).withColumn("some", F.exists(common, lambda w: F.length(w) >= 5))
    x = x.withColumn("chunk", F.when(F.size(common) > 0, F.col("chunk_id")))
    g = x.groupBy("query_id", "part_no", "part").agg(F.max("whole").alias("whole"), F.max("some").alias("some"), F.slice(F.array_sort(F.collect_set("chunk")), 1, 6).alias("evidence_ids"))
    status = F.when(F.col("whole"), "covered").when(F.col("some"), "mentioned").otherwise("missing")
    return g.select("query_id", "part_no", "part", status.alias("status"), "evidence_ids")


def coverage_ratio(inventory: DataFrame) -> DataFrame:
    """query_id, ratio: a covered part counts 1, a mentioned one a half."""
    return inventory.groupBy("query_id").agg(F.avg(F.when(F.col("status") == "covered", 1.0).when(F.col("status") == "mentioned", 0.5).otherwise(0.0)).alias("ratio"))


def step_search(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], steps: int = 4, stalls: int = 2, most: int = 300, settle: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, text) -> evidence(query_id, chunk_id, content, step, score) and state(query_id, steps, ratio, stop).

    Step n searches the nth subquery of every query that goes on; ``search`` maps (query_id, text) to (query_id, chunk_id, content, score)
    for all of them in one job. A query stops when its parts are covered, after some steps without new evidence, with no subquery
    left, or at the limits. ``settle`` cuts the lineage of a step's tables (by default a checkpoint where the session names a folder).
    """
    if settle is None:
        settle = (lambda df: df.checkpoint()) if queries.sparkSession.conf.get("spark.checkpoint.dir", None) else (lambda df: df)
    columns = ["query_id", "chunk_id", "content", "score"]
    todo = settle(queries.select("query_id", "text", subqueries(F.col("text"), steps).alias("sub")))
    state = todo.select("query_id", F.lit(0).alias("steps"), F.lit(0).alias("stalled"), F.lit(0.0).alias("ratio"), F.lit(None).cast("string").alias("stop"))
    evidence = None
    for n in range(1, steps + 1):
        going = state.where("stop is null").select("query_id")
        asked = todo.join(going, "query_id", "left_semi").where(F.size("sub") >= n).select("query_id", F.get("sub", F.lit(n - 1)).alias("text"))
        found = search(asked).select(*columns).withColumn("step", F.lit(n))
        fresh = settle(found if evidence is None else found.join(evidence, ["query_id", "chunk_id"], "left_anti"))
        evidence = fresh if evidence is None else settle(evidence.unionByName(fresh))
        ratio = coverage_ratio(coverage(todo, evidence)).withColumnRenamed("ratio", "now")
        new = fresh.groupBy("query_id").agg(F.count("*").alias("new"))
        total = evidence.groupBy("query_id").agg(F.count("*").alias("total"))
        s = state.join(todo.select("query_id", F.size("sub").alias("subs")), "query_id").join(ratio, "query_id", "left").join(new, "query_id", "left").join(total, "query_id", "left")
        on = F.col("stop").isNull()
        stalled = F.when(F.col("new") > 0, 0).otherwise(F.col("stalled") + 1)
        stop = (
            F.when(F.col("now") >= 1.0, "sufficient").when(stalled >= stalls, "stalled").when(F.col("total") >= most, "chunk_budget")
            .when(F.col("subs") <= n, "no_subquery_left").when(F.lit(n == steps), "step_budget")
        )
        state = settle(s.select("query_id", F.when(on, n).otherwise(F.col("steps")).alias("steps"), F.when(on, stalled).otherwise(F.col("stalled")).alias("stalled"), F.when(on, F.coalesce("now", F.lit(0.0))).otherwise(F.col("ratio")).alias("ratio"), F.when(on, stop).otherwise(F.col("stop")).alias("stop")))
    return evidence, state.select("query_id", "steps", "ratio", "stop")


def topic_questions(topic: Column, most: int = 8) -> Column:
    """The whole topic and its parts (split at conjunctions and question marks) as questions, each once."""
    flat = _compact(F.coalesce(topic, F.lit("")))
    bare = lambda p: F.regexp_replace(p, r"^[ ?.]+|[ ?.]+$", "")
    parts = F.filter(F.transform(F.split(flat, r" и |\?"), bare), lambda p: p != "")
    each = F.when(F.array_contains(parts, flat), parts).otherwise(F.concat(F.array(flat), parts))
    once = F.slice(_once(each, F.lower), 1, most)
    return F.transform(once, lambda p: F.when(p.endswith("?"), p).otherwise(F.concat(p, F.lit("?"))))


def best_per_chunk(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """One row per key: that of the highest score, ties by the least ``tie``."""
    rest = [c for c in rows.columns if c not in by]
    top = rows.groupBy(*by).agg(F.max(score).alias("_best"))
    kept = rows.join(top, by).where(F.col(score) == F.col("_best")).drop("_best")
    return kept.groupBy(*by).agg(F.min_by(F.struct(*rest), tie).alias("row")).select(*by, "row.*")


def claim_text(content: Column) -> Column:
    """The first sentence of the first line, at most 500 characters."""
    return F.left(F.trim(F.substring_index(F.substring_index(F.trim(content), "\n", 1), ". ", 1)), F.lit(500))


def claim_status(verdict: Column, covered: Column, claim: Column) -> Column:
    conflict = (covered == "conflicting") & (F.trim(claim) != "")
    return (
        F.when(conflict | (verdict == "contradicted"), "conflicting").when(verdict == "supported", "supported")
        .when(verdict == "partially_supported", "partial").otherwise("unsupported")
    )


def tool_error(kind: Column, status: Column) -> Column:
    """transient, security, permanent or controller_bug, by the error's kind and its HTTP status."""
    return (
        F.when(kind.isin("timeout", "connection", "network"), "transient").when((kind == "http") & status.isin(*TRANSIENT_STATUS), "transient")
        .when(status.isin(401, 403) | (kind == "permission"), "security").when(kind.isin("value", "lookup"), "permanent").otherwise("controller_bug")
    )


def report_fault(markdown: Column, references: Column, allowed: Column) -> Column:
    """Why a written report is not accepted (null: it is): blank, references repeated or unknown, unsafe words, a paragraph that cites nothing, or a reference unused."""
    cited = F.regexp_extract_all(markdown, F.lit(REFERENCE), F.lit(1))
    paragraphs = F.filter(F.transform(F.split(markdown, r"\n\s*\n"), F.trim), lambda p: (p != "") & ~p.startswith("#") & ~F.lower(p).startswith("limitations"))
    return (
        F.when(F.trim(F.coalesce(markdown, F.lit(""))) == "", "blank").when(F.size(F.array_distinct(references)) != F.size(references), "reference_repeated")
        .when(F.size(F.array_except(references, allowed)) > 0, "reference_unknown").when(F.lower(markdown).rlike("|".join(UNSAFE)) | markdown.rlike(UUID), "unsafe")
        .when(F.exists(paragraphs, lambda p: ~p.rlike(REFERENCE)), "uncited_paragraph").when(F.size(F.array_except(references, cited)) > 0, "reference_unused")
    )


def report(claims: DataFrame) -> DataFrame:
    """claims(run_id, question, claim_no, text, status, reference) -> run_id, n_claims, markdown: a heading per question, its supported and partial claims below."""
    line = F.concat(F.lit("- "), F.col("text"), F.when(F.col("status") == "partial", " (partial)").otherwise(""), F.lit(" ["), F.col("reference"), F.lit("]"))
    kept = claims.where(F.col("status").isin("supported", "partial")).withColumn("line", line)
    q = kept.groupBy("run_id", "question").agg(F.min("claim_no").alias("first"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "line"))), lambda s: s["line"]).alias("lines"))
    block = F.concat(F.lit("## "), F.col("question"), F.lit("\n\n"), F.array_join("lines", "\n"))
    q = q.withColumn("block", F.struct("first", block.alias("text")))
    return q.groupBy("run_id").agg(F.sum("n").alias("n_claims"), F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda b: b["text"]), "\n\n").alias("markdown"))


def next_action(runs: DataFrame, episodes: int, calls: int, stalls: int, now: Column) -> DataFrame:
    """runs(run_id, cancelled, paused, deadline, episodes, calls, stalled, unfinished, open_questions) -> run_id, action; the first that holds."""
    action = (
        F.when(F.col("cancelled"), "cancel").when(F.col("paused"), "pause").when(F.col("deadline") <= now, "finish_deadline").when(F.col("episodes") >= episodes, "finish_episode_budget")
        .when(F.col("calls") >= calls, "finish_call_budget").when(F.col("stalled") >= stalls, "recover").when(F.col("unfinished") > 0, "resume")
        .when(F.col("open_questions") > 0, "next_question").otherwise("finish")
    )
    return runs.select("run_id", action.alias("action"))
