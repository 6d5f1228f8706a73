"""Checks on evaluation tasks and results: hops, leaks, margins, suite validation, review states and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def hop_recall(hops: DataFrame, hits: DataFrame) -> DataFrame:
    """hops(task_id, hop, doc_id), hits(task_id, doc_id) -> task_id, hops, recall (hops with a hit), complete."""
    found = hops.join(hits.select("task_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["task_id", "doc_id"], "left")
    per = found.groupBy("task_id", "hop").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.groupBy("task_id").agg(F.count("*").alias("hops"), F.avg("hit").alias("recall"), (F.min("hit") == 1).alias("complete"))


def leak(question: Column, answer: Column) -> Column:
    """Share of the answer's terms of three and more characters that the question has; 0 for an answer without any."""
    a, q = T.distinct_tokens(answer, 2), T.distinct_tokens(question, 2)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, q)) / F.size(a))


def task_fault(question: Column, answer: Column, unanswerable: Column, n_gold: Column) -> Column:
    """Why a generated task is rejected: the first that holds, null if none."""
    return (
        F.when(F.length(F.coalesce(question, F.lit(""))) < 12, "short_question").when(~unanswerable & ((n_gold == 0) | (F.coalesce(answer, F.lit("")) == "")), "no_gold")
        .when(~unanswerable & (F.size(T.tokens(answer)) < 2), "weak_answer").when(leak(question, answer) > 0.65, "answer_leak")
    )


def violations(rows: DataFrame, key: str, checks: list[tuple[str, Column]], references: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """key, code: a row per failed check, and per value of a column that a referenced table lacks; references: (code, column, table, its column)."""
    codes = F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in checks)))
    out = rows.select(key, F.explode(codes).alias("code"))
    for code, column, other, name in references:
        known = other.select(F.col(name).alias(column)).distinct()
        out = out.unionByName(rows.where(F.col(column).isNotNull()).join(known, column, "left_anti").select(key, F.lit(code).alias("code")))
    return out


def review_status(current: Column, action: Column) -> Column:
    """pending goes to approved, rejected or needs_changes; needs_changes back to pending on resubmission; all else stays."""
    moved = F.when(action == "approve", "approved").when(action == "reject", "rejected").when(action == "request_changes", "needs_changes")
    return F.when(current == "pending", F.coalesce(moved, current)).when((current == "needs_changes") & (action == "resubmit"), "pending").otherwise(current)


def locked_split(tasks: DataFrame, by: list[str], key: Column, dev: int, test: int) -> DataFrame:
    """In hash order: the first ``dev`` of each group are dev, the next ``test`` test, the rest unused."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.sha1(key.cast("string").cast("binary")), key))
    return tasks.withColumn("split", F.when(n <= dev, "dev").when(n <= dev + test, "test").otherwise("unused"))


def margins(hits: DataFrame) -> DataFrame:
    """hits(task_id, rank, gold, hard) -> task_id, margin: the first hard negative's rank minus the first gold rank; null if either is missing."""
    first = lambda flag: F.min(F.when(F.col(flag), F.col("rank")))
    return hits.groupBy("task_id").agg((first("hard") - first("gold")).cast("long").alias("margin"))


def contract_mixes(results: DataFrame, by: list[str], contract: str) -> DataFrame:
    """Keys whose results come from more than one contract, with their contracts in order."""
    g = results.groupBy(*by).agg(F.array_sort(F.collect_set(contract)).alias("contracts"))
    return g.where(F.size("contracts") > 1)


def cause_counts(results: DataFrame, cause: str, causes: tuple[str, ...]) -> DataFrame:
    """cause, n for every cause, zeros included."""
    known = results.sparkSession.createDataFrame([(c,) for c in causes], f"{cause} string")
    counted = results.groupBy(cause).agg(F.count("*").alias("n"))
    return known.join(counted, cause, "left").select(cause, F.coalesce("n", F.lit(0)).alias("n"))


def structure(title: Column, depth: Column, content: Column) -> Column:
    """ambiguous_title, deep_section, list_like, table_like, infobox_like or prose: the first that holds."""
    c, t = F.lower(content), F.lower(title)
    b, e = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    return (
        F.when(t.contains("(значения)") | t.rlike(r"^\d+(\s+год( до н\. э\.)?)?$"), "ambiguous_title").when(depth > 1, "deep_section")
        .when(c.rlike(r"(^|\s)(список|перечень|состоит из|включает:)"), "list_like").when(c.rlike(f"{b}(таблица|столбец|строка|показатель){e}"), "table_like")
        .when(c.rlike(f"{b}(родил[асься]|дата рождения|страна|жанр|тип|основан[ао]?){e}"), "infobox_like").otherwise("prose")
    )


def policy_ranking(results: DataFrame) -> DataFrame:
    """results(policy, passed, leaked, recall, tokens) -> one row per policy with its place: all passed, no leak, recall, fewer tokens, name."""
    g = results.groupBy("policy").agg(
        F.bool_and("passed").alias("all_passed"), F.bool_or("leaked").alias("any_leak"), F.round(F.avg("recall"), 6).alias("recall"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"),
    )
    order = Window.orderBy(F.desc("all_passed"), "any_leak", F.desc("recall"), "tokens", "policy")  # one row per policy
    return g.withColumn("place", F.row_number().over(order).cast("long"))
