"""Search that goes on from its own evidence: what a step finds, and what is still missing, makes the next query. All queries advance together, one job a step."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.research import coverage
from lexmill.storage import settled

# Month stems and forms, templates of bridge queries, comparison markers, patterns of codes and names.
MONTHS = (
    ("январ", "январе"), ("феврал", "феврале"), ("март", "марте"), ("апрел", "апреле"), ("май", "мае"), ("мае", "мае"), ("июн", "июне"),
    ("июл", "июле"), ("август", "августе"), ("сентябр", "сентябре"), ("октябр", "октябре"), ("ноябр", "ноябре"), ("декабр", "декабре"),
)
FILM_OF_MONTH = ("документальный фильм ", "фильм вышедший в ")
FILM_OF_YEAR = "документальный фильм "
SERIES = ("серия жилых домов", "серия жилых домов город")
SAME_DIGITS = "название начинается с тех же цифр"
COMPARISON = ("сравни", "сравнение", "отличается", "между")
YEAR = r"\b(?:19|20)\d{2}\b"
CODE = r"\b[A-ZА-Я]{2,}[A-ZА-Я0-9]*[-_]\d+[A-ZА-Я0-9]*\b"
NAME = r"\b[A-ZА-Я][A-Za-zА-Яа-я0-9-]{3,}(?:\s+[A-ZА-Я][A-Za-zА-Яа-я0-9-]{3,}){0,2}\b"


class Limits(NamedTuple):
    steps: int = 8
    subqueries: int = 6
    chunks: int = 300
    documents: int = 20
    evidence: int = 12
    stalls: int = 2


def _compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, T.SPACE, " "))


def _has(text: Column, *words: str) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _first_of_each(values: Column, most: int | None = None) -> Column:
    """Values in order, the first of each normal form, none that is blank."""
    keys = F.transform(values, T.normalize)
    once = F.filter(values, lambda v, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))
    return once if most is None else F.slice(once, 1, most)


def is_bridge(query: Column) -> Column:
    """A question that leads from a film over a building series to a name: its first step alone never suffices."""
    q = F.lower(query)
    return _has(q, "фильм", "документальн") & _has(q, "сери", "жил") & _has(q, "цифр", "назван")


def bridge_queries(query: Column) -> Column:
    """Queries for the two ends of a bridge question, from templates; empty for other questions."""
    q = F.lower(query)
    none = F.array().cast("array<string>")
    month = F.coalesce(*(F.when(F.contains(q, F.lit(stem)), form) for stem, form in MONTHS))
    year = F.nullif(F.regexp_extract(q, "(?U)" + YEAR, 0), F.lit(""))
    films = F.when(month.isNotNull() & year.isNotNull(), F.array(*(F.concat(F.lit(t), month, F.lit(" "), year) for t in FILM_OF_MONTH)))
    films = F.when(_has(q, "документаль", "фильм"), films.when(year.isNotNull(), F.array(F.concat(F.lit(FILM_OF_YEAR), year))))
    films = F.coalesce(films, none)
    series = F.when(F.contains(q, F.lit("сери")) & _has(q, "жил", "дом", "здани"), F.array(*map(F.lit, SERIES))).otherwise(none)
    digits = F.when(F.contains(q, F.lit("цифр")) & F.contains(q, F.lit("назван")), F.array(F.lit(SAME_DIGITS))).otherwise(none)
    return F.coalesce(F.concat(F.slice(films, 1, 1), F.slice(series, 1, 1), F.slice(films, 2, 9), F.slice(series, 2, 9), digits), none)


def planned(query: Column, most: int = 5) -> Column:
    """Bridge queries, then the query and its parts, each followed by its six first long words and, where it compares, itself without the word for comparing."""
    q = F.coalesce(query, F.lit(""))
    parts = F.filter(F.transform(F.split(q, r"(?i)\?|;|\bvs\b|\bversus\b"), lambda p: F.trim(p, F.lit(" ?"))), lambda p: F.trim(p) != "")
    parts = F.when(F.size(parts) == 0, F.array(q)).when(F.array_contains(parts, q), parts).otherwise(F.concat(F.array(q), parts))

    def variants(part: Column) -> Column:
        flat = _compact(part)
        long = F.array_join(F.slice(F.filter(T.tokens(flat), lambda w: F.length(w) >= 6), 1, 6), " ")
        bare = F.when(_has(F.lower(flat), *COMPARISON), F.trim(F.replace(F.replace(flat, F.lit("сравни"), F.lit("")), F.lit("Сравни"), F.lit("")))).otherwise("")
        return F.array(flat, long, bare)

    return _first_of_each(F.concat(bridge_queries(query), F.flatten(F.transform(parts, variants))), most)


def anchors(text: Column, most: int = 4) -> Column:
    """Codes, then names, of a text, each once."""
    found = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)), _compact) for p in (CODE, NAME)))
    return _first_of_each(found, most)


def repair(query: Column, missing: Column, found: Column, most: int = 8, length: int = 500) -> Column:
    """The query with parts that are missing and anchors of the evidence, as far as it doesn't hold them; null where there are none."""
    held = T.normalize(query)
    lacking = F.filter(F.concat(missing, found), lambda x: (T.normalize(x) != "") & ~F.contains(held, T.normalize(x)))
    candidate = F.left(_compact(F.concat_ws(" ", _compact(query), F.array_join(F.slice(lacking, 1, most), " "))), F.lit(length))
    return F.when(F.size(lacking) > 0, candidate)


def final_evidence(evidence: DataFrame, limit: int, ambiguous: bool = False) -> DataFrame:
    """evidence(query_id, chunk_id, doc_id, unit, step, place) -> query_id, chunk_id, position: at most ``limit`` chunks of each query.

    Steps take turns: the first finding of every step, then the second of each; neighbours (no place) come last. Of one unit the first counts. ambiguous: the
    best chunk of up to eight documents leads, and no document has more than two. A query's chunks are bounded by the budget of its steps, so that they are folded in one array.
    """
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("place").isNull(), "place", "step", "chunk_id"))
    e = evidence.withColumn("turn", turn)
    if ambiguous:
        own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("turn")) == 1
        e = e.withColumn("own", own)
        lead = F.sum(F.col("own").cast("int")).over(Window.partitionBy("query_id").orderBy("turn"))
        e = e.withColumn("late", ~(F.col("own") & (lead <= min(8, limit))))
    else:
        e = e.withColumn("late", F.lit(False))
    item = F.struct("late", "turn", "chunk_id", F.col("doc_id").cast("string").alias("doc"), "unit")
    texts = "array<string>"
    start = F.struct(F.array().cast(texts).alias("chunks"), F.array().cast(texts).alias("units"), F.array().cast(texts).alias("docs"))

    def take(done: Column, x: Column) -> Column:
        full = (F.size(done["chunks"]) >= limit) | F.array_contains(done["units"], x["unit"])
        if ambiguous:
            full |= F.size(F.filter(done["docs"], lambda d: d.eqNullSafe(x["doc"]))) >= 2
        more = F.struct(
            F.array_append(done["chunks"], x["chunk_id"]).alias("chunks"), F.array_append(done["units"], x["unit"]).alias("units"), F.array_append(done["docs"], x["doc"]).alias("docs")
        )
        return F.when(full, done).otherwise(more)

    chosen = e.groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, take)["chunks"].alias("chunks"))
    return chosen.select("query_id", F.posexplode("chunks").alias("at", "chunk_id")).select("query_id", "chunk_id", (F.col("at") + 1).cast("long").alias("position"))


def search_steps(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], neighbours: Callable[[DataFrame], DataFrame] | None = None, limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries(query_id, text) -> log, evidence and state of a search in steps.

    log: query_id, step, query, role (planned or repair), found, new, neighbours, coverage. evidence: query_id, chunk_id, doc_id, content, unit, step, place (of the hit; null for a neighbour).
    state: query_id, steps, coverage, stop. ``search`` maps (query_id, text) to (query_id, chunk_id, doc_id, content, rank), ``neighbours`` the same columns' best hits to the chunks beside them.

    Each step asks every query's next subquery. A query stops, in this order: when all its parts are covered (a bridge question not before its second step:
    evidence_sufficient), when a last subquery brought nothing new (no_new_evidence), after ``stalls`` steps that did not raise coverage and with no subquery left (coverage_stalled), at the
    limits of chunks and documents, or with no subquery or step left (budget_reached). Before it stops, what is missing and the anchors of the evidence make one more
    subquery, unless a subquery of the same normal form has been planned or as many as allowed.
    """
    zero, none = F.lit(0), F.array().cast("array<string>")
    asks = planned(F.col("text"), max(1, limits.subqueries - 1))
    plan = queries.select("query_id", "text", F.coalesce(is_bridge(F.col("text")), F.lit(False)).alias("bridge"), asks.alias("asks"))
    plan = plan.select("*", F.transform("asks", lambda _: F.lit("planned")).alias("roles"), zero.alias("steps"), F.lit(0.0).alias("coverage"), zero.alias("stalled"), F.when(F.size("asks") == 0, "budget_reached").alias("stop"))
    state = settled(plan, "plan")
    columns, kind = ["query_id", "chunk_id", "doc_id", "content"], dict(queries.dtypes)["query_id"]
    evidence = log = None
    ended = [state.where("stop is not null")]
    for step in range(1, limits.steps + 1):
        going = state.where("stop is null").select("query_id", "text", "bridge", "asks", "roles", "steps", "coverage", "stalled", "stop")
        if going.isEmpty():
            break
        asked = going.select("query_id", F.get("asks", F.lit(step - 1)).alias("text"), F.get("roles", F.lit(step - 1)).alias("role"))
        hits = settled(search(asked.select("query_id", "text")).select(*columns, "rank"), "found")
        fresh = hits if evidence is None else hits.join(evidence, ["query_id", "chunk_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
        fresh = fresh.select(*columns, place.alias("place"))
        if neighbours is not None:
            beside = neighbours(hits.where("rank <= 2").select("query_id", "chunk_id")).select(*columns).dropDuplicates(["query_id", "chunk_id"])
            beside = beside.join(hits, ["query_id", "chunk_id"], "left_anti")
            beside = beside if evidence is None else beside.join(evidence, ["query_id", "chunk_id"], "left_anti")
            fresh = fresh.unionByName(beside.withColumn("place", F.lit(None).cast("int")))
        fresh = settled(fresh.select(*columns, F.md5("content").alias("unit"), F.lit(step).alias("step"), "place"), "evidence")
        evidence = fresh if evidence is None else evidence.unionByName(fresh)  # a table a step

        counts = evidence.groupBy("query_id").agg(
            F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.count_if((F.col("step") == step) & F.col("place").isNotNull()).alias("new"),
            F.count_if((F.col("step") == step) & F.col("place").isNull()).alias("beside"),
        )
        worth = F.when(F.col("status") == "covered", 1.0).when(F.col("status") == "mentioned", 0.5).otherwise(0.0)
        lacking = F.collect_list(F.when(F.col("status") != "covered", F.struct("part_no", "part")))
        parts = coverage(going.select("query_id", "text"), evidence).groupBy("query_id").agg(F.avg(worth).alias("now"), F.transform(F.array_sort(lacking), lambda x: x["part"]).alias("missing"))
        shown = final_evidence(evidence.join(going.select("query_id"), "query_id", "left_semi"), limits.evidence).join(evidence, ["query_id", "chunk_id"])
        said = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), " ").alias("said"))
        found = hits.groupBy("query_id").agg(F.count("*").alias("found"))
        s = going.join(counts, "query_id", "left").join(parts, "query_id", "left").join(said, "query_id", "left").join(found, "query_id", "left")
        s = s.withColumns({c: F.coalesce(c, zero) for c in ("chunks", "documents", "new", "beside", "found")} | {"now": F.coalesce("now", F.lit(0.0)), "missing": F.coalesce("missing", none)})
        enough = (F.size("missing") == 0) & (F.lit(step) >= F.when(F.col("bridge"), 2).otherwise(1)) & (F.col("chunks") > 0)
        candidate = repair(F.col("text"), F.col("missing"), anchors(F.coalesce("said", F.lit(""))))
        known = F.array_contains(F.transform("asks", T.normalize), T.normalize(F.col("candidate")))
        s = s.withColumn("enough", enough).withColumn("candidate", F.when(~F.col("enough") & (F.col("chunks") > 0), candidate))
        add = F.col("candidate").isNotNull() & ~known & (F.size("asks") < limits.subqueries)
        s = s.withColumn("add", F.coalesce(add, F.lit(False))).withColumns({"query": F.get("asks", F.lit(step - 1)), "role": F.get("roles", F.lit(step - 1))})
        s = s.withColumns({"asks": F.when(F.col("add"), F.array_append("asks", F.col("candidate"))).otherwise(F.col("asks")), "roles": F.when(F.col("add"), F.array_append("roles", F.lit("repair"))).otherwise(F.col("roles"))})
        last = F.size("asks") <= step
        stalled = F.when(F.col("now") <= F.col("coverage"), F.col("stalled") + 1).otherwise(0)
        stop = (
            F.when(F.col("enough"), "evidence_sufficient").when((F.col("new") == 0) & (F.col("beside") == 0) & last, "no_new_evidence").when((stalled >= limits.stalls) & last, "coverage_stalled")
            .when((F.col("chunks") >= limits.chunks) | (F.col("documents") >= limits.documents) | last | F.lit(step == limits.steps), "budget_reached")
        )
        state = settled(
            s.select(
                "query_id", "text", "bridge", "asks", "roles", F.lit(step).alias("steps"), F.col("now").alias("coverage"), stalled.alias("stalled"), stop.alias("stop"),
                "query", "role", *(F.col(c).cast("long").alias(c) for c in ("found", "new", "beside")),
            ),
            "state",
        )
        entry = state.select("query_id", F.col("steps").alias("step"), "query", "role", "found", "new", F.col("beside").alias("neighbours"), "coverage")
        log = entry if log is None else log.unionByName(entry)
        ended.append(state.where("stop is not null"))
    if log is None:
        log = queries.sparkSession.createDataFrame([], f"query_id {kind}, step int, query string, role string, found long, new long, neighbours long, coverage double")
        evidence = queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id string, doc_id long, content string, unit string, step int, place int")
    state = None
    for part in ended:
        part = part.select("query_id", "steps", "coverage", "stop")
        state = part if state is None else state.unionByName(part)
    return log, evidence, state
