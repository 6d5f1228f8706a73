"""The answer gate: whether what retrieval found answers a query, for whole tables of queries at once.

Each query's evidence is the few best chunks that ranking kept; they are gathered per query, and all signals are columns of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.answers import first_failure, query_parts

# Fixed values.
DEFINITIONS = ("что такое ", "кто такой ", "кто такая ", "what is ", "who is ")
PREFIXES = (*DEFINITIONS[:3], "расскажи о ", *DEFINITIONS[3:])
FACTS = (
    "год", "дата", "дате", "когда", "номер", "серийн", "сколько", "официальн", "snapshot", "снапшот", "указан", "указано", "население", "площад",
    "столиц",
)
CONFLICTS = ("конфликт", "противореч", "разные данные", "какой источник верен", "which source is correct", "conflict", "contradict")
QUOTED_TITLE = r"[«\"]([^»\"]+)[»\"]"


def title_candidates(query: Column) -> Column:
    """Normal forms that a title may have to be meant: quoted parts, what follows 'what is' and the like, and names."""
    normal = T.normalize(query)
    tails = F.array(*(F.when(normal.startswith(p), F.trim(F.substring(normal, len(p) + 1, 1 << 20))) for p in PREFIXES))
    quoted = F.transform(F.regexp_extract_all(query, F.lit(QUOTED_TITLE), F.lit(1)), T.normalize)
    every = F.concat(quoted, tails, F.transform(T.names(query), T.normalize))
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != "")))


def _overlapping(terms: Column, others: Column) -> Column:
    """The terms that overlap with the others, each by itself."""
    return F.filter(terms, lambda t: T.terms_overlap(F.array(t), others))


def signals(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries(query_id, text), evidence(query_id, rank, doc_id, title, content) -> one row per query, without evidence too:
    exact_title, entity_alignment, ambiguous, n_parts, n_covered, n_values, n_values_covered, n_names, n_names_covered, n_terms,
    n_terms_covered, rank_confidence, diversity, n_evidence, conflict, definition, asks_fact.

    Null titles and contents read as empty.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    item = F.struct("rank", "doc_id", T.normalize(blank(F.col("title"))).alias("title"), T.tokens(F.concat_ws(" ", blank(F.col("title")), blank(F.col("content")))).alias("body"), T.values(blank(F.col("content"))).alias("values"))
    items = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    q = queries.join(items, "query_id", "left").withColumn("items", F.coalesce("items", F.filter(F.array(F.lit(None).cast(items.schema["items"].dataType.elementType)), lambda x: x.isNotNull())))
    q = q.withColumns(
        {
            "normal": T.normalize(F.col("text")), "names": F.transform(T.names(F.col("text")), T.normalize), "asked": T.significant_terms(F.col("text")),
            "candidates": title_candidates(F.col("text")), "titles": F.filter(F.array_distinct(F.col("items.title")), lambda t: t != ""),
            "body": F.array_distinct(F.flatten("items.body")), "part": query_parts(F.col("text")), "numbers": F.transform(T.values(F.col("text")), T.normalize),
        }
    )
    split = lambda t: F.split(t, " ")
    meant = F.array_distinct(F.flatten(F.transform(F.filter("titles", lambda t: T.terms_overlap(split(t), split(F.col("normal")))), split)))
    q = q.withColumn("terms", F.filter("asked", lambda t: ~T.terms_overlap(F.array(t), meant)))
    text = F.concat(F.lit(" "), F.array_join(F.flatten("items.body"), " "), F.lit(" "))
    exact = F.arrays_overlap("titles", "candidates")
    near = F.filter("titles", lambda t: F.array_contains(F.col("candidates"), t) | F.exists("candidates", lambda c: F.contains(t, c)))

    def part_covered(p: Column) -> Column:
        terms, own, normal = T.significant_terms(p), F.transform(T.names(p), T.normalize), T.normalize(p)

        def by(i: Column) -> Column:
            titled = (normal != "") & (F.contains(i["title"], normal) | F.contains(normal, i["title"]))
            return titled | ((F.size(own) == 0) | T.terms_overlap(own, i["body"])) & T.terms_overlap(terms, i["body"])

        return (F.size(terms) > 0) & F.exists("items", by)

    with_values = F.filter("items.values", lambda v: F.size(v) > 0)
    diverges = F.exists(with_values, lambda v: ~F.arrays_overlap(v, F.get(with_values, F.lit(0))))
    return q.select(
        "query_id",
        exact.alias("exact_title"),
        ((F.size("names") > 0) & F.exists("titles", lambda t: T.terms_overlap(F.col("names"), split(t)))).alias("entity_alignment"),
        ((F.size(near) > 1) & ~exact).alias("ambiguous"),
        *(
            F.size(c).cast("long").alias(n)
            for n, c in (
                ("n_parts", F.col("part")), ("n_covered", F.filter("part", part_covered)), ("n_values", F.col("numbers")),
                ("n_values_covered", F.filter("numbers", lambda v: F.contains(text, v))), ("n_names", F.col("names")),
                ("n_names_covered", F.filter("names", lambda v: F.contains(text, v))), ("n_terms", F.col("terms")),
                ("n_terms_covered", _overlapping(F.col("terms"), F.col("body"))), ("diversity", F.array_distinct(F.col("items.doc_id"))), ("n_evidence", F.col("items")),
            )
        ),
        F.coalesce(F.round(F.greatest(F.lit(0.0), 1 - (F.get("items", F.lit(0))["rank"] - 1) / 50.0), 6), F.lit(0.0)).alias("rank_confidence"),
        F.coalesce(F.lower("text").rlike("|".join(CONFLICTS)) & diverges, F.lit(False)).alias("conflict"),
        F.col("normal").rlike("^(" + "|".join(DEFINITIONS) + ")").alias("definition"),
        F.col("normal").rlike("|".join(FACTS)).alias("asks_fact"),
    )


def decision(s: DataFrame) -> DataFrame:
    """signals -> query_id, status, reason, confidence: the first rule that holds."""
    c = F.col
    ratio = c("n_covered") / F.greatest(c("n_parts"), F.lit(1))
    lacking = (c("n_terms") >= 2) & (c("n_terms") - c("n_terms_covered") >= 2) & c("asks_fact") & (c("n_terms_covered") / c("n_terms") < 0.5)
    strong = c("exact_title") | (~c("definition") & c("entity_alignment") & (c("rank_confidence") >= 0.75))
    whole = strong & (ratio >= 1) & (c("n_values") == c("n_values_covered")) & (c("n_names") == c("n_names_covered")) & (c("diversity") >= F.least(c("n_parts"), F.lit(2)))
    rules = [
        ("explicit_conflict_with_divergent_values", c("conflict")), ("no_evidence", c("n_evidence") == 0), ("answer_bearing_terms_missing_partial", lacking),
        ("required_parts_covered", whole), ("ambiguous_entity", c("definition") & c("ambiguous")),
    ]
    r = s.withColumn("reason", first_failure(rules, "partial_context_coverage"))
    status = F.when(c("reason").startswith("explicit"), "conflicting").when(c("reason") == "no_evidence", "unanswerable").when(c("reason") == "required_parts_covered", "answerable").otherwise("partial")
    sure = (
        F.when(status == "conflicting", 0.7).when(status == "unanswerable", 0.95).when(c("reason").startswith("answer_bearing"), 0.55)
        .when(status == "answerable", F.when(c("exact_title"), 0.9).otherwise(0.8)).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(0.75), ratio)))
    )
    return r.select("query_id", status.alias("status"), "reason", F.round(sure, 6).alias("confidence"))


def cited_claims(answers: DataFrame) -> DataFrame:
    """answers(answer_id, text) -> answer_id, claim_no, claim, evidence_ids: each sentence or line that cites evidence, without its marks."""
    cut = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), r"\n+")
    s = answers.select("answer_id", F.posexplode(cut).alias("at", "s"))
    ids = F.array_distinct(F.regexp_extract_all("s", F.lit(r"\[(S\d+)\]"), F.lit(1)))
    claim = F.regexp_replace(F.regexp_replace("s", r"\[S\d+\]", ""), r"^[ \t–—-]+|[ \t–—-]+$", "")
    s = s.select("answer_id", "at", F.left(claim, F.lit(4000)).alias("claim"), ids.alias("evidence_ids")).where((F.size("evidence_ids") > 0) & (F.col("claim") != ""))
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("at")).cast("long")
    return s.select("answer_id", n.alias("claim_no"), "claim", "evidence_ids")


def citation_verdicts(answers: DataFrame, claims: DataFrame, evidence: DataFrame, mode: str) -> DataFrame:
    """answers(answer_id, text), claims(answer_id, evidence_ids), evidence(answer_id, evidence_id) -> answer_id, status, cited, unknown,
    unsupported, phantom, citations_valid, valid. mode: strict; warn, which passes every answer; off, which checks none."""
    allowed = evidence.groupBy("answer_id").agg(F.collect_set("evidence_id").alias("allowed"))
    held = F.coalesce("allowed", F.array().cast("array<string>"))
    per = claims.join(allowed, "answer_id", "left").groupBy("answer_id").agg(
        F.count_if(~F.arrays_overlap("evidence_ids", held)).alias("unsupported"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array_except("evidence_ids", held))))).cast("long").alias("phantom")
    )
    cited = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(S\d+)\]"), F.lit(1)))
    on = F.lit(mode != "off")
    a = answers.join(allowed, "answer_id", "left").join(per, "answer_id", "left").select(
        "answer_id", F.size(cited).cast("long").alias("cited"), F.when(on, F.size(F.array_except(cited, held))).otherwise(0).cast("long").alias("unknown"),
        *(F.when(on, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("unsupported", "phantom")),
    )
    ok = (F.col("cited") > 0) & (F.col("unknown") == 0) & (F.col("unsupported") == 0) & (F.col("phantom") == 0)
    a = a.withColumn("citations_valid", ~on | ok)
    return a.select(
        "answer_id", F.lit("completed" if mode != "off" else "disabled_by_policy").alias("status"), "cited", "unknown", "unsupported", "phantom", "citations_valid",
        (F.col("citations_valid") | F.lit(mode == "warn")).alias("valid"),
    )


def block_status(verdicts: DataFrame, strict: bool = True) -> DataFrame:
    """verdicts(answer_id, status of each claim) -> answer_id, unsupported, contradicted, status: blocked if strict and any claim fails."""
    g = verdicts.groupBy("answer_id").agg(F.count_if(F.col("status") == "unsupported").alias("unsupported"), F.count_if(F.col("status") == "contradicted").alias("contradicted"))
    return g.withColumn("status", F.when(F.lit(strict) & (F.col("unsupported") + F.col("contradicted") > 0), "blocked").otherwise("completed"))


def root_cause(rows: DataFrame) -> DataFrame:
    """rows(id, abstained, blocked, citations_valid, n_evidence, gate, insufficient, validated) -> id, cause, category: the first that holds."""
    c = F.col
    checks = [
        ("model_output_contract_abstained", c("abstained")), ("claim_verification_blocked", c("blocked")), ("citation_validation_failed", ~c("citations_valid")),
        ("no_evidence_retrieved", c("n_evidence") == 0), ("conflicting_evidence", c("gate") == "conflicting"), ("answerability_unanswerable", c("gate") == "unanswerable"),
        ("partial_evidence", (c("gate") == "partial") | c("insufficient")), ("retrieval_evidence_available", ~c("validated")),
    ]
    r = rows.withColumn("cause", first_failure(checks, "answered_with_valid_citations"))
    kind = (
        F.when(c("cause").startswith("model"), "generation").when(c("cause").isin("claim_verification_blocked", "citation_validation_failed"), "verification")
        .when(c("cause") == "answered_with_valid_citations", "success").otherwise("retrieval")
    )
    return r.select("id", "cause", kind.alias("category"))
