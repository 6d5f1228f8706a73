"""Looking things up: fields of records, pages of results, search inside documents, several bases, events and task checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.answers import first_failure
from lexmill.operators.ranking import ranked, rrf, small
from lexmill.storage import settled

# Fixed values.
SCORES = ("rerank", "fusion", "rrf_total", "dense", "bm25")
HINTS = (
    "alias", "runbook", "owner", "incident readiness", "override", "telemetry", "data residency", "waiver", "blocked", "budget", "scope", "cost center",
)
GENERIC = (
    r"^что (известно|говорится) о статье", r"^сравни,? что говорится", r"^расскажи о статье", r"в (данном|этом) документ", r"по (данному|этому) текст", r"что сказано в статье",
)
EMPTY_ANSWERS = ("", "неизвестно", "не указано", "недостаточно evidence")
MASKED = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})|(\b\d{6,}\b)"
MAX_WINDOW = 1000


def field_values(meta: Column, title: Column, url: Column) -> dict[str, Column]:
    """What filters read, from a map of metadata: the first key that has a value."""

    def first(*keys: str) -> Column:
        return F.trim(F.coalesce(*(F.try_element_at(meta, F.lit(k)) for k in keys), F.lit("")))

    blob = [F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in ("source_kind", "source_type", "source_id", "source_uri", "filename")]
    return {
        "document_type": first("content_type", "detected_mime", "source_type"),
        "language": first("language", "detected_language"),
        "document_date": first("document_date"),
        "source_kind": first("source_kind", "source_type"),
        "source": F.concat_ws(" ", *blob, F.nullif(url, F.lit("")), F.nullif(title, F.lit(""))),
        "title": F.trim(F.coalesce(title, F.lit(""))),
    }


def best_score(scores: Column) -> Column:
    """Of a map of scores: the first that exists by stage, else the highest, else 0."""
    return F.coalesce(*(F.try_element_at(scores, F.lit(k)) for k in SCORES), F.array_max(F.map_values(scores)), F.lit(0.0))


def encode_cursor(offset: Column, fingerprint: Column) -> Column:
    body = F.concat(F.lit('{"offset":'), offset.cast("string"), F.lit(',"version":2,"fingerprint":"'), fingerprint, F.lit('"}'))
    return F.rtrim(F.translate(F.base64(body.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """struct(offset, fingerprint); what can't be read is the first page without a fingerprint."""
    plain = F.translate(F.coalesce(cursor, F.lit("")), "-_", "+/")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    x = F.from_json(text, "offset long, version long, fingerprint string", {"mode": "PERMISSIVE"})
    offset = F.greatest(F.lit(0), F.least(F.lit(MAX_WINDOW), F.coalesce(x["offset"], F.lit(0))))
    return F.struct(offset.cast("long").alias("offset"), F.when(x["version"] == 2, x["fingerprint"]).alias("fingerprint"))


def pages(hits: DataFrame, requests: DataFrame, size: int) -> DataFrame:
    """hits(query_id, rank, ...), requests(query_id, cursor, fingerprint) -> the hits of each request's page + next_cursor (null on the last).

    A cursor of another fingerprint is stale: an empty page. No page reaches beyond the window.
    """
    r = requests.withColumn("c", decode_cursor(F.col("cursor"))).where(F.col("c.fingerprint").isNull() | (F.col("c.fingerprint") == F.col("fingerprint")))
    r = r.select("query_id", "fingerprint", F.col("c.offset").alias("offset"))
    x = hits.join(r, "query_id").where((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + size + 1) & (F.col("rank") <= MAX_WINDOW))
    more = F.max("rank").over(Window.partitionBy("query_id")) > F.col("offset") + size
    x = x.withColumn("next_cursor", F.when(more, encode_cursor(F.col("offset") + size, F.col("fingerprint"))))
    return x.where(F.col("rank") <= F.col("offset") + size).select(*hits.columns, "next_cursor")


def inside_documents(chunks: DataFrame, requests: DataFrame, size: int) -> DataFrame:
    """chunks(chunk_id, doc_id, ordinal, title, path, content), requests(request_id, doc_id, query) -> request_id, chunk_id, score, rank:
    substring matches in one document, title before path before content, then by place. No query counts as a pattern."""
    x = chunks.join(requests, "doc_id")
    needle = F.lower(F.trim("query"))
    parts = [F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), needle), w).otherwise(0.0) for c, w in (("title", 4.0), ("path", 2.0), ("content", 1.0))]
    x = x.select("request_id", "chunk_id", F.coalesce("ordinal", F.lit(2147483647)).alias("ordinal"), (parts[0] + parts[1] + parts[2]).alias("score")).where("score > 0")
    return ranked(x, "score", ["ordinal", "chunk_id"], ["request_id"], size).select("request_id", "chunk_id", "score", "rank")


def over_bases(lanes: DataFrame, per_base: int, k: int) -> DataFrame:
    """lanes(query_id, lane, base_id, doc_id, chunk_id, score) -> fused over all bases: every base ranks by itself in each lane, fusion doesn't know bases."""
    own = ranked(lanes, "score", ["doc_id", "chunk_id"], ["query_id", "lane", "base_id"], per_base)
    return rrf(own, ["query_id"], ["base_id", "doc_id", "chunk_id"]).where(F.col("rank") <= k)


def scope_markers(documents: DataFrame, scopes: DataFrame) -> DataFrame:
    """documents(base_id, updated_at), scopes(scope_id, base_id) -> scope_id, marker: the latest change of any of its bases, or 'none'."""
    latest = documents.groupBy("base_id").agg(F.max("updated_at").alias("at"))
    return scopes.join(latest, "base_id", "left").groupBy("scope_id").agg(F.coalesce(F.max("at").cast("string"), F.lit("none")).alias("marker"))


def numbered_events(events: DataFrame, run: str, order: list[str], after: dict[str, int] | None = None) -> DataFrame:
    """events + sequence: from 1 in each run, in order. Only rows of one run meet in one window."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))


def masked(text: Column, most: int) -> Column:
    """Mail addresses and long numbers masked, then cut."""
    return F.left(F.regexp_replace(text, MASKED, "[masked]"), F.lit(most))


def answer_leaks(question: Column, answer: Column) -> Column:
    """A reference answer of four and more tokens that the question nearly spells out."""
    a, q = T.distinct_tokens(answer), T.distinct_tokens(question)
    return (F.size(a) >= 4) & (T.jaccard(a, q) > 0.65)


def rejection(t: DataFrame) -> DataFrame:
    """Tasks(task_id, question, answer, split, review, unanswerable, n_spans, span_ok, overlap, multi_hop, n_documents) -> task_id, reason ('' if none).

    Of tasks with one question the first by id stays.
    """
    c = F.col
    seen = F.row_number().over(Window.partitionBy("question").orderBy("task_id")) > 1
    checks = [
        ("duplicate_question", c("seen")), ("local_validation_rejected", (F.length("question") < 12) | (c("split") != "train") | (c("review") != "unreviewed")),
        ("answer_leak", answer_leaks(c("question"), c("answer"))), ("missing_source_span", ~c("unanswerable") & (c("n_spans") == 0)),
        ("negative_gold_overlap", c("overlap")), ("invalid_multi_hop", c("multi_hop") & (c("n_documents") < 2)), ("local_validation_rejected", ~c("span_ok")),
    ]
    return t.withColumn("seen", seen).select("task_id", first_failure(checks, "").alias("reason"))


def task_faults(question: Column, answer: Column, unanswerable: Column, n_gold: Column) -> Column:
    """The first reason why a generated task is none, or ''."""
    flat = F.lower(F.trim(F.regexp_replace(question, T.SPACE, " ")))
    plain = F.trim(F.lower(answer))
    weak = plain.isin(*EMPTY_ANSWERS) | ~plain.rlike(r"[\p{L}\p{N}_]")
    checks = [
        ("short", F.length(question) < 12), ("generic", flat.rlike("|".join(GENERIC))), ("no_gold", ~unanswerable & ((n_gold == 0) | (answer == ""))),
        ("weak_answer", ~unanswerable & weak), ("leak", answer_leaks(question, answer)),
    ]
    return first_failure(checks, "")


def comparison_operands(question: Column, titles: Column) -> Column:
    """How many different titles a question names."""
    flat = lambda x: F.lower(F.trim(F.regexp_replace(x, T.SPACE, " ")))
    forms = F.array_distinct(F.transform(titles, flat))
    return F.size(F.filter(forms, lambda t: (t != "") & F.contains(flat(question), t)))


def entities(text: Column) -> Column:
    """Codes such as AB-12, then phrases of two or three capitalised Latin words; each once whatever its case."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}[A-Z0-9]*-\d+\b"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z0-9-]*(?:[\x20\x09-\x0D]+[A-Z][A-Za-z0-9-]*){1,2}\b"), F.lit(0)))
    found = F.transform(found, lambda x: F.trim(F.regexp_replace(x, T.SPACE, " ")))
    keys = F.transform(found, F.lower)
    return F.filter(found, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def derived_questions(current: Column, text: Column, most: int = 3) -> Column:
    """Questions about entities of a text that differ from the current one."""
    asked = F.transform(entities(text), lambda e: F.concat(F.lit("Что известно про "), e, F.lit(" в контексте текущего исследования?")))
    return F.slice(F.filter(asked, lambda q: T.normalize(q) != T.normalize(current)), 1, most)


def planned_query(current: Column, text: Column, most: int = 500) -> Column:
    """The question with entities and hints of what is known so far, each once by its normal form."""
    hints = F.filter(F.array(*(F.when(F.contains(F.lower(text), F.lit(h)), F.lit(h)) for h in HINTS)), lambda h: h.isNotNull())
    parts = F.concat(F.array(current), F.slice(entities(text), 1, 8), F.slice(hints, 1, 6))
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, T.SPACE, " ")))
    forms = F.transform(parts, T.normalize)
    once = F.filter(parts, lambda p, i: (p != "") & (F.array_position(forms, T.normalize(p)) == i + 1))
    return F.left(F.array_join(once, " "), F.lit(most))


def matching_lines(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """documents(doc_id, text), requests(request_id, doc_id, query) -> request_id, doc_id, line_no (from 1), hits: lines with a significant term of the query. Where requests are few they go to the documents, whose texts stay where they are."""
    asked = settled(requests.select("request_id", "doc_id", T.significant_terms(F.col("query")).alias("terms")), "asked")
    x = documents.select("doc_id", "text").join(small(asked), "doc_id")
    x = x.select("request_id", "doc_id", "terms", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    x = x.select("request_id", "doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), F.size(F.array_intersect("terms", T.tokens(F.col("line")))).cast("long").alias("hits"))
    return x.where("hits > 0")


def bound_titles(asked: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """asked(id, title), titles(title, doc_id), redirects(title, target) -> id, doc_id (the least), state: exact, redirect, ambiguous (several documents) or missing.

    Titles meet in their normal form; a redirect counts only where no title does, and one step of it.
    """
    form = lambda c: T.normalize(F.col(c))
    own = titles.groupBy(form("title").alias("k")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id"))
    via = redirects.select(form("title").alias("r"), form("target").alias("k")).distinct().join(own, "k").groupBy("r").agg(F.sum("n").alias("rn"), F.min("doc_id").alias("rdoc"))
    a = asked.select("id", form("title").alias("k")).join(own, "k", "left").join(via, F.col("k") == F.col("r"), "left")
    n = F.coalesce("n", "rn")
    state = F.when(n.isNull(), "missing").when(n > 1, "ambiguous").when(F.col("n").isNotNull(), "exact").otherwise("redirect")
    return a.select("id", F.coalesce("doc_id", "rdoc").alias("doc_id"), state.alias("state"))


def bound_quotes(quotes: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """quotes(quote_id, doc_id, quote), chunks(chunk_id, doc_id, ordinal, content) -> quote_id, first_chunk, n_chunks (null: not bound), matches.

    A quote belongs to the one chunk of its document that contains it, else to the one shortest span of up to ``most`` chunks in a row, joined
    without a separator. Several matches bind nothing.
    """
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    spans = chunks.select("doc_id", "chunk_id", F.array("content", *(F.lead("content", k).over(w) for k in range(1, most))).alias("c"))
    spans = spans.select("doc_id", "chunk_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.get("c", n - 1).isNotNull(), F.array_join(F.slice(F.col("c"), F.lit(1), n), "")))).alias("k", "text"))
    hit = quotes.join(spans, "doc_id").where(F.contains("text", "quote")).select("quote_id", "chunk_id", (F.col("k") + 1).cast("long").alias("n"))
    least = hit.groupBy("quote_id").agg(F.min("n").alias("least"))
    g = hit.join(least, "quote_id").where("n = least").groupBy("quote_id", "n").agg(F.count("*").alias("matches"), F.min("chunk_id").alias("chunk_id"))
    one = F.col("matches") == 1
    return quotes.select("quote_id").join(g, "quote_id", "left").select("quote_id", F.when(one, F.col("chunk_id")).alias("first_chunk"), F.when(one, F.col("n")).alias("n_chunks"), F.coalesce("matches", F.lit(0)).alias("matches"))
