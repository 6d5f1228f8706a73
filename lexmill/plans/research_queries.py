"""Queries on context selection, search in steps, and the records of research runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import research as R
from lexmill.operators import steps as S
from lexmill.operators.chunking import word_chunks
from lexmill.operators.ranking import small
from lexmill.operators.selection import fresh_questions, select_context
from lexmill.plans.catalog import query
from lexmill.plans.gate_queries import _FLAT, _sig
from lexmill.plans.relations import CASES, CHUNKS, cases, chunk_places, lexical, lexical_search, lexical_sql, norm, query_table, quoted, table, toks
from lexmill.storage import settled

_RUNS = (
    "runs AS (SELECT o_orderkey AS run_id, o_orderkey % 17 = 0 AS cancelled, o_orderkey % 13 = 0 AS paused, o_orderdate AS deadline, o_custkey % 9 AS episodes, o_custkey % 31 AS calls, "
    "o_orderkey % 5 AS stalled, o_custkey % 4 AS unfinished, o_custkey % 3 AS open_questions FROM orders)"
)


@query(
    f"WITH {_RUNS} SELECT run_id, CASE WHEN cancelled THEN 'cancel' WHEN paused THEN 'pause' WHEN deadline <= TIMESTAMP '1994-01-01' THEN 'finish_deadline' WHEN episodes >= 8 THEN 'finish_episode_budget' "
    "WHEN calls >= 30 THEN 'finish_call_budget' WHEN stalled >= 4 THEN 'recover' WHEN unfinished > 0 THEN 'resume' WHEN open_questions > 0 THEN 'next_question' ELSE 'finish' END AS action FROM runs"
)
def d_next_action(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = table(spark, sf_dir, "orders").select(
        k.alias("run_id"), (k % 17 == 0).alias("cancelled"), (k % 13 == 0).alias("paused"), F.col("o_orderdate").alias("deadline"), (c % 9).alias("episodes"), (c % 31).alias("calls"),
        (k % 5).alias("stalled"), (c % 4).alias("unfinished"), (c % 3).alias("open_questions"),
    )
    return R.next_action(runs, 8, 30, 4, F.lit("1994-01-01").cast("timestamp_ntz"))


@query(
    "SELECT event_id, CASE WHEN k IN ('timeout', 'network') THEN 'transient' WHEN k = 'http' AND s IN (408, 429, 503) THEN 'transient' WHEN s IN (401, 403) THEN 'security' "
    "WHEN k = 'value' THEN 'permanent' ELSE 'controller_bug' END AS error FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' WHEN 2 THEN 'http' WHEN 3 THEN 'value' ELSE 'other' END AS k, "
    "CASE user_id % 6 WHEN 0 THEN 408 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 403 ELSE 404 END AS s FROM events)"
)
def d_tool_errors(spark, sf_dir):
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (n % len(v) + 1).cast("int"))
    kind, status = pick(F.col("event_id"), "timeout", "network", "http", "value", "other"), pick(F.col("user_id"), 408, 429, 503, 401, 403, 404)
    return table(spark, sf_dir, "events").select("event_id", R.tool_error(kind, status).alias("error"))


@query(
    "SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS claim_no, CASE WHEN (c = 'conflicting' AND t <> '') OR v = 'contradicted' THEN 'conflicting' WHEN v = 'supported' THEN 'supported' WHEN v = 'partially_supported' THEN 'partial' ELSE 'unsupported' END AS status "
    "FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'contradicted' ELSE 'unsupported' END AS v, CASE WHEN l_suppkey % 3 = 0 THEN 'conflicting' ELSE 'covered' END AS c, "
    "CASE WHEN l_linenumber = 1 THEN '' ELSE 'claim' END AS t FROM lineitem)"
)
def d_claim_status(spark, sf_dir):
    verdict = F.element_at(F.array(*(F.lit(x) for x in ("supported", "partially_supported", "contradicted", "unsupported"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    covered, claim = F.when(F.col("l_suppkey") % 3 == 0, "conflicting").otherwise("covered"), F.when(F.col("l_linenumber") == 1, "").otherwise("claim")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("claim_no"), R.claim_status(verdict, covered, claim).alias("status"))


@query(
    "WITH c AS (SELECT l_orderkey AS run_id, 'q' || CAST(l_suppkey % 2 AS VARCHAR) AS question, l_linenumber AS n, '- part ' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_returnflag = 'A' THEN ' (partial)' ELSE '' END || ' [E' || CAST(l_suppkey AS VARCHAR) || ']' AS line "
    "FROM lineitem WHERE l_returnflag IN ('A', 'N')), q AS (SELECT run_id, min(n) AS first, count(*) AS n, '## ' || question || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n, line) AS block FROM c GROUP BY run_id, question) "
    "SELECT run_id, CAST(sum(n) AS BIGINT) AS n_claims, string_agg(block, chr(10) || chr(10) ORDER BY first, block) AS markdown FROM q GROUP BY run_id"
)
def d_report(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "partial").when(F.col("l_returnflag") == "N", "supported").otherwise("unsupported")
    as_text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    claims = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), as_text("q", F.col("l_suppkey") % 2).alias("question"), F.col("l_linenumber").alias("claim_no"),
        as_text("part ", F.col("l_partkey")).alias("text"), status.alias("status"), as_text("E", F.col("l_suppkey")).alias("reference"),
    )
    return R.report(claims)


@query(
    f"WITH {CASES} SELECT id, regexp_matches(lower(text), '{'|'.join(R.SEVERAL_STEPS)}') OR length(text) - length(replace(text, '?', '')) > 1 AS needed FROM cases "
    f"UNION ALL SELECT 1000 + conv_id * 100 + turn, regexp_matches(lower(text), '{'|'.join(R.SEVERAL_STEPS)}') OR length(text) - length(replace(text, '?', '')) > 1 FROM conversations"
)
def e_triggers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return cases(spark).unionByName(c).select("id", R.needs_steps(F.col("text")).alias("needed"))


_ASKED = f"{CASES}, q AS (SELECT * FROM cases UNION ALL SELECT 1000 + item_id, text FROM benchmark), f AS (SELECT id, {_FLAT} AS whole FROM q)"


@query(
    f"WITH {_ASKED}, e AS (SELECT id, list_concat([whole], list_filter(list_transform(string_split_regex(whole, '(?i)\\?|;|\\bvs\\b|\\bversus\\b'), lambda p: regexp_replace(p, '^[ ?]+|[ ?]+$', '', 'g')), lambda p: p <> '')) AS each FROM f), "
    f"v AS (SELECT id, flatten(list_transform(each, lambda p: [p, array_to_string(list_slice(list_filter({toks('p')}, lambda w: length(w) >= 6), 1, 6), ' ')])) AS vs FROM e), "
    f"k AS (SELECT id, vs, list_transform(vs, lambda v: {norm('v')}) AS ks FROM v), o AS (SELECT id, list_slice(list_filter(vs, lambda v, i: ks[i] <> '' AND list_position(ks, ks[i]) = i), 1, 6) AS once FROM k) "
    "SELECT id, generate_subscripts(once, 1) - 1 AS n, unnest(once) AS subquery FROM o"
)
def e_subqueries(spark, sf_dir):
    q = cases(spark).unionByName(query_table(spark, sf_dir).select((1000 + F.col("query_id")).alias("id"), "text"))
    return q.select("id", F.posexplode(R.subqueries(F.col("text"))).alias("n", "subquery")).select("id", F.col("n").cast("long").alias("n"), "subquery")


@query(
    f"WITH {_ASKED}, e AS (SELECT id, whole, list_filter(list_transform(string_split_regex(whole, ' и |\\?'), lambda p: regexp_replace(p, '^[ ?.]+|[ ?.]+$', '', 'g')), lambda p: p <> '') AS parts FROM f), "
    "v AS (SELECT id, CASE WHEN list_contains(parts, whole) THEN parts ELSE list_concat([whole], parts) END AS vs FROM e), k AS (SELECT id, vs, list_transform(vs, lambda v: lower(v)) AS ks FROM v), "
    "o AS (SELECT id, list_slice(list_filter(vs, lambda v, i: ks[i] <> '' AND list_position(ks, ks[i]) = i), 1, 8) AS once FROM k) "
    "SELECT id, generate_subscripts(once, 1) - 1 AS n, unnest(list_transform(once, lambda p: CASE WHEN ends_with(p, '?') THEN p ELSE p || '?' END)) AS question FROM o"
)
def d_topic_questions(spark, sf_dir):
    q = cases(spark).unionByName(query_table(spark, sf_dir).select((1000 + F.col("query_id")).alias("id"), "text"))
    return q.select("id", F.posexplode(R.topic_questions(F.col("text"))).alias("n", "question")).select("id", F.col("n").cast("long").alias("n"), "question")


@query(
    "WITH " + CHUNKS + ", " + lexical_sql() + ", f AS (SELECT item_id AS query_id, " + _FLAT + " AS flat FROM benchmark), "
    "l AS (SELECT *, list_filter(list_transform(string_split_regex(flat, '(?i)\\?|;|\\bvs\\b|\\bversus\\b'), lambda p: trim(p, ' ?!.')), lambda p: len(" + _sig("p") + ") > 0) AS parts FROM f), "
    "p AS (SELECT query_id, unnest(CASE WHEN len(parts) <= 1 THEN [flat] ELSE list_slice(parts, 1, 6) END) AS part FROM l), n AS (SELECT *, row_number() OVER () AS part_no FROM p), "
    f"t AS (SELECT n.query_id, part_no, list_distinct({toks('part')}) AS q, list_distinct({toks('h.content')}) AS c FROM n LEFT JOIN hits h ON h.query_id = n.query_id), "
    "x AS (SELECT query_id, part_no, coalesce(max(CAST(len(q) > 0 AND len(list_intersect(q, c)) = len(q) AS INTEGER)), 0) AS whole, coalesce(max(CAST(len(list_filter(list_intersect(q, c), lambda w: length(w) >= 5)) > 0 AS INTEGER)), 0) AS part FROM t GROUP BY query_id, part_no) "
    "SELECT query_id, avg(CASE WHEN whole = 1 THEN 1.0::DOUBLE WHEN part = 1 THEN 0.5 ELSE 0.0 END) AS ratio FROM x GROUP BY query_id"
)
def e_coverage(spark, sf_dir):
    return R.coverage_ratio(R.coverage(query_table(spark, sf_dir), lexical(spark, sf_dir)))


@query()
def e_step_search(spark, sf_dir):
    """The evidence of all four steps beside each query's state."""
    search = lambda q: lexical_search(spark, sf_dir, q, 10, columns=("content",))
    evidence, state = R.step_search(query_table(spark, sf_dir), search)
    return evidence.select("query_id", "chunk_id", "step", "score").join(state, "query_id", "right")


#: A bridge question and two that lack one of its ends, beside the passages, which are no questions of this kind.
BRIDGES = (
    "Название которой серии жилых домов начинается с тех же цифр, что год документального фильма, вышедшего в мае 1999", "Какой фильм вышел в 2003 и в 2010",
    "В какой серии дом", "Документальные фильмы января",
)


def _questions(spark, sf_dir):
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(BRIDGES)], "query_id long, text string")
    return query_table(spark, sf_dir).unionByName(own)


def _has_sql(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_MONTH = "CASE " + " ".join(f"WHEN contains(q, '{stem}') THEN '{form}'" for stem, form in S.MONTHS) + " END"
_BRIDGE = (
    "asked AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(CAST({-1 - i} AS BIGINT), {quoted(t)})" for i, t in enumerate(BRIDGES)) + ") AS v(a, b)), "
    f"low AS (SELECT query_id, lower(text) AS q FROM asked), marks AS (SELECT query_id, q, {_MONTH} AS month, nullif(regexp_extract(q, '(^|[^0-9a-zа-я])((19|20)[0-9][0-9])($|[^0-9a-zа-я])', 2), '') AS year FROM low), "
    f"ends AS (SELECT query_id, CASE WHEN {_has_sql('q', 'документаль', 'фильм')} AND month IS NOT NULL AND year IS NOT NULL THEN ['документальный фильм ' || month || ' ' || year, 'фильм вышедший в ' || month || ' ' || year] "
    f"WHEN {_has_sql('q', 'документаль', 'фильм')} AND year IS NOT NULL THEN ['документальный фильм ' || year] ELSE [] END AS f, "
    f"CASE WHEN contains(q, 'сери') AND {_has_sql('q', 'жил', 'дом', 'здани')} THEN ['серия жилых домов', 'серия жилых домов город'] ELSE [] END AS s, "
    "CASE WHEN contains(q, 'цифр') AND contains(q, 'назван') THEN ['название начинается с тех же цифр'] ELSE [] END AS d FROM marks)"
)


@query(f"WITH {_BRIDGE}, o AS (SELECT query_id, list_concat(list_concat(list_concat(f[1:1], s[1:1]), list_concat(f[2:], s[2:])), d) AS all_ FROM ends) SELECT query_id, generate_subscripts(all_, 1)::BIGINT AS n, unnest(all_) AS subquery FROM o")
def e_bridge_queries(spark, sf_dir):
    """Templates for both ends of a bridge question."""
    found = _questions(spark, sf_dir).select("query_id", F.posexplode(S.bridge_queries(F.col("text"))).alias("n", "subquery"))
    return found.select("query_id", (F.col("n") + 1).cast("long").alias("n"), "subquery")


@query()
def e_evidence_steps(spark, sf_dir):
    """Every step of every passage's search: what it asked, what it found, the coverage after it, the final evidence's size and why the search ended."""
    search = lambda q: lexical_search(spark, sf_dir, q, 8, columns=("doc_id", "content"))
    documents = table(spark, sf_dir, "documents")

    def neighbours(hits):
        at = settled(chunk_places(spark, sf_dir).join(small(hits), "chunk_id").select("query_id", "doc_id", "ordinal"), "beside")
        c = word_chunks(documents.join(small(at.select("doc_id").distinct(), at), "doc_id", "left_semi")).select("chunk_id", "doc_id", "ordinal", "content")
        at = at.select("query_id", "doc_id", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal"))
        return at.join(c, ["doc_id", "ordinal"])

    log, evidence, state = S.search_steps(_questions(spark, sf_dir), search, neighbours)
    final = S.final_evidence(evidence, 12, ambiguous=True).groupBy("query_id").agg(F.count("*").alias("evidence"))
    return log.join(state.select("query_id", "stop"), "query_id", "right").join(final, "query_id", "left")


@query()
def r_select_context(spark, sf_dir):
    """Contents of under 60 words give way to the document's first 400."""
    q = query_table(spark, sf_dir).withColumnRenamed("text", "query")
    parents = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 400), " ").alias("parent"))
    c = lexical(spark, sf_dir).join(q, "query_id").join(parents, "doc_id")
    c = c.select("query_id", "query", "rank", "chunk_id", "doc_id", F.col("source").alias("page"), F.col("source").alias("title"), "content", "parent")
    return select_context(c, budget=1500, short=60)


@query()
def w_fresh_questions(spark, sf_dir):
    return fresh_questions(table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 100 + F.col("turn")), "role", "key", "text").select("role", "key")


@query(
    f"WITH {CHUNKS}, {lexical_sql()}, u AS (SELECT query_id, chunk_id, score, 'a' AS tool FROM hits UNION ALL SELECT query_id, chunk_id, score, 'b' FROM hits WHERE rank <= 5) "
    "SELECT query_id, chunk_id, max(score) AS score, 'a' AS tool FROM u GROUP BY query_id, chunk_id"
)
def d_best_per_chunk(spark, sf_dir):
    h = lexical(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")
    both = h.withColumn("tool", F.lit("a")).unionByName(h.where("rank <= 5").withColumn("tool", F.lit("b"))).drop("rank")
    return R.best_per_chunk(both, ["query_id", "chunk_id"], "score", "tool")
