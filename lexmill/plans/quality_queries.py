"""Queries on task checks, rollups that keep zeros, splits, rank functions and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import quality as Q
from lexmill.operators.ranking import first_per
from lexmill.plans.catalog import query
from lexmill.plans.evaluation_queries import _HITS, _TASKS, _tasks
from lexmill.plans.relations import CASES, CHUNKS, cases, chunks, lexical, lexical_sql, gold, query_table, table, toks

_CAUSES = ("answer", "citation", "context", "fusion", "index", "none", "rerank", "retrieval")
_LEAK = f"len(list_intersect(list_distinct(list_filter({toks('answer')}, lambda w: length(w) > 2)), list_filter({toks('question')}, lambda w: length(w) > 2)))"
_PAIRS = "p AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))


@query(
    f"WITH {_HITS}, h AS (SELECT g.query_id, g.doc_id, max(CAST(o.rank <= 10 AS INTEGER)) AS hit FROM gold g LEFT JOIN once o ON g.query_id = o.query_id AND g.doc_id = o.doc_id GROUP BY g.query_id, g.doc_id) "
    "SELECT query_id AS task_id, count(*) AS hops, avg(coalesce(hit, 0)) AS recall, min(coalesce(hit, 0)) = 1 AS complete FROM h GROUP BY query_id"
)
def m_hops(spark, sf_dir):
    """Every gold document is a hop."""
    g = gold(spark, sf_dir).select(F.col("query_id").alias("task_id"), F.col("doc_id").alias("hop"), "doc_id")
    return Q.hop_recall(g, lexical(spark, sf_dir).where("rank <= 10").select(F.col("query_id").alias("task_id"), "doc_id"))


@query(
    f"WITH {_PAIRS}, a AS (SELECT *, len(list_distinct(list_filter({toks('answer')}, lambda w: length(w) > 2))) AS n FROM p WHERE answer IS NOT NULL) "
    f"SELECT conv_id, turn, CASE WHEN n = 0 THEN 0.0 ELSE round({_LEAK} / n, 6) END AS leak FROM a"
)
def m_leak(spark, sf_dir):
    return _turns(spark, sf_dir).where("answer is not null").select("conv_id", "turn", F.round(Q.leak(F.col("question"), F.col("answer")), 6).alias("leak"))


@query(
    f"WITH {_PAIRS}, a AS (SELECT *, conv_id % 3 = 0 AS un, turn % 4 AS g, len(list_distinct(list_filter({toks('answer')}, lambda w: length(w) > 2))) AS n, len({toks('answer')}) AS size FROM p WHERE answer IS NOT NULL) "
    f"SELECT conv_id, turn, CASE WHEN length(question) < 12 THEN 'short_question' WHEN NOT un AND (g = 0 OR answer = '') THEN 'no_gold' WHEN NOT un AND size < 2 THEN 'weak_answer' WHEN n > 0 AND {_LEAK} / n > 0.65 THEN 'answer_leak' END AS fault FROM a"
)
def m_task_faults(spark, sf_dir):
    t = _turns(spark, sf_dir).where("answer is not null")
    return t.select("conv_id", "turn", Q.task_fault(F.col("question"), F.col("answer"), F.col("conv_id") % 3 == 0, F.col("turn") % 4).alias("fault"))


@query(
    "WITH r AS (SELECT *, o_custkey % 300 AS c FROM orders), v AS (SELECT o_orderkey, 'PRICE_RANGE' AS code FROM r WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'STATUS_OPEN' FROM r WHERE o_orderstatus = 'P' "
    "UNION ALL SELECT o_orderkey, 'CUSTOMER_UNKNOWN' FROM r WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) SELECT o_orderkey AS task_id, code FROM v"
)
def m_suite_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), "o_totalprice", "o_orderstatus", (F.col("o_custkey") % 300).alias("customer"))
    checks = [("PRICE_RANGE", F.col("o_totalprice") > 300000), ("STATUS_OPEN", F.col("o_orderstatus") == "P")]
    return Q.violations(o, "task_id", checks, [("CUSTOMER_UNKNOWN", "customer", table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), "c_custkey")])


@query(
    "WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_changes' ELSE 'approved' END AS s, CASE user_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'request_changes' ELSE 'resubmit' END AS a FROM events) "
    "SELECT event_id, CASE WHEN s = 'pending' THEN CASE a WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'request_changes' THEN 'needs_changes' ELSE s END WHEN s = 'needs_changes' AND a = 'resubmit' THEN 'pending' ELSE s END AS status FROM t"
)
def m_review_status(spark, sf_dir):
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (n % len(v) + 1).cast("int"))
    s, a = pick(F.col("event_id"), "pending", "needs_changes", "approved"), pick(F.col("user_id"), "approve", "reject", "request_changes", "resubmit")
    return table(spark, sf_dir, "events").select("event_id", Q.review_status(s, a).alias("status"))


@query(
    f"WITH {CHUNKS}, {lexical_sql()} SELECT query_id AS task_id, CAST(min(CASE WHEN doc_id % 3 = 0 THEN rank END) - min(CASE WHEN doc_id % 3 = 1 THEN rank END) AS BIGINT) AS margin FROM hits GROUP BY query_id"
)
def m_rank_margin(spark, sf_dir):
    h = lexical(spark, sf_dir).select(F.col("query_id").alias("task_id"), "rank", (F.col("doc_id") % 3 == 1).alias("gold"), (F.col("doc_id") % 3 == 0).alias("hard"))
    return Q.margins(h)


@query(f"WITH {_TASKS} SELECT family, language, string_agg(DISTINCT config, ',' ORDER BY config) AS contracts FROM tasks GROUP BY family, language HAVING count(DISTINCT config) > 1")
def g_contract_mix(spark, sf_dir):
    return Q.contract_mixes(_tasks(spark, sf_dir), ["family", "language"], "config").withColumn("contracts", F.array_join("contracts", ","))


@query(
    f"WITH c(cause, k) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {i})' for i, c in enumerate(_CAUSES))}), n AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'none' WHEN 'P' THEN 'index' ELSE 'rerank' END AS cause, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT c.cause, coalesce(n.n, 0) AS n FROM c LEFT JOIN n ON c.cause = n.cause"
)
def g_root_causes(spark, sf_dir):
    cause = F.when(F.col("o_orderstatus") == "F", "none").when(F.col("o_orderstatus") == "P", "index").otherwise("rerank")
    return Q.cause_counts(table(spark, sf_dir, "orders").select(cause.alias("cause")), "cause", _CAUSES)


@query(
    f"WITH {_TASKS}, g AS (SELECT family AS policy, bool_and(score < 0.99 OR status = 'completed') AS all_passed, bool_or(status = 'failed' AND score > 0.97) AS any_leak, round(avg(score), 6) AS recall, CAST(sum(task_id % 1000) AS BIGINT) AS tokens, max(task_id % 1000) AS most_tokens FROM tasks GROUP BY family) "
    "SELECT *, row_number() OVER (ORDER BY all_passed DESC, any_leak, recall DESC, tokens, policy) AS place FROM g"
)
def g_policy_ranking(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    done = F.col("status") == "completed"
    return Q.policy_ranking(t.select(F.col("family").alias("policy"), ((F.col("score") < 0.99) | done).alias("passed"), (~done & (F.col("score") > 0.97)).alias("leaked"), F.col("score").alias("recall"), (F.col("task_id") % 1000).alias("tokens")))


@query("SELECT source, lang, count(*) AS n_docs, count(text) AS n_texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang")
def g_corpus_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query(
    f"WITH {_TASKS} SELECT split, count(*) AS n_tasks, round(avg(CAST(status = 'completed' AS INTEGER)), 6) AS completion, "
    "round(coalesce(count(CASE WHEN expected = 'unanswerable' AND predicted <> 'unanswerable' THEN 1 END) / nullif(count(CASE WHEN expected = 'unanswerable' THEN 1 END), 0), 0.0), 6) AS false_answers FROM tasks GROUP BY split"
)
def g_completion(spark, sf_dir):
    none = F.col("expected") == "unanswerable"
    false = F.avg(F.when(none, (F.col("predicted") != "unanswerable").cast("int")))
    return _tasks(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n_tasks"), F.round(F.avg((F.col("status") == "completed").cast("int")), 6).alias("completion"), F.round(F.coalesce(false, F.lit(0.0)), 6).alias("false_answers")
    )


@query(
    f"WITH {_TASKS}, n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha1(CAST(task_id AS VARCHAR)), task_id) AS n FROM tasks) "
    "SELECT task_id, family, CASE WHEN n <= 40 THEN 'dev' WHEN n <= 200 THEN 'test' ELSE 'unused' END AS split FROM n"
)
def w_locked_split(spark, sf_dir):
    return Q.locked_split(_tasks(spark, sf_dir), ["family"], F.col("task_id"), 40, 160).select("task_id", "family", "split")


@query(
    "WITH p AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, p_brand, count(*) OVER (PARTITION BY p_brand) AS size FROM part), "
    "k AS (SELECT s_suppkey AS packet, s_suppkey % 5 AS attempt FROM supplier) SELECT k.packet, p.p_brand AS pool, p.p_partkey AS picked FROM k JOIN p ON p.n = k.attempt % p.size"
)
def w_cyclic(spark, sf_dir):
    """Every packet's attempt picks from each pool, cyclically."""
    w = Window.partitionBy("p_brand")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("n"), F.count("*").over(w).alias("size"))
    sizes = p.select("p_brand", "size").distinct()
    k = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("attempt")).agg(F.collect_list("s_suppkey").alias("packets"))
    wanted = sizes.join(k, F.lit(True)).withColumn("n", (F.col("attempt") % F.col("size")).cast("int"))  # pools by five attempts
    return wanted.join(p.drop("size"), ["p_brand", "n"]).select(F.explode("packets").alias("packet"), F.col("p_brand").alias("pool"), F.col("p_partkey").alias("picked"))


@query(
    f"WITH {CHUNKS}, {lexical_sql()}, f AS (SELECT b.item_id AS query_id, min(h.rank) AS rank FROM benchmark b LEFT JOIN hits h ON b.item_id = h.query_id AND h.doc_id % 4 = 0 GROUP BY b.item_id) "
    "SELECT query_id, rank, CASE WHEN rank IS NULL THEN 'not_retrieved' WHEN rank > 5 THEN 'low_rank' ELSE 'not_first' END AS reason FROM f WHERE rank IS NULL OR rank > 1 ORDER BY rank IS NULL DESC, rank DESC, query_id LIMIT 50"
)
def w_misses(spark, sf_dir):
    """The 50 worst misses with their reason; every fourth document is gold."""
    hit = lexical(spark, sf_dir).where("doc_id % 4 = 0").groupBy("query_id").agg(F.min("rank").cast("long").alias("rank"))
    m = query_table(spark, sf_dir).select("query_id").join(hit, "query_id", "left").where("rank is null or rank > 1")
    reason = F.when(F.col("rank").isNull(), "not_retrieved").when(F.col("rank") > 5, "low_rank").otherwise("not_first")
    return m.select("query_id", "rank", reason.alias("reason")).orderBy(F.desc_nulls_first("rank"), "query_id").limit(50)


@query(
    "SELECT doc_id, source, regexp_replace(left(text, 40), '[0-9]+', '#', 'g') AS masked, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_doc FROM documents"
)
def w_adjacent(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.regexp_replace(F.left("text", F.lit(40)), "[0-9]+", "#").alias("masked"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next_doc"))


@query(
    "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q, "
    "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW), 2) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"
)
def w_rank_frames(spark, sf_dir):
    """Rank functions and a range frame of 90 days; an addition for the relational tables."""
    c = Window.partitionBy("o_custkey")
    by = c.orderBy("o_orderpriority")
    days = c.orderBy("_day").rangeBetween(-90 * 86400, 0)
    o = table(spark, sf_dir, "orders").withColumn("_day", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return o.select(
        "o_orderkey", F.rank().over(by).cast("long").alias("r"), F.dense_rank().over(by).cast("long").alias("d"), F.ntile(4).over(c.orderBy("o_totalprice", "o_orderkey")).cast("long").alias("q"),
        F.round(F.sum("o_totalprice").over(days), 2).alias("recent"),
    )


@query(
    "(SELECT c_custkey AS id, 'both' AS kind FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders) UNION ALL (SELECT c_custkey, 'idle' FROM customer EXCEPT SELECT o_custkey, 'idle' FROM orders)"
)
def u_set_operations(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return c.intersect(o).withColumn("kind", F.lit("both")).unionByName(c.join(o, "id", "left_anti").distinct().withColumn("kind", F.lit("idle")))


@query(
    "WITH r AS (SELECT page_id, 'T' || CAST(page_id % 40 AS VARCHAR) AS target FROM pages WHERE page_id % 3 = 0) "
    "SELECT p.page_id, count(r.page_id) AS n_aliases FROM pages p LEFT JOIN r ON 'T' || CAST(p.page_id AS VARCHAR) = r.target GROUP BY p.page_id"
)
def j_redirect(spark, sf_dir):
    """Redirects joined to the page whose title they name."""
    p = table(spark, sf_dir, "pages").select("page_id")
    name = lambda n: F.concat(F.lit("T"), n.cast("string"))
    r = p.where("page_id % 3 = 0").groupBy(name(F.col("page_id") % 40).alias("title")).agg(F.count("*").alias("n"))
    return p.withColumn("title", name(F.col("page_id"))).join(r, "title", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_aliases"))


@query(
    f"WITH {CHUNKS}, {lexical_sql()}, s AS (SELECT h.query_id, h.chunk_id, len(list_intersect(list_distinct({toks('b.text')}), {toks('h.content')})) / greatest(1, least(120, len(list_distinct({toks('b.text')})))) AS overlap FROM hits h JOIN benchmark b ON h.query_id = b.item_id) "
    "SELECT query_id, chunk_id, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_id) AS n FROM s) WHERE n = 1"
)
def j_best_overlap(spark, sf_dir):
    """Each query's candidate chunk with the largest share of the query's tokens."""
    x = lexical(spark, sf_dir).join(query_table(spark, sf_dir), "query_id")
    a = T.distinct_tokens(F.col("text"))
    share = F.size(F.array_intersect(a, T.tokens(F.col("content")))) / F.greatest(F.lit(1), F.least(F.lit(120), F.size(a)))
    return first_per(x.select("query_id", "chunk_id", share.alias("overlap")), ["query_id"], [F.desc("overlap"), F.col("chunk_id")]).select("query_id", "chunk_id", F.round("overlap", 6).alias("overlap"))


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT c.c_custkey AS task_id, r.event_id AS result_id, r.event_type AS outcome FROM customer c LEFT JOIN r ON c.c_custkey = r.user_id AND r.n = 1"
)
def j_last_write(spark, sf_dir):
    """Each task with its last result."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.max(F.struct("event_id", "event_type")).alias("r"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")).join(e, "task_id", "left").select("task_id", F.col("r.event_id").alias("result_id"), F.col("r.event_type").alias("outcome"))


@query(
    f"WITH {CASES}, {CHUNKS}, x AS (SELECT id, 1 AS depth, text AS content, CASE id % 4 WHEN 0 THEN 'Река (значения)' WHEN 1 THEN '1999 год' ELSE 'Title' END AS title FROM cases "
    "UNION ALL SELECT 1000 + doc_id * 1000 + ordinal, CASE WHEN ordinal > 0 THEN 2 ELSE 1 END, content, 'Title' FROM chunks UNION ALL SELECT 1, 1, 'Вот список рек', 't' UNION ALL SELECT 2, 1, 'Таблица: строка', 't' UNION ALL SELECT 3, 1, 'его жанр драма', 't') "
    "SELECT id, CASE WHEN contains(lower(title), '(значения)') OR title = '1999 год' THEN 'ambiguous_title' WHEN depth > 1 THEN 'deep_section' WHEN contains(lower(content), ' список') THEN 'list_like' WHEN lower(content) LIKE 'таблица%' THEN 'table_like' "
    "WHEN contains(lower(content), ' жанр ') THEN 'infobox_like' ELSE 'prose' END AS structure FROM x"
)
def c_structure(spark, sf_dir):
    i = F.col("id")
    one = cases(spark).select("id", F.lit(1).alias("depth"), F.col("text").alias("content"), F.when(i % 4 == 0, "Река (значения)").when(i % 4 == 1, "1999 год").otherwise("Title").alias("title"))
    two = chunks(spark, sf_dir).select((1000 + F.col("doc_id") * 1000 + F.col("ordinal")).alias("id"), F.when(F.col("ordinal") > 0, 2).otherwise(1).alias("depth"), "content", F.lit("Title").alias("title"))
    three = spark.createDataFrame([(1, 1, "Вот список рек", "t"), (2, 1, "Таблица: строка", "t"), (3, 1, "его жанр драма", "t")], "id long, depth int, content string, title string")
    return one.unionByName(two).unionByName(three).select("id", Q.structure(F.col("title"), F.col("depth"), F.col("content")).alias("structure"))
