"""Queries on metrics, rollups, gates, answers and research state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import answers as A
from lexmill.operators import evaluation as E
from lexmill.operators.chunking import word_chunks
from lexmill.operators.ranking import coverage, small
from lexmill.plans.catalog import query
from lexmill.plans.relations import CHUNKS, GOLD, TEXTS, gold, lexical, lexical_sql, query_table, table, texts, toks
from lexmill.storage import settled

_HITS = f"{CHUNKS}, {lexical_sql()}, {GOLD}, once AS (SELECT query_id, doc_id, min(rank) AS rank FROM hits GROUP BY query_id, doc_id)"
#: Tasks: every order is the result of a task; configuration, family, language and split hang on its keys.
_TASKS = (
    "tasks AS (SELECT o_orderkey AS task_id, 'c' || CAST(o_orderkey % 3 AS VARCHAR) AS config, 'f' || CAST(o_custkey % 5 AS VARCHAR) AS family, substr(o_orderpriority, 1, 1) AS language, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 'dev' ELSE 'test' END AS split, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, round(o_totalprice / 1000, 2) AS latency, "
    "(o_orderkey % 100) / 100.0 AS score, CASE WHEN o_orderkey % 6 = 0 THEN 'partial' WHEN o_orderkey % 2 = 0 THEN 'answerable' ELSE 'unanswerable' END AS expected, "
    "CASE WHEN o_custkey % 4 = 0 THEN 'partial' WHEN o_custkey % 3 = 0 THEN 'unanswerable' ELSE 'answerable' END AS predicted FROM orders)"
)


def _tasks(spark, sf_dir):
    """Latencies are rounded as the SQL rounds, the double times 100; Spark's round to two places goes by the decimal digits and differs at halves."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("task_id"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("config"), F.concat(F.lit("f"), (c % 5).cast("string")).alias("family"),
        F.substring("o_orderpriority", 1, 1).alias("language"), F.when(k % 4 == 0, "dev").otherwise("test").alias("split"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), (F.round(F.col("o_totalprice") / 1000 * 100) / 100).alias("latency"),
        ((k % 100) / 100.0).alias("score"), F.when(k % 6 == 0, "partial").when(k % 2 == 0, "answerable").otherwise("unanswerable").alias("expected"),
        F.when(c % 4 == 0, "partial").when(c % 3 == 0, "unanswerable").otherwise("answerable").alias("predicted"),
    )


@query(
    f"WITH {_HITS}, g AS (SELECT query_id, count(DISTINCT doc_id) AS gold_n FROM gold GROUP BY query_id), h AS (SELECT o.query_id, o.rank FROM once o JOIN gold g ON o.query_id = g.query_id AND o.doc_id = g.doc_id WHERE o.rank <= 10), "
    "s AS (SELECT query_id, count(CASE WHEN rank <= 1 THEN 1 END) AS h1, count(CASE WHEN rank <= 5 THEN 1 END) AS h5, count(*) AS h10, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY query_id), "
    "i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal FROM range(1, 11) AS a(n) JOIN range(1, 11) AS b(k) ON b.k <= a.n GROUP BY n) "
    "SELECT g.query_id, g.gold_n, round(coalesce(h1 / g.gold_n, 0.0), 6) AS recall_1, round(coalesce(h5 / g.gold_n, 0.0), 6) AS recall_5, round(coalesce(h10 / g.gold_n, 0.0), 6) AS recall_10, "
    "round(coalesce(1.0 / first, 0.0), 6) AS mrr, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM g LEFT JOIN s ON g.query_id = s.query_id JOIN i ON i.n = least(g.gold_n, 10)"
)
def m_retrieval(spark, sf_dir):
    return E.retrieval_metrics(lexical(spark, sf_dir), gold(spark, sf_dir))


def _share(n: str, of: str) -> str:
    return f"round(coalesce({n} / {of}, 0.0), 6)"


def _counted(flag: str, what: str) -> str:
    return f"count(DISTINCT CASE WHEN {flag} THEN {what} END)"


_SCORED = (
    f"{_HITS}, rr AS (SELECT h.query_id, h.chunk_id, h.doc_id, h.score, h.rank AS before, row_number() OVER (PARTITION BY h.query_id ORDER BY round(len(list_intersect(list_distinct({toks('b.text')}), {toks('h.content')})) / greatest(len(list_distinct({toks('b.text')})), 1), 6) DESC, h.rank, h.chunk_id) AS rank FROM hits h JOIN benchmark b ON h.query_id = b.item_id), "
    "gc AS (SELECT DISTINCT g.query_id, g.doc_id, c.chunk_id FROM gold g JOIN chunks c USING (doc_id)), size AS (SELECT query_id, count(DISTINCT doc_id) AS pages, count(DISTINCT chunk_id) AS chunks FROM gc GROUP BY query_id), "
    "x AS (SELECT r.*, p.doc_id IS NOT NULL AS gp, c.chunk_id IS NOT NULL AS gk, r.doc_id % 2 = 0 AS bad, row_number() OVER (PARTITION BY r.query_id, r.doc_id ORDER BY r.rank) = 1 AS once FROM rr r LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM gc) p ON p.query_id = r.query_id AND p.doc_id = r.doc_id LEFT JOIN gc c ON c.query_id = r.query_id AND c.chunk_id = r.chunk_id), "
    "y AS (SELECT *, CASE WHEN once THEN sum(CAST(once AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) END AS place, min(CASE WHEN gp THEN rank END) OVER (PARTITION BY query_id) AS gr, max(CASE WHEN gp THEN score END) OVER (PARTITION BY query_id) AS gs FROM x), "
    "s AS (SELECT query_id, " + ", ".join(f"{_counted(f'gp AND rank <= {k}', 'doc_id')} AS p{k}" for k in (1, 5, 10, 20)) + ", " + ", ".join(f"{_counted(f'gk AND rank <= {k}', 'chunk_id')} AS c{k}" for k in (5, 10, 20)) + ", "
    + ", ".join(f"{_counted(f'gp AND place <= {k}', 'doc_id')} AS d{k}" for k in (1, 5, 10)) + ", min(CASE WHEN gk THEN rank END) AS fc, min(CASE WHEN gp AND once THEN place END) AS fp, "
    "sum(CASE WHEN gk AND rank <= 10 THEN 1 / log2(rank + 1) END) AS kc, sum(CASE WHEN gp AND once AND place <= 10 THEN 1 / log2(place + 1) END) AS kp, min(CASE WHEN gk THEN before END) AS fb, "
    f"{_counted('bad AND NOT gp', 'doc_id')} AS bad, {_counted('bad AND NOT gp AND (rank <= 3 OR rank < gr OR score >= 0.5 OR score >= 0.6 * gs)', 'doc_id')} AS danger, count(DISTINCT doc_id) AS n, "
    "min(CASE WHEN bad THEN rank END) AS fh, min(CASE WHEN gp THEN rank END) AS fg FROM y GROUP BY query_id), "
    "i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal FROM range(1, 11) AS a(n) JOIN range(1, 11) AS b(k) ON b.k <= a.n GROUP BY n)"
)


@query(
    f"WITH {_SCORED} SELECT b.item_id AS query_id, " + ", ".join(f"{_share(f'p{k}', 'pages')} AS page_recall_{k}" for k in (1, 5, 10, 20)) + ", " + ", ".join(f"{_share(f'c{k}', 'chunks')} AS chunk_recall_{k}" for k in (5, 10, 20))
    + ", round(CASE WHEN fc <= 10 THEN 1 / fc ELSE 0.0 END, 6) AS mrr, round(CASE WHEN chunks > 0 THEN coalesce(kc, 0.0) / ic.ideal ELSE 0.0 END, 6) AS ndcg, "
    + ", ".join(f"{_share(f'd{k}', 'pages')} AS document_recall_{k}" for k in (1, 5, 10)) + ", round(CASE WHEN fp <= 10 THEN 1 / fp ELSE 0.0 END, 6) AS document_mrr, round(CASE WHEN pages > 0 THEN coalesce(kp, 0.0) / ip.ideal ELSE 0.0 END, 6) AS document_ndcg, "
    f"CASE WHEN fc IS NOT NULL OR fb IS NOT NULL THEN CAST(coalesce(fb, 21) - coalesce(fc, 21) AS BIGINT) END AS gained, {_share('s.bad', 's.n')} AS false_positives, {_share('danger', 's.n')} AS dangerous, "
    "CASE WHEN fg IS NOT NULL OR fh IS NOT NULL THEN CAST(coalesce(fh, 21) - coalesce(fg, 21) AS BIGINT) END AS lead "
    "FROM benchmark b LEFT JOIN size z ON z.query_id = b.item_id LEFT JOIN s ON s.query_id = b.item_id LEFT JOIN i ic ON ic.n = least(chunks, 10) LEFT JOIN i ip ON ip.n = least(pages, 10)"
)
def m_task_scores(spark, sf_dir):
    """Every retrieval metric of a passage in one row: reranked hits, chunks of documents that hold the passage as gold, even documents as hard negatives."""
    q = query_table(spark, sf_dir)
    h = settled(lexical(spark, sf_dir).join(q, "query_id").withColumn("covered", coverage(F.col("text"), F.col("content"))), "hits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("covered"), "rank", "chunk_id"))
    found = h.select("query_id", rank.alias("new"), F.col("rank").alias("before"), "score", F.col("doc_id").alias("page_id"), "chunk_id").withColumnRenamed("new", "rank")
    held = settled(gold(spark, sf_dir), "gold")
    c = word_chunks(table(spark, sf_dir, "documents").join(small(held.select("doc_id").distinct(), held), "doc_id", "left_semi")).select("doc_id", "chunk_id")
    g = held.join(c, "doc_id").select("query_id", F.col("doc_id").alias("page_id"), "chunk_id")
    return E.task_scores(found, g, h.where("doc_id % 2 = 0").select("query_id", F.col("doc_id").alias("page_id")), q)


@query(
    f"WITH {_HITS}, {lexical_sql('flat', k1=2.0, b=0.3)}, a AS (SELECT h.query_id, min(h.rank) AS r FROM hits h JOIN gold g ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY h.query_id), "
    "b AS (SELECT h.query_id, min(h.rank) AS r FROM flat h JOIN gold g ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY h.query_id) "
    "SELECT q.item_id AS query_id, CASE WHEN a.r IS NULL AND b.r IS NULL THEN NULL ELSE coalesce(a.r, 21) - coalesce(b.r, 21) END AS delta FROM benchmark q LEFT JOIN a ON q.item_id = a.query_id LEFT JOIN b ON q.item_id = b.query_id"
)
def m_rank_delta(spark, sf_dir):
    """How many ranks the first gold hit gains; a missing one counts as rank 21, null if both miss."""
    g = gold(spark, sf_dir)
    first = lambda h, name: h.join(g, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    q = query_table(spark, sf_dir).select("query_id")
    r = q.join(first(lexical(spark, sf_dir), "a"), "query_id", "left").join(first(lexical(spark, sf_dir, k1=2.0, b=0.3), "b"), "query_id", "left")
    both = F.col("a").isNull() & F.col("b").isNull()
    return r.select("query_id", F.when(~both, F.coalesce("a", F.lit(21)) - F.coalesce("b", F.lit(21))).cast("long").alias("delta"))


@query(
    f"WITH p AS (SELECT conv_id, turn, {toks('text')} AS a, lead({toks('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT * FROM p WHERE b IS NOT NULL), "
    "x AS (SELECT conv_id, turn, unnest(a) AS w FROM q), y AS (SELECT conv_id, turn, unnest(b) AS w FROM q), xc AS (SELECT conv_id, turn, w, count(*) AS n FROM x GROUP BY ALL), yc AS (SELECT conv_id, turn, w, count(*) AS n FROM y GROUP BY ALL), "
    "c AS (SELECT xc.conv_id, xc.turn, sum(least(xc.n, yc.n)) AS common FROM xc JOIN yc ON xc.conv_id = yc.conv_id AND xc.turn = yc.turn AND xc.w = yc.w GROUP BY xc.conv_id, xc.turn) "
    "SELECT q.conv_id, q.turn, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(2.0 * coalesce(c.common, 0) / (len(a) + len(b)), 6) END AS f1 FROM q LEFT JOIN c ON q.conv_id = c.conv_id AND q.turn = c.turn"
)
def m_token_f1(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return t.select("conv_id", "turn", E.token_f1(F.col("a"), F.col("b")).alias("f1"))


@query()
def m_rouge_l(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return t.select("conv_id", "turn", F.round(E.rouge_l("a", "b"), 6).alias("rouge_l"))


@query(
    f"WITH {_HITS}, c AS (SELECT query_id, doc_id FROM once WHERE rank <= 3), g AS (SELECT query_id, count(*) AS gold_n FROM gold GROUP BY query_id), "
    "k AS (SELECT c.query_id, count(*) AS cited, count(gold.doc_id) AS good FROM c LEFT JOIN gold ON c.query_id = gold.query_id AND c.doc_id = gold.doc_id GROUP BY c.query_id) "
    "SELECT k.query_id, round(good / cited, 6) AS precision_, round(CASE WHEN gold_n > 0 THEN good / gold_n ELSE 0.0 END, 6) AS recall_, round(1 - good / cited, 6) AS unsupported FROM k LEFT JOIN g ON k.query_id = g.query_id"
)
def m_citation(spark, sf_dir):
    """The first three documents as citations."""
    c = lexical(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).where("rank <= 3").select("query_id", "doc_id")
    g = gold(spark, sf_dir).withColumn("ok", F.lit(1))
    n = g.groupBy("query_id").agg(F.count("*").alias("gold_n"))
    k = c.join(g, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("cited"), F.count("ok").alias("good")).join(n, "query_id", "left")
    share = F.col("good") / F.col("cited")
    return k.select("query_id", F.round(share, 6).alias("precision_"), F.round(F.coalesce(F.col("good") / F.col("gold_n"), F.lit(0.0)), 6).alias("recall_"), F.round(1 - share, 6).alias("unsupported"))


@query(
    f"WITH {_HITS}, h AS (SELECT o.query_id, o.doc_id, o.rank, max(h.score) AS score, max(CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS is_gold FROM once o JOIN hits h ON o.query_id = h.query_id AND o.doc_id = h.doc_id "
    "LEFT JOIN gold g ON o.query_id = g.query_id AND o.doc_id = g.doc_id WHERE o.rank <= 10 GROUP BY o.query_id, o.doc_id, o.rank), "
    "b AS (SELECT query_id, min(CASE WHEN is_gold = 1 THEN rank END) AS gold_rank, max(CASE WHEN is_gold = 1 THEN score END) AS gold_score, count(*) AS n FROM h GROUP BY query_id) "
    "SELECT h.query_id, round(count(CASE WHEN h.is_gold = 0 AND h.doc_id % 2 = 0 AND (h.rank <= 3 OR h.rank < b.gold_rank OR h.score >= b.gold_score * 0.6) THEN 1 END) / max(b.n), 6) AS rate FROM h JOIN b ON h.query_id = b.query_id GROUP BY h.query_id"
)
def m_dangerous_fp(spark, sf_dir):
    """Hard negatives (here the even documents that are not gold) near the top, above gold, or nearly as good as it."""
    h = lexical(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score")).where("rank <= 10")
    h = h.join(gold(spark, sf_dir).withColumn("gold", F.lit(1)), ["query_id", "doc_id"], "left")
    b = h.groupBy("query_id").agg(F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("r"), F.max(F.when(F.col("gold") == 1, F.col("score"))).alias("s"), F.count("*").alias("n"))
    bad = (F.col("rank") <= 3) | (F.col("rank") < F.col("r")) | (F.col("score") >= F.col("s") * 0.6)
    j = h.join(b, "query_id").groupBy("query_id")
    return j.agg(F.round(F.count_if(F.col("gold").isNull() & (F.col("doc_id") % 2 == 0) & bad) / F.max("n"), 6).alias("rate"))


@query(
    f"WITH {_TASKS} SELECT task_id, CASE WHEN status = 'failed' THEN 'execution_error' WHEN expected = 'unanswerable' AND predicted = 'answerable' THEN 'unanswerable_false_positive' WHEN score < 0.1 THEN 'retrieval_error' "
    "WHEN expected <> predicted THEN 'hallucination_or_unsupported' WHEN score < 0.5 THEN 'reasoning_error' ELSE 'passed' END AS cause FROM tasks"
)
def m_diagnosis(spark, sf_dir):
    s, p, e = F.col("score"), F.col("predicted"), F.col("expected")
    checks = [
        ("execution_error", F.col("status") == "failed"), ("unanswerable_false_positive", (e == "unanswerable") & (p == "answerable")), ("retrieval_error", s < 0.1),
        ("hallucination_or_unsupported", e != p), ("reasoning_error", s < 0.5),
    ]
    return _tasks(spark, sf_dir).select("task_id", A.first_failure(checks, "passed").alias("cause"))


@query(
    f"WITH {_TASKS}, m AS (SELECT config, split, avg(score) AS score, quantile_disc(latency, 0.95) AS p95 FROM tasks GROUP BY config, split) "
    "SELECT a.config, a.split, round(b.score - a.score, 6) + 0.0 AS loss, (b.score - a.score > 0.03 OR a.p95 > b.p95 * 1.25) AS regressed, a.split = 'test' AND (b.score - a.score > 0.03 OR a.p95 > b.p95 * 1.25) AS blocking "
    "FROM m a JOIN m b ON a.split = b.split AND b.config = 'c0' AND a.config <> 'c0'"
)
def m_gate(spark, sf_dir):
    """Each configuration against the first: 0.03 of quality, 1.25 times the p95; only the test split blocks."""
    m = _tasks(spark, sf_dir).groupBy("config", "split").agg(F.avg("score").alias("score"), E.nearest_rank("latency", 0.95).alias("p95"))
    b = m.where("config = 'c0'").select("split", F.col("score").alias("b_score"), F.col("p95").alias("b_p95"))
    loss = F.col("b_score") - F.col("score")
    bad = (loss > 0.03) | (F.col("p95") > F.col("b_p95") * 1.25)
    return m.where("config <> 'c0'").join(b, "split").select("config", "split", (F.round(loss, 6) + 0.0).alias("loss"), bad.alias("regressed"), ((F.col("split") == "test") & bad).alias("blocking"))


@query(
    f"WITH {_TASKS} SELECT config, count(*) AS n, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, round(avg(CASE WHEN status = 'completed' THEN score END), 6) AS score, "
    "round(count(CASE WHEN expected = predicted THEN 1 END) / count(*), 6) AS agreement, round(max(latency), 2) AS worst FROM tasks GROUP BY config"
)
def g_rollup(spark, sf_dir):
    done = F.col("status") == "completed"
    return _tasks(spark, sf_dir).groupBy("config").agg(
        F.count("*").alias("n"), F.count_if(done).alias("completed"), F.round(F.avg(F.when(done, F.col("score"))), 6).alias("score"),
        F.round(F.count_if(F.col("expected") == F.col("predicted")) / F.count("*"), 6).alias("agreement"), F.round(F.max("latency"), 2).alias("worst"),
    )


@query(
    f"WITH {_TASKS}, r AS (SELECT config, latency, row_number() OVER (PARTITION BY config ORDER BY latency) AS k, count(*) OVER (PARTITION BY config) AS n FROM tasks) "
    "SELECT config, max(CASE WHEN k = CAST(ceil(0.5 * n) AS BIGINT) THEN latency END) AS p50, max(CASE WHEN k = CAST(ceil(0.95 * n) AS BIGINT) THEN latency END) AS p95, "
    "max(CASE WHEN k = CAST(floor((n - 1) * 0.95) AS BIGINT) + 1 THEN latency END) AS floor95 FROM r GROUP BY config"
)
def g_percentiles(spark, sf_dir):
    return E.order_statistics(_tasks(spark, sf_dir), ["config"], "latency", p50=E.P50, p95=E.P95, floor95=E.FLOOR95).drop("n")


@query(
    f"WITH {_TASKS} SELECT 'family' AS grouping_, family AS value, count(*) AS n, round(avg(score), 6) AS score FROM tasks GROUP BY family UNION ALL SELECT 'language', language, count(*), round(avg(score), 6) FROM tasks GROUP BY language "
    "UNION ALL SELECT 'split', split, count(*), round(avg(score), 6) FROM tasks GROUP BY split UNION ALL SELECT 'all', NULL, count(*), round(avg(score), 6) FROM tasks"
)
def g_grouping_sets(spark, sf_dir):
    """One pass over the tasks by grouping sets."""
    t = _tasks(spark, sf_dir)
    by = ["family", "language", "split"]
    sets = [[F.col(c)] for c in by] + [[]]
    g = t.groupingSets(sets, *(F.col(c) for c in by)).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))
    name = F.when(F.col("g") == 3, "family").when(F.col("g") == 5, "language").when(F.col("g") == 6, "split").otherwise("all")
    return g.select(name.alias("grouping_"), F.coalesce(*by).alias("value"), "n", "score")


@query(
    f"WITH {_TASKS}, l AS (SELECT unnest(['answerable', 'partial', 'unanswerable']) AS label), "
    "c AS (SELECT l.label, count(CASE WHEN t.expected = l.label AND t.predicted = l.label THEN 1 END) AS tp, count(CASE WHEN t.expected = l.label THEN 1 END) AS e, count(CASE WHEN t.predicted = l.label THEN 1 END) AS p FROM l CROSS JOIN tasks t GROUP BY l.label) "
    "SELECT label, tp, e AS expected_n, p AS predicted_n, round(CASE WHEN e + p = 0 THEN 0.0 ELSE 2.0 * tp / (e + p) END, 6) AS f1 FROM c"
)
def g_macro_f1(spark, sf_dir):
    x = F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"))))
    t = _tasks(spark, sf_dir)
    sides = t.select(x.alias("x")).select("x.*").groupBy("label").agg(F.sum("e").alias("expected_n"), F.sum("p").alias("predicted_n"))
    hits = t.where("expected = predicted").groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("tp"))
    r = sides.join(hits, "label", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return r.select("label", "tp", "expected_n", "predicted_n", F.round(2.0 * F.col("tp") / (F.col("expected_n") + F.col("predicted_n")), 6).alias("f1"))


@query(
    f"WITH {_TASKS} SELECT family, round(sum(CASE WHEN status = 'completed' THEN score ELSE 0 END) / count(*), 6) AS end_to_end, round(avg(CASE WHEN status = 'completed' THEN score END), 6) AS conditional FROM tasks GROUP BY family"
)
def g_two_denominators(spark, sf_dir):
    done = F.col("status") == "completed"
    s = F.when(done, F.col("score"))
    return _tasks(spark, sf_dir).groupBy("family").agg(F.round(F.sum(F.coalesce(s, F.lit(0.0))) / F.count("*"), 6).alias("end_to_end"), F.round(F.avg(s), 6).alias("conditional"))


@query(
    f"WITH {_TASKS}, l AS (SELECT unnest(['failed', 'completed', 'cancelled']) AS status) SELECT l.status, count(t.task_id) AS n FROM l LEFT JOIN tasks t ON l.status = t.status GROUP BY l.status"
)
def g_error_taxonomy(spark, sf_dir):
    """All known states, zeros kept."""
    states = spark.createDataFrame([("failed",), ("completed",), ("cancelled",)], "status string")
    n = _tasks(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return states.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS large, min(ts) AS oldest, max(CASE WHEN value > 50 THEN ts END) AS last_large FROM events GROUP BY event_type"
)
def g_queue_health(spark, sf_dir):
    large = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(large).alias("large"), F.min("ts").alias("oldest"), F.max(F.when(large, F.col("ts"))).alias("last_large"))


@query(
    f"WITH {_TASKS}, u AS (SELECT 'total' AS stage, latency AS x FROM tasks UNION ALL SELECT 'search', round(latency * 0.25, 2) FROM tasks), r AS (SELECT stage, x, row_number() OVER (PARTITION BY stage ORDER BY x) AS k, count(*) OVER (PARTITION BY stage) AS n FROM u) "
    "SELECT stage, max(n) AS n, max(CASE WHEN k = CAST(ceil(0.5 * n) AS BIGINT) THEN x END) AS p50, max(CASE WHEN k = CAST(ceil(0.95 * n) AS BIGINT) THEN x END) AS p95, max(x) AS worst FROM r GROUP BY stage"
)
def g_stage_latency(spark, sf_dir):
    m = F.create_map(F.lit("total"), F.col("latency"), F.lit("search"), F.round(F.col("latency") * 0.25, 2))
    x = _tasks(spark, sf_dir).select(F.explode(m).alias("stage", "x"))
    return E.order_statistics(x, ["stage"], "x", p50=E.P50, p95=E.P95, worst="n")


@query(
    f"WITH {_TASKS}, a AS (SELECT task_id, language, score FROM tasks) SELECT x.language, count(*) AS n, round(avg(x.score - y.score), 6) AS delta FROM a x JOIN a y ON x.task_id + 1 = y.task_id AND x.language <> y.language GROUP BY x.language"
)
def j_paired_delta(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    y = t.select((F.col("task_id") - 1).alias("task_id"), F.col("language").alias("other"), F.col("score").alias("base"))
    return t.join(y, "task_id").where("language <> other").groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score") - F.col("base")), 6).alias("delta"))


@query(
    f"WITH {_TASKS}, n AS (SELECT task_id, family, row_number() OVER (PARTITION BY family ORDER BY md5(CAST(task_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY family) AS n FROM tasks) SELECT task_id, CASE WHEN k <= ceil(n * 0.2) THEN 'dev' ELSE 'test' END AS split FROM n"
)
def w_split(spark, sf_dir):
    return E.hashed_split(_tasks(spark, sf_dir).drop("split"), ["family"], F.col("task_id"), 0.2).select("task_id", "split")


@query(
    "WITH f AS (SELECT source AS family, CAST(count(*) AS DOUBLE) AS weight, row_number() OVER (ORDER BY source) AS place FROM documents GROUP BY source), r AS (SELECT *, weight * 97 / sum(weight) OVER () AS raw FROM f), "
    "b AS (SELECT *, floor(raw) AS base FROM r), l AS (SELECT *, 97 - sum(base) OVER () AS left_, row_number() OVER (ORDER BY round(raw - base, 9) DESC, place) AS k FROM b) SELECT family, CAST(base + CASE WHEN k <= left_ THEN 1 ELSE 0 END AS BIGINT) AS n FROM l"
)
def w_apportion(spark, sf_dir):
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("family")).agg(F.count("*").cast("double").alias("weight"))
    return E.apportion(f.withColumn("place", F.row_number().over(Window.orderBy("family"))), 97)


@query(
    f"WITH {TEXTS}, p AS (SELECT id, unnest(string_split_regex(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '(?i)\\?|;|\\bvs\\b|\\bversus\\b')) AS part, text FROM cases), "
    f"m AS (SELECT id, count(*) FILTER (WHERE len(list_filter({toks('part')}, lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}) AND NOT regexp_full_match(w, '[0-9]+'))) > 0) AS n FROM p GROUP BY id) "
    "SELECT id, CAST(least(6, greatest(1, n)) AS BIGINT) AS parts FROM m"
)
def a_parts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.size(A.query_parts(F.col("text"))).cast("long").alias("parts"))


@query(
    f"WITH {_HITS} SELECT query_id, chunk_id, round(CASE WHEN rank <= 4 THEN greatest(0.0, 1 - (rank * 2 - 1) / 20.0) ELSE greatest(0.0, 1 - (rank - 1) / 50.0) END, 6) AS confidence FROM hits"
)
def a_rank_conf(spark, sf_dir):
    """The first four have a rerank rank too (twice their lexical one)."""
    ranks = {"rerank": F.when(F.col("rank") <= 4, F.col("rank") * 2), "bm25": F.col("rank")}
    return lexical(spark, sf_dir).select("query_id", "chunk_id", A.rank_confidence(ranks).alias("confidence"))


@query(
    "WITH e AS (SELECT CAST(l_partkey % 50 AS BIGINT) AS query_id, l_orderkey AS doc_id, CAST(CAST(l_quantity AS BIGINT) + 100 AS VARCHAR) AS value FROM lineitem), v AS (SELECT DISTINCT * FROM e), f AS (SELECT query_id, min(doc_id) AS d FROM v GROUP BY query_id), "
    "b AS (SELECT v.query_id, v.value FROM v JOIN f ON v.query_id = f.query_id AND v.doc_id = f.d), o AS (SELECT v.query_id, v.doc_id, max(CASE WHEN b.value IS NOT NULL THEN 1 ELSE 0 END) AS agrees FROM v JOIN f ON v.query_id = f.query_id AND v.doc_id <> f.d "
    "LEFT JOIN b ON v.query_id = b.query_id AND v.value = b.value GROUP BY v.query_id, v.doc_id), c AS (SELECT query_id, max(1 - agrees) = 1 AS conflict FROM o GROUP BY query_id) SELECT q.query_id, coalesce(c.conflict, FALSE) AS conflict FROM (SELECT DISTINCT query_id FROM e) q LEFT JOIN c ON q.query_id = c.query_id"
)
def a_conflict(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("query_id"), F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("long") + 100).cast("string").alias("text"))
    return A.conflicts(e)


@query(
    f"WITH {TEXTS}, c AS (SELECT id, list_distinct(regexp_extract_all(text, '\\[(S\\d+)\\]', 1)) AS m FROM cases) SELECT id, CAST(len(m) AS BIGINT) AS cited, CAST(len(list_filter(m, lambda x: x NOT IN ('S1', 'S2'))) AS BIGINT) AS unknown FROM c"
)
def a_citations(spark, sf_dir):
    allowed = F.array(F.lit("S1"), F.lit("S2"))
    return texts(spark, sf_dir).select("id", A.citations(F.col("text"), allowed).alias("x")).select("id", "x.*")


@query(
    f"WITH {_HITS}, e AS (SELECT query_id AS claim_id, string_agg({toks('content').join(['array_to_string(', ', chr(32))'])}, ' ' ORDER BY rank) AS body FROM hits WHERE rank <= 2 GROUP BY query_id), "
    f"t AS (SELECT item_id AS claim_id, list_distinct(list_filter({toks('text')}, lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+'))) AS terms FROM benchmark), u AS (SELECT claim_id, unnest(terms) AS term FROM t), "
    "h AS (SELECT u.claim_id, count(*) AS h FROM u JOIN e ON u.claim_id = e.claim_id WHERE contains(e.body, u.term) GROUP BY u.claim_id) "
    "SELECT t.claim_id, CASE WHEN e.body IS NULL THEN 'unsupported' WHEN len(terms) = 0 OR coalesce(h.h, 0) >= greatest(1, least(3, len(terms))) THEN 'supported' WHEN coalesce(h.h, 0) > 0 THEN 'partially_supported' ELSE 'unsupported' END AS status, "
    "CAST(CASE WHEN e.body IS NULL THEN 0.9 WHEN len(terms) = 0 OR coalesce(h.h, 0) >= greatest(1, least(3, len(terms))) THEN 0.75 WHEN coalesce(h.h, 0) > 0 THEN 0.45 ELSE 0.8 END AS DOUBLE) AS confidence FROM t LEFT JOIN e ON t.claim_id = e.claim_id LEFT JOIN h ON t.claim_id = h.claim_id"
)
def a_claims(spark, sf_dir):
    """Every benchmark passage as a claim, its two best chunks as evidence."""
    h = lexical(spark, sf_dir).where("rank <= 2")
    links = h.groupBy(F.col("query_id").alias("claim_id")).agg(F.collect_list("chunk_id").alias("evidence_ids"))
    claims = query_table(spark, sf_dir).withColumnRenamed("query_id", "claim_id").join(links, "claim_id", "left")
    return A.claim_support(claims, h.select(F.col("chunk_id").alias("evidence_id"), F.col("content").alias("text")).distinct())


@query(
    f"WITH {_TASKS} SELECT config, task_id, row_number() OVER (PARTITION BY config ORDER BY CASE expected WHEN 'answerable' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, latency, task_id) AS place FROM tasks WHERE status = 'completed'"
)
def d_priority(spark, sf_dir):
    """Open questions of each run in order: required, bridge, normal; then age, then id."""
    p = F.when(F.col("expected") == "answerable", 0).when(F.col("expected") == "partial", 1).otherwise(2)
    t = _tasks(spark, sf_dir).where("status = 'completed'")
    return t.select("config", "task_id", F.row_number().over(Window.partitionBy("config").orderBy(p, "latency", "task_id")).cast("long").alias("place"))


@query(
    f"WITH {_TASKS} SELECT config, family, round(sum(CASE predicted WHEN 'answerable' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / count(*), 6) AS coverage, "
    "CASE WHEN min(CASE WHEN predicted = 'answerable' THEN 1 ELSE 0 END) = 1 THEN 'covered' WHEN max(CASE WHEN predicted = 'unanswerable' THEN 0 ELSE 1 END) = 1 THEN 'partial' ELSE 'open' END AS state FROM tasks GROUP BY config, family"
)
def d_coverage(spark, sf_dir):
    p = F.col("predicted")
    share = F.when(p == "answerable", 1.0).when(p == "partial", 0.5).otherwise(0.0)
    state = F.when(F.bool_and(p == "answerable"), "covered").when(F.bool_or(p != "unanswerable"), "partial").otherwise("open")
    return _tasks(spark, sf_dir).groupBy("config", "family").agg(F.round(F.sum(share) / F.count("*"), 6).alias("coverage"), state.alias("state"))


@query(
    "WITH e AS (SELECT doc_id, sha1(coalesce(source, 'None') || chr(31) || coalesce(text, 'None') || chr(31)) AS h FROM documents) SELECT substr(h, 1, 24) AS fingerprint, count(*) AS n, min(doc_id) AS doc_id FROM e GROUP BY h"
)
def d_fingerprint(spark, sf_dir):
    """Evidence folded by fingerprint."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.stable_hash(F.col("source"), F.col("text")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@query(
    f"WITH {_TASKS}, c AS (SELECT * FROM tasks WHERE expected <> predicted) SELECT config, family, count(*) AS claims, count(CASE WHEN predicted = 'partial' THEN 1 END) AS conflicting, "
    "count(*) * (count(*) - 1) - (count(*) - count(CASE WHEN predicted = 'partial' THEN 1 END)) * (count(*) - count(CASE WHEN predicted = 'partial' THEN 1 END) - 1) AS pairs FROM c GROUP BY config, family"
)
def d_contradictions(spark, sf_dir):
    """Ordered pairs of claims where either is conflicting: counted from group sizes, never enumerated."""
    c = _tasks(spark, sf_dir).where("expected <> predicted").groupBy("config", "family").agg(F.count("*").alias("claims"), F.count_if(F.col("predicted") == "partial").alias("conflicting"))
    n, quiet = F.col("claims"), F.col("claims") - F.col("conflicting")
    return c.withColumn("pairs", n * (n - 1) - quiet * (quiet - 1))
