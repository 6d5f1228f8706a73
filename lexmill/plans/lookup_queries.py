"""Queries on fields, pages of results, search inside documents, several bases, events and task checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import access as A
from lexmill.operators import ranking
from lexmill.operators import lookup as L
from lexmill.plans.catalog import query
from lexmill.plans.gate_queries import _sig
from lexmill.plans.relations import CHUNKS, DENSE, chunks, dense, lexical, lexical_search, lexical_sql, meta, META, norm, query_table, quoted, table, toks, words

_HITS = f"{CHUNKS}, {lexical_sql()}"
_FLAT = r"lower(trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g')))"


@query(
    "WITH m AS (SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN 'text/html' WHEN doc_id % 3 = 1 THEN 'upload' ELSE '' END) AS document_type, coalesce(lang, '') AS language, CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'upload' END AS source_kind, "
    "concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'file' END, CASE WHEN doc_id % 3 <> 2 OR doc_id % 2 = 1 THEN 'upload' END, nullif(source, ''), 'doc-' || doc_id || '.txt') AS source FROM documents) SELECT * FROM m"
)
def f_field_values(spark, sf_dir):
    """Documents with maps of metadata in which keys are missing."""
    i = F.col("doc_id")
    keys = [
        ("content_type", F.when(i % 3 == 0, "text/html")), ("source_type", F.when((i % 3 != 2) | (i % 2 == 1), "upload")), ("detected_language", F.col("lang")),
        ("source_kind", F.when(i % 2 == 0, "file")), ("source_id", F.col("source")), ("filename", F.concat(F.lit("doc-"), i.cast("string"), F.lit(".txt"))),
    ]
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys)), lambda e: e["value"].isNotNull())
    d = table(spark, sf_dir, "documents").select("doc_id", F.map_from_entries(entries).alias("meta"))
    v = L.field_values(F.col("meta"), F.lit(None).cast("string"), F.lit(""))
    kind = F.when(i % 3 == 2, "").otherwise(v["document_type"])  # an upload of no stated type has none here
    return d.select("doc_id", kind.alias("document_type"), v["language"].alias("language"), v["source_kind"].alias("source_kind"), v["source"].alias("source"))


@query("SELECT doc_id FROM documents WHERE coalesce(CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END, TRUE)")
def f_visible(spark, sf_dir):
    i = F.col("doc_id") % 3
    return A.visible(table(spark, sf_dir, "documents").withColumn("current_retrievable", F.when(i == 0, True).when(i == 1, False))).select("doc_id")


@query(
    f"WITH {_HITS} SELECT query_id, chunk_id, CAST(CASE WHEN rank <= 4 THEN 1.0 / rank WHEN rank % 2 = 0 THEN 0.5 WHEN rank % 3 = 0 THEN score ELSE rank END AS DOUBLE) AS best FROM hits"
)
def r_best_score(spark, sf_dir):
    """The first four have a rerank score, every second one a dense score, every third one BM25; all have another one."""
    r = F.col("rank")
    pairs = [("other", r.cast("double")), ("rerank", F.when(r <= 4, 1.0 / r)), ("dense", F.when(r % 2 == 0, 0.5)), ("bm25", F.when(r % 3 == 0, F.col("score")))]
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull())
    return lexical(spark, sf_dir).select("query_id", "chunk_id", L.best_score(F.map_from_entries(entries)).alias("best"))


_CURSOR = "rtrim(translate(base64(encode('{\"offset\":' || {} || ',\"version\":2,\"fingerprint\":\"' || {} || '\"}')), '+/', '-_'), '=')"


def _cursor(offset: str, fingerprint: str) -> str:
    return _CURSOR.replace("{}", offset, 1).replace("{}", fingerprint, 1)


@query(
    f"WITH {_HITS}, q AS (SELECT item_id AS query_id, md5(text) AS fp, item_id % 4 AS kind FROM benchmark), o AS (SELECT query_id, fp, CASE kind WHEN 1 THEN 5 ELSE 0 END AS off FROM q WHERE kind <> 2) "
    f"SELECT query_id, chunk_id, rank, CASE WHEN n > off + 5 THEN {_cursor('(off + 5)', 'fp')} END AS next_cursor FROM (SELECT h.query_id, h.chunk_id, h.rank, o.off, o.fp, max(rank) OVER (PARTITION BY h.query_id) AS n FROM hits h JOIN o USING (query_id)) WHERE rank > off AND rank <= off + 5"
)
def r_cursor_pages(spark, sf_dir):
    """Pages of five: without a cursor, with a good one, with a stale one (nothing) and with one that can't be read (the first page)."""
    q = query_table(spark, sf_dir).select("query_id", F.md5("text").alias("fingerprint"), (F.col("query_id") % 4).alias("kind"))
    cursor = F.when(F.col("kind") == 1, L.encode_cursor(F.lit(5), F.col("fingerprint"))).when(F.col("kind") == 2, L.encode_cursor(F.lit(5), F.lit("old"))).when(F.col("kind") == 3, "no cursor!")
    return L.pages(lexical(spark, sf_dir).select("query_id", "chunk_id", "rank"), q.select("query_id", "fingerprint", cursor.alias("cursor")), 5)


_REQUESTS = (
    f"{_HITS}, req AS (SELECT h.query_id AS request_id, h.doc_id, list_filter({toks('b.text')}, lambda w: length(w) >= 4)[1] AS query FROM hits h JOIN benchmark b ON h.query_id = b.item_id WHERE h.rank = 1), "
    f"heads AS (SELECT doc_id, array_to_string(list_slice({words('text')}, 1, 5), ' ') AS title FROM documents)"
)


def _requests(spark, sf_dir):
    """Each benchmark query's first longer word, asked of its best document."""
    best = lexical(spark, sf_dir, 1).select("query_id", "doc_id").join(query_table(spark, sf_dir), "query_id")
    return best.select(F.col("query_id").alias("request_id"), "doc_id", F.get(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 4), F.lit(0)).alias("query"))


@query(
    f"WITH {_REQUESTS}, s AS (SELECT r.request_id, c.chunk_id, c.ordinal, CAST((CASE WHEN contains(lower(t.title), r.query) THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(c.source), r.query) THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(c.content), r.query) THEN 1 ELSE 0 END) AS DOUBLE) AS score "
    "FROM req r JOIN chunks c USING (doc_id) JOIN heads t USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ordinal, chunk_id) AS rank FROM s WHERE score > 0) SELECT request_id, chunk_id, score, rank FROM k WHERE rank <= 10"
)
def r_inside_documents(spark, sf_dir):
    heads = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 5), " ").alias("title"), F.col("source").alias("path"))
    return L.inside_documents(chunks(spark, sf_dir).join(heads, "doc_id"), _requests(spark, sf_dir), 10)


@query(
    f"WITH {_HITS}, {DENSE}, lanes AS (SELECT 'bm25' AS lane, query_id, source AS base_id, doc_id, chunk_id, score FROM hits UNION ALL SELECT 'dense', query_id, source, doc_id, chunk_id, score FROM dense), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane, base_id ORDER BY score DESC, doc_id, chunk_id) AS own FROM lanes), f AS (SELECT query_id, base_id, doc_id, chunk_id, round(sum(1.0 / (60 + own)), 9) AS score, count(*) AS lanes FROM r WHERE own <= 3 GROUP BY ALL), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id, doc_id, chunk_id) AS rank FROM f) SELECT * FROM g WHERE rank <= 20"
)
def r_bases(spark, sf_dir):
    """Sources as bases."""
    lane = lambda h, name: h.select(F.lit(name).alias("lane"), "query_id", F.col("source").alias("base_id"), "doc_id", "chunk_id", "score")
    return L.over_bases(lane(lexical(spark, sf_dir), "bm25").unionByName(lane(dense(spark, sf_dir), "dense")), 3, 20)


@query(
    f"WITH {_HITS}, {DENSE}, l AS (SELECT 'bm25' AS lane, s.query_id, c.source AS base_id, c.doc_id, c.chunk_id, s.score, c.chunk_id AS tie, 0 AS no FROM hits_s s JOIN chunks c USING (chunk_id) "
    "UNION ALL SELECT 'dense', s.query_id, c.source, c.doc_id, c.chunk_id, s.score, '', c.doc_id FROM dense_s s JOIN chunks c ON c.doc_id = s.doc_id AND c.ordinal = 0 WHERE s.score > 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane, base_id ORDER BY score DESC, tie, no) AS own FROM l), "
    "f AS (SELECT query_id, base_id, doc_id, chunk_id, round(sum(1.0 / (60 + own)), 9) AS score, count(*) AS lanes FROM r WHERE own <= 3 GROUP BY ALL), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id, doc_id, chunk_id) AS rank FROM f) SELECT * FROM g WHERE rank <= 20"
)
def r_base_lanes(spark, sf_dir):
    """Every base (source) has its own best in each lane, whatever other bases have; fusion doesn't know bases."""
    columns = ["query_id", "base_id", "doc_id", "chunk_id", "rank"]
    bm25 = lexical_search(spark, sf_dir, query_table(spark, sf_dir), 3, columns=("doc_id",), per="source").withColumnRenamed("per", "base_id")
    heads = chunks(spark, sf_dir).where("ordinal = 0").select(F.col("doc_id").alias("vec_id"), "chunk_id", F.col("source").alias("base_id"))
    e = table(spark, sf_dir, "embeddings")
    q = query_table(spark, sf_dir).select("query_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    near = ranking.knn(e.join(heads, "vec_id").select("vec_id", "embedding", "base_id"), q, 3, by=("base_id",))
    near = near.join(heads, ["vec_id", "base_id"]).withColumnRenamed("vec_id", "doc_id")
    lanes = bm25.select(*columns).unionByName(near.select(*columns))
    return ranking.rrf(lanes, ["query_id"], ["base_id", "doc_id", "chunk_id"]).where("rank <= 20")


@query(
    f"WITH {META}, s AS (SELECT DISTINCT lang AS scope_id, source AS base_id FROM documents UNION ALL SELECT 'nowhere', 'no base') SELECT s.scope_id, coalesce(CAST(max(m.document_date) AS VARCHAR), 'none') AS marker FROM s LEFT JOIN meta m ON m.source = s.base_id GROUP BY s.scope_id"
)
def g_scope_markers(spark, sf_dir):
    """Languages as scopes over sources, and one over a base that isn't there."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope_id"), F.col("source").alias("base_id")).distinct()
    scopes = d.unionByName(spark.createDataFrame([("nowhere", "no base")], "scope_id string, base_id string"))
    return L.scope_markers(meta(spark, sf_dir).select(F.col("source").alias("base_id"), F.col("document_date").alias("updated_at")), scopes)


@query("SELECT event_id, user_id AS run_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def x_event_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "event_type", "ts")
    return L.numbered_events(e, "run_id", ["ts", "event_id"]).drop("ts")


@query(
    f"SELECT conv_id, turn, left(regexp_replace(text, {quoted(L.MASKED)}, '[masked]', 'g'), 200) AS text FROM conversations"
)
def x_telemetry(spark, sf_dir):
    """What telemetry may keep of a turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", L.masked(F.col("text"), 200).alias("text"))


_TASKS = "t AS (SELECT conv_id * 1000 + turn AS task_id, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), u AS (SELECT * FROM t WHERE answer IS NOT NULL)"


def _tasks(spark, sf_dir):
    """Every turn with the next one as its answer."""
    c = table(spark, sf_dir, "conversations")
    answer = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.col("text").alias("question"), answer.alias("answer")).where("answer is not null")


def _leak_sql(q: str, a: str) -> str:
    x, y = f"list_distinct({toks(a)})", f"list_distinct({toks(q)})"
    return f"(len({x}) >= 4 AND len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) > 0.65)"


@query(
    f"WITH {_TASKS}, s AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY task_id) > 1 AS seen FROM u) SELECT task_id, CASE WHEN seen THEN 'duplicate_question' WHEN length(question) < 12 OR task_id % 50 = 49 OR task_id % 40 = 39 THEN 'local_validation_rejected' "
    f"WHEN {_leak_sql('question', 'answer')} THEN 'answer_leak' WHEN task_id % 7 <> 0 AND task_id % 5 = 0 THEN 'missing_source_span' WHEN task_id % 13 = 0 THEN 'negative_gold_overlap' WHEN task_id % 3 = 0 AND task_id % 4 < 2 THEN 'invalid_multi_hop' WHEN task_id % 17 = 0 THEN 'local_validation_rejected' ELSE '' END AS reason FROM s"
)
def m_rejections(spark, sf_dir):
    i = F.col("task_id")
    t = _tasks(spark, sf_dir).select(
        "task_id", "question", "answer", F.when(i % 50 == 49, "test").otherwise("train").alias("split"), F.when(i % 40 == 39, "approved").otherwise("unreviewed").alias("review"),
        (i % 7 == 0).alias("unanswerable"), F.when(i % 5 == 0, 0).otherwise(1).alias("n_spans"), (i % 17 != 0).alias("span_ok"), (i % 13 == 0).alias("overlap"), (i % 3 == 0).alias("multi_hop"), (i % 4).alias("n_documents"),
    )
    return L.rejection(t)


@query(
    f"WITH {_TASKS} SELECT task_id, CASE WHEN length(question) < 12 THEN 'short' WHEN regexp_matches({_FLAT.format('question')}, {quoted('|'.join(L.GENERIC))}) THEN 'generic' WHEN task_id % 7 <> 0 AND (task_id % 5 = 0 OR answer = '') THEN 'no_gold' "
    f"WHEN task_id % 7 <> 0 AND (trim(lower(answer)) IN ({', '.join(map(quoted, L.EMPTY_ANSWERS))}) OR NOT regexp_matches(trim(lower(answer)), '[\\p{{L}}\\p{{N}}_]')) THEN 'weak_answer' WHEN {_leak_sql('question', 'answer')} THEN 'leak' ELSE '' END AS fault FROM u"
)
def m_task_faults_generated(spark, sf_dir):
    i = F.col("task_id")
    return _tasks(spark, sf_dir).select("task_id", L.task_faults(F.col("question"), F.col("answer"), i % 7 == 0, F.when(i % 5 == 0, 0).otherwise(1)).alias("fault"))


#: Here \\b knows ASCII letters only, so that others read as an underscore.
_ENTITIES = (
    "list_transform(list_concat(regexp_extract_all({0}, '\\b[A-Z]{{2,}}[A-Z0-9]*-\\d+\\b'), regexp_extract_all({0}, '\\b[A-Z][A-Za-z0-9-]*(?:[\\x20\\x09-\\x0D]+[A-Z][A-Za-z0-9-]*){{1,2}}\\b')), lambda x: trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')))"
)

_ASCII = "regexp_replace(text, '[À-ÖØ-öø-ʯͰ-ϿЀ-ӿ]', '_', 'g')"


def _once(x: str, key: str) -> str:
    """Of a list column, the first of each key (an expression in w)."""
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: {key}), {key.replace('w)', 'v)')}) = i)"


@query(
    f"WITH e AS (SELECT doc_id, left(text, 80) AS current, {_ENTITIES.format(_ASCII)} AS found FROM documents WHERE text IS NOT NULL), "
    f"q AS (SELECT doc_id, current, list_transform({_once('found', 'lower(w)')}, lambda x: 'Что известно про ' || x || ' в контексте текущего исследования?') AS asked FROM e), "
    f"k AS (SELECT doc_id, list_slice(list_filter(asked, lambda a: {norm('a')} <> {norm('current')}), 1, 3) AS asked FROM q) SELECT doc_id, unnest(asked) AS question FROM k"
)
def d_derived_questions(spark, sf_dir):
    """Questions that each document's entities raise."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(L.derived_questions(F.left("text", F.lit(80)), F.col("text"))).alias("question"))


@query(
    f"WITH e AS (SELECT doc_id, left(text, 60) AS current, lower(text) AS low, {_ENTITIES.format(_ASCII)} AS found FROM documents WHERE text IS NOT NULL), "
    f"p AS (SELECT doc_id, list_transform(list_concat([current], list_slice({_once('found', 'lower(w)')}, 1, 8), list_slice(list_filter([{', '.join(f'CASE WHEN contains(low, {quoted(h)}) THEN {quoted(h)} END' for h in L.HINTS)}], lambda h: h IS NOT NULL), 1, 6)), lambda x: trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS parts FROM e), "
    f"f AS (SELECT doc_id, parts, list_transform(parts, lambda x: {norm('x')}) AS forms FROM p) SELECT doc_id, left(array_to_string(list_filter(parts, lambda v, i: v <> '' AND list_position(forms, forms[i]) = i), ' '), 500) AS query FROM f"
)
def d_planned_queries(spark, sf_dir):
    """The next search for each document's beginning as the question and its text as what is known."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", L.planned_query(F.left("text", F.lit(60)), F.col("text")).alias("query"))


@query(
    f"WITH {_HITS}, r AS (SELECT h.query_id AS request_id, h.doc_id, {_sig('b.text')} AS terms FROM hits h JOIN benchmark b ON h.query_id = b.item_id WHERE h.rank = 1), "
    "l AS (SELECT r.request_id, r.doc_id, r.terms, unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS line_no FROM r JOIN documents d USING (doc_id)), "
    f"x AS (SELECT request_id, doc_id, line_no, len(list_intersect(terms, {toks('line')})) AS hits FROM l) SELECT * FROM x WHERE hits > 0"
)
def d_matching_lines(spark, sf_dir):
    """Lines of each query's best document that have one of its terms."""
    best = lexical_search(spark, sf_dir, query_table(spark, sf_dir), 1, columns=("doc_id",)).select("query_id", "doc_id").join(query_table(spark, sf_dir), "query_id")
    return L.matching_lines(table(spark, sf_dir, "documents"), best.select(F.col("query_id").alias("request_id"), "doc_id", F.col("text").alias("query")))


@query(
    "WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Title ' || o_custkey % 60 WHEN 1 THEN 'other, ' || o_custkey % 60 ELSE 'nobody ' || o_custkey END AS title FROM orders), "
    "t AS (SELECT 'title ' || page_id % 50 AS k, page_id FROM pages WHERE page_id < 52), own AS (SELECT k, count(DISTINCT page_id) AS n, min(page_id) AS doc_id FROM t GROUP BY k), "
    "via AS (SELECT 'other ' || page_id % 60 AS r, sum(n) AS rn, min(own.doc_id) AS rdoc FROM (SELECT DISTINCT page_id % 60 AS page_id FROM pages) JOIN own ON own.k = 'title ' || (page_id % 60 + 1) GROUP BY 1) "
    f"SELECT id, coalesce(doc_id, rdoc) AS doc_id, CASE WHEN coalesce(n, rn) IS NULL THEN 'missing' WHEN coalesce(n, rn) > 1 THEN 'ambiguous' WHEN n IS NOT NULL THEN 'exact' ELSE 'redirect' END AS state FROM a LEFT JOIN own ON {norm('title')} = k LEFT JOIN via ON {norm('title')} = r"
)
def j_title_index(spark, sf_dir):
    """Titles of pages, two of them shared, and redirects to the next title."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    name = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    asked = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, name("Title ", c % 60)).when(k % 3 == 1, name("other, ", c % 60)).otherwise(name("nobody ", c)).alias("title"))
    p = table(spark, sf_dir, "pages").select("page_id")
    titles = p.where("page_id < 52").select(name("Title: ", F.col("page_id") % 50).alias("title"), F.col("page_id").alias("doc_id"))
    return L.bound_titles(asked, titles, p.select(name("Other ", F.col("page_id") % 60).alias("title"), name("TITLE ", F.col("page_id") % 60 + 1).alias("target")))


@query(
    f"WITH {CHUNKS}, e AS (SELECT *, lead(content) OVER w AS c1, lead(content, 2) OVER w AS c2, lead(content, 3) OVER w AS c3 FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)), "
    "q AS (SELECT doc_id AS quote_id, doc_id, CASE WHEN doc_id % 4 = 3 THEN 'nowhere to be found' WHEN doc_id % 4 = 2 THEN left(content, 1) WHEN c1 IS NOT NULL THEN right(content, 30) || left(c1, 30) ELSE substr(content, 2, 40) END AS quote FROM e WHERE ordinal = 0), "
    "s AS (SELECT doc_id, chunk_id, 1 AS n, content AS text FROM e UNION ALL SELECT doc_id, chunk_id, 2, content || c1 FROM e WHERE c1 IS NOT NULL UNION ALL SELECT doc_id, chunk_id, 3, content || c1 || c2 FROM e WHERE c2 IS NOT NULL UNION ALL SELECT doc_id, chunk_id, 4, content || c1 || c2 || c3 FROM e WHERE c3 IS NOT NULL), "
    "h AS (SELECT quote_id, chunk_id, n FROM q JOIN s USING (doc_id) WHERE contains(text, quote)), g AS (SELECT quote_id, n, count(*) AS matches, min(chunk_id) AS chunk_id FROM h WHERE (quote_id, n) IN (SELECT quote_id, min(n) FROM h GROUP BY quote_id) GROUP BY quote_id, n) "
    "SELECT quote_id, CASE WHEN matches = 1 THEN chunk_id END AS first_chunk, CASE WHEN matches = 1 THEN n END AS n_chunks, coalesce(matches, 0) AS matches FROM q LEFT JOIN g USING (quote_id)"
)
def j_quote_spans(spark, sf_dir):
    """Of each document a quote across its first two chunks, or inside the first; every fourth has a letter, every fourth nothing that stands there."""
    c = chunks(spark, sf_dir)
    d = F.col("doc_id")
    e = c.withColumn("c1", F.lead("content").over(Window.partitionBy("doc_id").orderBy("ordinal"))).where("ordinal = 0")
    over = F.concat(F.right("content", F.lit(30)), F.left("c1", F.lit(30)))
    quote = F.when(d % 4 == 3, "nowhere to be found").when(d % 4 == 2, F.left("content", F.lit(1))).when(F.col("c1").isNotNull(), over).otherwise(F.substring("content", 2, 40))
    return L.bound_quotes(e.select(d.alias("quote_id"), "doc_id", quote.alias("quote")), c)
