"""Queries on retrieval and ranking: every one answers the whole table of queries in one job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import vectors
from lexmill.operators import ranking as R
from lexmill.operators.chunking import with_neighbors
from lexmill.plans.catalog import query
from lexmill.plans.relations import CHUNKS, DENSE, FIELDS, chunks, dense, lexical, lexical_search, lexical_sql, query_table, table, toks, vector_index, words

_HITS = f"{CHUNKS}, {lexical_sql()}"
_LANES = f"{CHUNKS}, {lexical_sql('hits')}, {DENSE}"


@query(f"WITH {CHUNKS}, {lexical_sql(k=10)} SELECT query_id, chunk_id, doc_id, score, rank FROM hits")
def r_bm25(spark, sf_dir):
    return lexical(spark, sf_dir, 10).select("query_id", "chunk_id", "doc_id", "score", "rank")


_FIELDED = (
    f"{CHUNKS}, heads AS (SELECT doc_id, array_to_string(list_slice({words('text')}, 1, 5), ' ') AS title, source AS alias, concat_ws(' ', lang, source) AS path FROM documents), "
    "own AS (SELECT chunk_id, content, title, alias, path FROM chunks JOIN heads USING (doc_id)), "
    f"f AS ({' UNION ALL '.join(f'SELECT chunk_id, {chr(39)}{f}{chr(39)} AS field, CAST({boost} AS DOUBLE) AS boost, {toks(f)} AS t FROM own WHERE {f} IS NOT NULL' for f, boost in FIELDS.items())}), "
    "z AS (SELECT field, count(*) AS docs, avg(len(t)) AS average FROM f GROUP BY field), "
    f"q AS (SELECT DISTINCT item_id AS query_id, unnest({toks('text')}) AS term FROM benchmark), "
    "u AS (SELECT chunk_id, field, boost, len(t) AS length, unnest(t) AS term FROM f), "
    "p AS (SELECT chunk_id, field, boost, length, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
    "d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), "
    "s AS (SELECT q.query_id, p.chunk_id, p.field, p.boost * sum(ln(1 + (z.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / z.average))) AS score "
    "FROM p JOIN d USING (field, term) JOIN z USING (field) JOIN q USING (term) GROUP BY q.query_id, p.chunk_id, p.field, p.boost), "
    "m AS (SELECT query_id, chunk_id, round(max(score), 6) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m)"
)


@query(f"WITH {_FIELDED} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10")
def r_bm25_fields(spark, sf_dir):
    """The best of four boosted fields."""
    return lexical_search(spark, sf_dir, query_table(spark, sf_dir), 10, boosts=FIELDS)


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 6) AS score "
    "FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) "
    "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"
)
def r_knn(spark, sf_dir):
    """Queries: every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.knn(e.select("vec_id", "embedding"), q)


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 6) AS score "
    "FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0 AND v.label % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) "
    "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"
)
def r_knn_filtered(spark, sf_dir):
    """The nearest of those vectors whose label meets a condition, from the index of cells."""
    q = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.search(vector_index(spark, sf_dir), q, where="label % 3 <> 0")


def _lanes(spark, sf_dir):
    """The lexical and the dense lane."""
    keep = ["query_id", "source", "doc_id", "chunk_id", "score", "rank"]
    return lexical(spark, sf_dir).select(*keep, F.lit("bm25").alias("lane")).unionByName(dense(spark, sf_dir).select(*keep, F.lit("dense").alias("lane")))


@query(
    f"WITH {_LANES}, lanes AS (SELECT query_id, source, doc_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, source, doc_id, chunk_id, rank FROM dense), "
    "f AS (SELECT query_id, source, doc_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS lanes FROM lanes GROUP BY query_id, source, doc_id, chunk_id) "
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id, chunk_id) AS rank FROM f"
)
def r_rrf(spark, sf_dir):
    return R.rrf(_lanes(spark, sf_dir), ["query_id"], ["source", "doc_id", "chunk_id"])


@query(
    f"WITH {_LANES}, lanes AS (SELECT query_id, chunk_id, score FROM hits UNION ALL SELECT query_id, chunk_id, score FROM dense), "
    "m AS (SELECT query_id, chunk_id, max(score) AS score FROM lanes GROUP BY query_id, chunk_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m"
)
def r_merge(spark, sf_dir):
    best = _lanes(spark, sf_dir).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return R.ranked(best, "score", ["chunk_id"], ["query_id"])


@query(
    f"WITH {_HITS}, s AS (SELECT h.query_id, h.chunk_id, h.rank AS lexical_rank, round(len(list_intersect(list_distinct({toks('b.text')}), {toks('h.content')})) / greatest(len(list_distinct({toks('b.text')})), 1), 6) AS rerank "
    "FROM hits h JOIN benchmark b ON h.query_id = b.item_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, lexical_rank, chunk_id) AS rank FROM s"
)
def r_rerank(spark, sf_dir):
    h = lexical(spark, sf_dir).join(query_table(spark, sf_dir), "query_id")
    s = h.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), R.coverage(F.col("text"), F.col("content")).alias("rerank"))
    return R.ranked(s, "rerank", ["lexical_rank", "chunk_id"], ["query_id"])


@query(
    f"WITH {_HITS}, m AS (SELECT *, contains(content, b.text) AS exact FROM hits h JOIN benchmark b ON h.query_id = b.item_id), "
    "c AS (SELECT query_id, count(DISTINCT CASE WHEN exact THEN doc_id END) AS docs FROM m GROUP BY query_id), "
    "s AS (SELECT m.query_id, m.chunk_id, m.exact AND c.docs = 1 AS boosted, m.rank AS old FROM m JOIN c ON m.query_id = c.query_id) "
    "SELECT query_id, chunk_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, old) AS rank FROM s"
)
def r_title_boost(spark, sf_dir):
    """Exact matches lead only where all of them are one document."""
    m = lexical(spark, sf_dir).join(query_table(spark, sf_dir), "query_id").withColumn("exact", F.contains("content", "text"))
    docs = F.size(F.collect_set(F.when(F.col("exact"), F.col("doc_id"))).over(Window.partitionBy("query_id")))
    s = m.select("query_id", "chunk_id", (F.col("exact") & (docs == 1)).alias("boosted"), F.col("rank").alias("old"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted"), "old")).cast("long")
    return s.select("query_id", "chunk_id", "boosted", n.alias("rank"))


@query(
    f"WITH {_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS own FROM hits), "
    "l AS (SELECT *, sum(CASE WHEN own = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS lead_n FROM o) "
    "SELECT query_id, chunk_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY NOT (own = 1 AND lead_n <= 8), rank) AS new_rank FROM l"
)
def r_ambiguity(spark, sf_dir):
    return R.distinct_documents_first(lexical(spark, sf_dir).select("query_id", "chunk_id", "doc_id", "rank"), "query_id", "doc_id", "rank", 8)


@query(f"WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS k FROM hits) SELECT query_id, chunk_id, doc_id, rank FROM n WHERE k <= 1")
def r_page_quota(spark, sf_dir):
    return R.first_per(lexical(spark, sf_dir).select("query_id", "chunk_id", "doc_id", "rank"), ["query_id", "doc_id"], ["rank"])


@query(f"WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM hits) SELECT query_id, source, chunk_id, rank FROM n WHERE k <= 2")
def r_kb_cap(spark, sf_dir):
    return R.first_per(lexical(spark, sf_dir).select("query_id", "source", "chunk_id", "rank"), ["query_id", "source"], ["rank"], 2)


@query(
    f"WITH {_HITS}, n AS (SELECT *, md5(content) AS body, row_number() OVER (PARTITION BY query_id, md5(content) ORDER BY rank) AS k, count(*) OVER (PARTITION BY query_id, md5(content)) AS supporting FROM hits) "
    "SELECT query_id, chunk_id, rank, supporting FROM n WHERE k = 1"
)
def r_dedup(spark, sf_dir):
    h = lexical(spark, sf_dir).withColumn("body", F.md5("content"))
    h = h.withColumn("supporting", F.count("*").over(Window.partitionBy("query_id", "body")))
    return R.first_per(h, ["query_id", "body"], ["rank"]).select("query_id", "chunk_id", "rank", "supporting")


@query(
    f"WITH {CHUNKS}, s AS (SELECT c.chunk_id, c.ordinal, (CASE WHEN c.source ILIKE '%src1%' THEN 4 ELSE 0 END) + (CASE WHEN d.lang ILIKE '%E%' THEN 2 ELSE 0 END) + (CASE WHEN c.content ILIKE '%the%' THEN 1 ELSE 0 END) AS score "
    "FROM chunks c JOIN documents d ON c.doc_id = d.doc_id) SELECT chunk_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0"
)
def r_ilike(spark, sf_dir):
    c = chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    parts = [F.when(F.col(k).ilike(p), n).otherwise(0) for k, p, n in (("source", "%src1%", 4), ("lang", "%E%", 2), ("content", "%the%", 1))]
    return c.select("chunk_id", (parts[0] + parts[1] + parts[2]).cast("long").alias("score")).where("score > 0")


@query(
    f"WITH {_HITS}, n AS (SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)) "
    "SELECT h.query_id, h.chunk_id, n.prev_id, n.next_id FROM hits h JOIN n ON h.chunk_id = n.chunk_id"
)
def r_neighbors(spark, sf_dir):
    n = with_neighbors(chunks(spark, sf_dir)).select("chunk_id", "prev_id", "next_id")
    return lexical(spark, sf_dir).select("query_id", "chunk_id").join(n, "chunk_id").select("query_id", "chunk_id", "prev_id", "next_id")


@query(
    f"WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS k FROM hits) "
    "SELECT query_id, doc_id, max(score) AS best, count(*) AS hits, string_agg(chunk_id, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top FROM n GROUP BY query_id, doc_id"
)
def r_groups(spark, sf_dir):
    return R.grouped_hits(lexical(spark, sf_dir), ["query_id"], "doc_id", "score", "chunk_id")


@query(
    "WITH p AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'size', CAST(n_chars // 1000 AS VARCHAR) FROM documents), "
    "c AS (SELECT field, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY field, value), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM c) SELECT field, value, n FROM r WHERE k <= 20"
)
def r_facets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("size", F.expr("n_chars div 1000"))
    return R.facets(d, ["lang", "source", "size"])


@query(f"WITH {_HITS} SELECT query_id, chunk_id, rank FROM hits WHERE rank BETWEEN 6 AND 10")
def r_paging(spark, sf_dir):
    """The second page of five."""
    return lexical(spark, sf_dir).where(F.col("rank").between(6, 10)).select("query_id", "chunk_id", "rank")


@query(
    r"WITH v AS (SELECT item_id AS query_id, unnest([trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))), "
    r"string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), '.')[1]]) AS variant, unnest([1, 2, 3]) AS n FROM benchmark), "
    r"u AS (SELECT query_id, n, variant, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(replace(lower(variant), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) ORDER BY n) AS k FROM v) "
    "SELECT query_id, CAST(n AS BIGINT) AS n, variant FROM u WHERE k = 1"
)
def r_variants(spark, sf_dir):
    """The query, its lower case and its first sentence; variants with equal normal form fold."""
    flat = F.trim(F.regexp_replace("text", T.SPACE, " "))
    v = query_table(spark, sf_dir).select("query_id", F.posexplode(F.array(flat, F.lower(flat), F.substring_index(flat, ".", 1))).alias("n", "variant"))
    v = v.withColumn("form", T.normalize(F.col("variant")))
    return R.first_per(v, ["query_id", "form"], ["n"]).select("query_id", (F.col("n") + 1).cast("long").alias("n"), "variant")


@query(
    f"WITH {_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM hits) "
    "SELECT query_id, source, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY k, source) AS position FROM o"
)
def w_interleave(spark, sf_dir):
    return R.interleaved(lexical(spark, sf_dir).select("query_id", "source", "chunk_id", "rank"), "query_id", "source", "rank")


@query(
    f"WITH {_HITS}, u AS (SELECT *, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM hits) "
    "SELECT query_id, chunk_id, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000"
)
def d_pack_context(spark, sf_dir):
    """Context packing: the best chunks whose characters stay in the budget."""
    from lexmill.operators.answers import packed

    h = lexical(spark, sf_dir).withColumn("size", F.length("content").cast("long"))
    return packed(h, "query_id", ["rank"], "size", 6000).select("query_id", "chunk_id", "rank", "used")
