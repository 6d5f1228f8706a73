"""Queries on texts and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import tables
from lexmill.functions import text as T
from lexmill.operators import chunking as C
from lexmill.plans.catalog import query
from lexmill.plans.relations import CASES, CHUNKS, TEXTS, cases, chunks, norm, table, texts, toks, words

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT doc_id, md5({norm('text')}) AS normal_md5 FROM documents")
def t_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal_md5"))


@query(
    f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, "
    f"CAST(len(list_distinct(list_filter(t, lambda w: length(w) > 2))) AS BIGINT) AS n_content, "
    rf"CAST(len(list_distinct(list_filter(t, lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '\p{{N}}+')))) AS BIGINT) AS n_significant "
    f"FROM (SELECT doc_id, {toks('text')} AS t FROM documents)"
)
def t_tokens(spark, sf_dir):
    x = F.col("text")
    size = lambda c: F.size(c).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", size(T.tokens(x)).alias("n_tokens"), size(T.distinct_tokens(x)).alias("n_distinct"), size(T.distinct_tokens(x, 2)).alias("n_content"),
        size(T.significant_terms(x)).alias("n_significant"),
    )


@query(
    r"SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) AS BIGINT) AS tokens, "
    "CAST(greatest(1, length(text) // 4) AS BIGINT) AS estimated, "
    "round((length(text) - length(replace(text, '�', ''))) / greatest(length(text), 1), 6) AS replaced FROM documents"
)
def t_token_count(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(x).alias("tokens"), T.estimated_tokens(x).alias("estimated"), F.round(T.replacement_ratio(x), 6).alias("replaced"))


@query(
    f"WITH {CASES}, both_ AS (SELECT id, text FROM cases UNION ALL SELECT doc_id + 100 AS id, text FROM documents), "
    "n AS (SELECT id, len(regexp_extract_all(lower(text), '[а-яё]')) AS c, len(regexp_extract_all(lower(text), '[a-z]')) AS l FROM both_) "
    "SELECT id, CASE WHEN c + l = 0 THEN 'und' WHEN c >= l THEN 'ru' ELSE 'en' END AS language, "
    "round(CASE WHEN c + l = 0 THEN 0.0 ELSE least(0.99, greatest(0.5, greatest(c, l) / (c + l))) END, 6) AS confidence FROM n"
)
def t_lang_detect(spark, sf_dir):
    both = cases(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    return both.select("id", T.script_language(F.col("text")).alias("x")).select("id", "x.*")


_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)


@query(
    f"WITH {TEXTS}, f AS (SELECT id, "
    r"regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b') AS iso, regexp_extract_all(text, '\b\d{1,2}\.\d{1,2}\.\d{4}\b') AS dotted, "
    rf"regexp_extract_all(lower(text), '\b\d{{1,2}} (?:{'|'.join(T.MONTHS)}) \d{{4}}\b') AS named FROM cases), "
    "s AS (SELECT id, 1 AS kind, unnest(iso) AS raw, unnest(range(0, len(iso))) AS pos FROM f UNION ALL "
    "SELECT id, 2, unnest(dotted), unnest(range(0, len(dotted))) FROM f UNION ALL SELECT id, 3, unnest(named), unnest(range(0, len(named))) FROM f), "
    "d AS (SELECT id, kind, pos, CASE kind WHEN 1 THEN raw WHEN 2 THEN string_split(raw, '.')[3] || '-' || lpad(string_split(raw, '.')[2], 2, '0') || '-' || lpad(string_split(raw, '.')[1], 2, '0') "
    f"ELSE string_split(raw, ' ')[3] || '-' || lpad(CAST(list_position([{_MONTHS}], string_split(raw, ' ')[2]) AS VARCHAR), 2, '0') || '-' || lpad(string_split(raw, ' ')[1], 2, '0') END AS day FROM s), "
    "v AS (SELECT id, day, min(kind * 1000 + pos) AS place FROM d WHERE TRY_CAST(day AS DATE) IS NOT NULL GROUP BY id, day) "
    "SELECT c.id, coalesce(string_agg(v.day, ',' ORDER BY v.place), '') AS days FROM cases c LEFT JOIN v ON c.id = v.id GROUP BY c.id"
)
def t_date_detect(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(T.dates(F.col("text")), ",").alias("days"))


@query(
    f"WITH {TEXTS}, v AS (SELECT id, unnest(x) AS value, unnest(range(0, len(x))) AS pos FROM (SELECT id, regexp_extract_all(text, '{T.VALUES}') AS x FROM cases)), "
    "o AS (SELECT id, value, min(pos) AS pos FROM v GROUP BY id, value), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM o) "
    r"SELECT c.id, coalesce(string_agg(k.value, '|' ORDER BY k.pos), '') AS found, CAST(len(list_distinct(regexp_extract_all(any_value(c.text), '\b[A-Z]{2,}-\d+\b'))) AS BIGINT) AS codes "
    "FROM cases c LEFT JOIN k ON c.id = k.id AND k.n <= 8 GROUP BY c.id"
)
def t_values(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(T.values(F.col("text")), "|").alias("found"), F.size(T.codes(F.col("text"))).cast("long").alias("codes"))


@query(
    f"WITH p AS (SELECT doc_id, list_distinct({toks('text')}) AS a, lead(list_distinct({toks('text')})) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) "
    "SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM p WHERE b IS NOT NULL"
)
def t_jaccard(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "documents").select("doc_id", "source", T.distinct_tokens(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("source").orderBy("doc_id"))).where("b is not null")
    return t.select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(
    "SELECT doc_id, substr(sha1(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(source, 'None') || chr(31) || coalesce(lang, 'None') || chr(31)), 1, 24) AS id, "
    "sha256(coalesce(text, '')) AS text_sha256 FROM documents"
)
def t_stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.stable_hash(F.col("doc_id"), F.col("source"), F.col("lang")).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


@query(f"WITH {TEXTS} SELECT id, regexp_matches(lower(text), '{'|'.join(T.NO_ANSWER)}') AS no_answer, " + r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS answer_form FROM cases")
def t_no_answer(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.no_answer(F.col("text")).alias("no_answer"), T.answer_form(F.col("text")).alias("answer_form"))


@query(
    r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), "
    "p AS (SELECT doc_id, t, instr(lower(t), 'the') AS pos FROM f), "
    "s AS (SELECT doc_id, t, least(greatest(0, (CASE WHEN pos > 0 THEN pos ELSE 1 END) - 1 - 180), length(t) - 360) AS start FROM p) "
    "SELECT doc_id, CASE WHEN length(t) <= 360 THEN t ELSE (CASE WHEN start > 0 THEN '...' ELSE '' END) || substr(t, CAST(start + 1 AS BIGINT), 360) || (CASE WHEN start + 360 < length(t) THEN '...' ELSE '' END) END AS snippet FROM s"
)
def t_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query(
    f"WITH t AS (SELECT doc_id, source, list_distinct({toks('text')}) AS a FROM documents), p AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM t) "
    "SELECT doc_id, (len(list_intersect(a, b)) > 0 OR len(list_intersect(list_transform(list_filter(a, lambda w: length(w) >= 5), lambda w: substr(w, 1, 5)), "
    "list_transform(list_filter(b, lambda w: length(w) >= 5), lambda w: substr(w, 1, 5)))) > 0) AS overlap FROM p WHERE b IS NOT NULL"
)
def t_prefix_overlap(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "documents").select("doc_id", "source", T.distinct_tokens(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("source").orderBy("doc_id"))).where("b is not null")
    return t.select("doc_id", T.terms_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, ordinal, n_words, md5(content) AS content_md5 FROM chunks")
def c_word_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", "ordinal", "n_words", F.md5("content").alias("content_md5"))


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, ordinal, n_words, md5(content) AS content_md5 FROM chunks")
def c_table_function(spark, sf_dir):
    """The same chunks from SQL, by a table function over the whole table."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunk_id = "substr(sha1(concat(doc_id, char(31), ordinal, char(31))), 1, 24)"
    return spark.sql(f"SELECT {chunk_id} AS chunk_id, doc_id, ordinal, n_words, md5(content) AS content_md5 FROM word_windows(TABLE(SELECT * FROM {{docs}}), 220)", docs=docs)


@query(f"WITH {CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
def c_neighbors(spark, sf_dir):
    return C.with_neighbors(chunks(spark, sf_dir)).select("chunk_id", "prev_id", "next_id")


@query(
    f"WITH {CHUNKS}, c AS (SELECT c.*, d.lang FROM chunks c JOIN documents d ON c.doc_id = d.doc_id), "
    "r AS (SELECT source || '/' || lang AS path, source AS parent, chunk_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id, ordinal) AS up, "
    "row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC, ordinal DESC) AS down FROM c) "
    "SELECT path, parent, max(CASE WHEN up = 1 THEN chunk_id END) AS first_chunk, max(CASE WHEN down = 1 THEN chunk_id END) AS last_chunk, count(*) AS n_chunks, CAST(2 AS BIGINT) AS level FROM r GROUP BY path, parent"
)
def c_sections(spark, sf_dir):
    c = chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return C.sections(c, ["source", "lang"])


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL), "
    r"b AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l) "
    "SELECT doc_id, CAST(pos AS BIGINT) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS block, length(line) AS n_chars FROM b WHERE line <> ''"
)
def c_paragraphs(spark, sf_dir):
    """Every line with words is a block; blocks are numbered within the document."""
    x = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    x = x.withColumn("line", F.trim(F.regexp_replace("line", T.SPACE, " "))).where("line <> ''")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return x.select("doc_id", F.col("at").cast("long").alias("line_no"), n.cast("long").alias("block"), F.length("line").cast("long").alias("n_chars"))


@query(
    "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS section FROM documents WHERE text IS NOT NULL), "
    f"w AS (SELECT doc_id, section, len({words('line')}) AS n FROM s), c AS (SELECT doc_id, section, n, unnest(range(0, (n + 219) // 220)) AS ordinal FROM w WHERE n > 0), "
    "k AS (SELECT *, least(220, n - ordinal * 220) AS n_words, row_number() OVER (PARTITION BY doc_id ORDER BY section, ordinal) AS k FROM c) "
    "SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(ordinal AS BIGINT) AS ordinal, CAST(n_words AS BIGINT) AS n_words, CAST(least(n, 900) AS BIGINT) AS parent_words FROM k WHERE n_words >= 180 OR k = 1"
)
def c_parent_child(spark, sf_dir):
    """Lines as sections."""
    s = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("section", "text"))
    return C.parent_child(s.withColumn("section", F.col("section").cast("long")))


@query(
    f"WITH p AS (SELECT doc_id AS page_id, 'T' || doc_id AS title, CASE WHEN doc_id % 9 = 0 THEN 'T' || (doc_id + 1) END AS redirect, text FROM documents WHERE doc_id % 5 <> 4 AND text IS NOT NULL), "
    "s AS (SELECT page_id, title, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section FROM p WHERE redirect IS NULL), "
    f"w AS (SELECT page_id, title, section, {words('body')} AS w FROM s), c AS (SELECT *, unnest(range(0, (len(w) + 219) // 220)) AS i FROM w WHERE len(w) > 0) "
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY section, i) AS ordinal, section, title || '/' || section AS path, i + 1 AS chunk_index, array_to_string(list_slice(w, i * 220 + 1, i * 220 + 220), ' ') AS content FROM c "
    "UNION ALL SELECT page_id, 1, 0, title, 1, title || ' перенаправляет на ' || redirect || '.' FROM p WHERE redirect IS NOT NULL"
)
def c_page_chunks(spark, sf_dir):
    """Documents as pages, their lines as sections; every fifth is in another name space, every ninth a redirect."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("text is not null")
    title = F.concat(F.lit("T"), i.cast("string"))
    pages = d.select(i.alias("page_id"), title.alias("title"), F.when(i % 5 == 4, 1).otherwise(0).alias("ns"), F.when(i % 9 == 0, F.concat(F.lit("T"), (i + 1).cast("string"))).alias("redirect"))
    lines = d.select(i.alias("page_id"), title.alias("title"), F.posexplode(F.split("text", "\n")).alias("section", "text"))
    return C.page_chunks(pages, lines.select("page_id", "section", F.concat_ws("/", "title", F.col("section").cast("string")).alias("path"), "text"))


@query(
    f"WITH {CHUNKS}, lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL), "
    f"sized AS (SELECT doc_id, source, no, len({words('line')}) AS n FROM lines), "
    "blocks AS (SELECT doc_id, source || '/' || (no // 10) AS path, no, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY no) - n AS BIGINT) AS low FROM sized WHERE n > 0) "
    "SELECT c.chunk_id, c.ordinal, CAST(b.no AS BIGINT) AS line, b.path FROM chunks c ASOF JOIN blocks b ON c.doc_id = b.doc_id AND c.ordinal * 220 >= b.low"
)
def c_located_chunks(spark, sf_dir):
    """Every chunk with the line that holds its first word, and that line's section (ten lines each)."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    line = d.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    line = line.select("doc_id", "source", (F.col("no") + 1).cast("long").alias("block"), F.size(T.words(F.col("line"))).alias("words")).where("words > 0")
    blocks = line.select("doc_id", "block", "words", F.concat_ws("/", "source", F.expr("block div 10").cast("string")).alias("path"), F.col("block").alias("locator"))
    starts = chunks(spark, sf_dir).select("doc_id", (F.col("ordinal") * 220).alias("start"), "chunk_id", "ordinal")
    return C.located(starts, blocks, "doc_id").select("chunk_id", "ordinal", F.col("locator").alias("line"), "path")
