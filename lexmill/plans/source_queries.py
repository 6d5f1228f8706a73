"""Queries on readers and connectors, over relations that the tables give in the shape of their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators.embedding import hashed_embedding
from lexmill.plans.catalog import query
from lexmill.plans.relations import TEXTS, quoted, table, texts, words
from lexmill.sources import collections, connectors, dumps, markup, uploads


def _index(spark, sf_dir):
    """Ten pages a stream; urls as titles, so that titles hold colons."""
    lines = table(spark, sf_dir, "pages").select(F.concat_ws(":", F.expr("(page_id div 10) * 1000"), "page_id", "url").alias("value"))
    return dumps.index_columns(lines)


@query("SELECT (page_id // 10) * 1000 AS \"offset\", page_id, url AS title FROM pages")
def s_index_lines(spark, sf_dir):
    return _index(spark, sf_dir)


@query(
    "WITH s AS (SELECT (page_id // 10) * 1000 AS o, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS ids FROM pages GROUP BY 1), "
    "c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) "
    'SELECT o AS "offset", n AS n_pages, ids AS page_ids FROM c WHERE before < 35'
)
def s_streams(spark, sf_dir):
    """Whole streams until 35 pages are reached: the page limit is the operator's parameter."""
    return dumps.streams(_index(spark, sf_dir), 35).withColumn("page_ids", F.array_join(F.col("page_ids").cast("array<string>"), ","))


@query(
    "WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/skin/' WHEN 1 THEN 'a/-/' WHEN 2 THEN '/' ELSE '' END || regexp_replace(url, '^[a-z]+://[^/]+/', '') || CASE page_id % 5 WHEN 0 THEN '.css' ELSE '' END AS path, "
    "CASE WHEN page_id % 9 = 0 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS mime, page_id % 7 = 0 AS redirect, html FROM pages) "
    "SELECT page_id, path, CASE WHEN redirect THEN 'redirect' WHEN mime <> 'image/png' AND length(html) >= 40 AND NOT (contains(path, '/-/') OR ends_with(path, '.css') OR starts_with(path, '/skin/')) "
    "THEN 'article' ELSE 'skipped' END AS kind FROM p"
)
def s_archive_kinds(spark, sf_dir):
    i = F.col("page_id")
    head = F.when(i % 6 == 0, "/skin/").when(i % 6 == 1, "a/-/").when(i % 6 == 2, "/").otherwise("")
    path = F.concat(head, F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), F.when(i % 5 == 0, ".css").otherwise(""))
    mime = F.when(i % 9 == 0, "image/png").otherwise("Text/HTML; charset=utf-8")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), mime.alias("mime"), F.when(i % 7 == 0, "other").alias("redirect"), "html")
    return p.select("page_id", "path", dumps.archive_kind(F.col("path"), F.col("mime"), F.col("redirect"), F.col("html")).alias("kind"))


@query(
    "WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"''#]+)', 1)) AS target FROM pages) "
    "SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(target, '^[a-z]+:') THEN target WHEN starts_with(target, '//') THEN split_part(url, ':', 1) || ':' || target "
    "WHEN starts_with(target, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || target ELSE NULL END AS link FROM t"
)
def s_links(spark, sf_dir):
    return markup.links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def s_page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_title(F.col("html")).alias("title"))


@query()
def s_html_blocks(spark, sf_dir):
    return markup.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def s_html_sections(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return markup.html_sections(p, "page_id", "html", markup.html_title(F.col("html"))).withColumn("path", F.array_join("path", " / "))


@query()
def s_connector_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.connector_text(F.col("html")).alias("text"))


@query(
    "WITH RECURSIVE e AS (SELECT page_id AS a, page_id * 2 % 211 AS b FROM pages UNION SELECT page_id, (page_id * 3 + 1) % 211 FROM pages), "
    "k AS (SELECT page_id FROM pages WHERE page_id % 10 <> 9), r AS (SELECT CAST(1 AS BIGINT) AS page_id, 0 AS depth UNION "
    "SELECT e.b, r.depth + 1 FROM r JOIN e ON r.page_id = e.a JOIN k ON e.b = k.page_id WHERE r.depth < 3) "
    "SELECT 'http://host/p' || CAST(page_id AS VARCHAR) AS url, min(depth) AS depth FROM r GROUP BY page_id"
)
def s_crawl(spark, sf_dir):
    """Three steps from one page over links that page numbers give; pages ending in 9 are excluded."""
    i = F.col("page_id")
    link = lambda n: F.concat(F.lit('<a href="/p'), n.cast("string"), F.lit('">x</a>'))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://host/p"), i.cast("string")).alias("url"), F.concat(link(i * 2 % 211), link((i * 3 + 1) % 211)).alias("html"))
    return connectors.crawl(p, p.where("url = 'http://host/p1'"), ["host"], 3, "9$")


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, trim(text) AS text FROM benchmark")
def s_topics(spark, sf_dir):
    return collections.topics(table(spark, sf_dir, "benchmark").select(F.concat_ws("\t", "item_id", "text").alias("value")))


@query("SELECT CAST(toxic AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, quality AS relevance FROM labels WHERE quality > 0")
def s_judgements(spark, sf_dir):
    return collections.judgements(table(spark, sf_dir, "labels").select(F.concat_ws(" ", "toxic", F.lit("Q0"), "doc_id", "quality").alias("value")))


_EXTENSIONS = (".txt", ".zip", ".DOCM", ".exe", ".pdf", ".html", ".md")


@query(
    f"WITH u AS (SELECT doc_id, CASE doc_id % 7 {' '.join(f'WHEN {i} THEN {quoted(e)}' for i, e in enumerate(_EXTENSIONS))} END AS ext, encode(coalesce(text, '')) AS data FROM documents) "
    "SELECT doc_id, CASE WHEN octet_length(data) = 0 THEN 'ZERO_BYTE' WHEN octet_length(data) > 5000 THEN 'OVERSIZED' WHEN doc_id % 11 = 0 THEN 'SIZE_MISMATCH' WHEN doc_id % 13 = 0 THEN 'CHECKSUM_MISMATCH' "
    "WHEN ext = '.zip' THEN 'ARCHIVE_NOT_ALLOWED' WHEN ext = '.DOCM' THEN 'MACRO_OFFICE_NOT_ALLOWED' WHEN ext = '.exe' THEN 'UNSUPPORTED_EXTENSION' WHEN ext = '.pdf' THEN 'SIGNATURE_MISMATCH' "
    "WHEN ext = '.html' AND regexp_matches(decode(data), '(?i)(?:src|href)\\s*=\\s*[\"'']\\s*https?://') THEN 'REMOTE_HTML_RESOURCE' END AS failure FROM u"
)
def s_upload_failures(spark, sf_dir):
    i = F.col("doc_id")
    ext = F.element_at(F.array(*(F.lit(e) for e in _EXTENSIONS)), (i % 7 + 1).cast("int"))
    u = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file"), ext).alias("name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    size = F.octet_length("data") + F.when(i % 11 == 0, 1).otherwise(0)
    digest = F.when(i % 13 == 0, "0").otherwise(F.upper(F.sha2("data", 256)))
    return u.select("doc_id", uploads.failure(F.col("name"), F.col("data"), size, digest, most=5000).alias("failure"))


@query(
    f"WITH {TEXTS}, g AS (SELECT id, text, CASE WHEN id % 2 = 0 THEN 'Table.pdf' ELSE 'note.txt' END AS name, CASE WHEN id % 3 = 0 THEN 'Formula' ELSE '' END AS warning, CASE WHEN id % 4 = 0 THEN 'high_quality' ELSE 'fast' END AS profile FROM cases) "
    "SELECT id, concat_ws(',', CASE WHEN profile = 'high_quality' THEN 'high_quality_profile' END, CASE WHEN trim(text) = '' THEN 'empty_text' END, "
    f"CASE WHEN (length(text) - length(replace(text, chr(65533), ''))) / greatest(length(text), 1) > 0.01 THEN 'replacement_character_ratio' END, CASE WHEN name = 'Table.pdf' AND len({words('text')}) < 30 THEN 'scanned_or_low_text_pdf' END, "
    "CASE WHEN name = 'Table.pdf' AND id % 5 = 0 THEN 'expected_tables_missing' END, CASE WHEN warning = 'Formula' THEN 'complex_layout_signal' END) AS reasons FROM g"
)
def s_gate_reasons(spark, sf_dir):
    i = F.col("id")
    name, warning = F.when(i % 2 == 0, "Table.pdf").otherwise("note.txt"), F.when(i % 3 == 0, "Formula").otherwise("")
    profile = F.when(i % 4 == 0, "high_quality").otherwise("fast")
    return texts(spark, sf_dir).select("id", F.array_join(uploads.gate_reasons(name, F.col("text"), warning, F.when(i % 5 == 0, 0).otherwise(1), profile), ",").alias("reasons"))


@query()
def s_markdown_blocks(spark, sf_dir):
    return uploads.markdown_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumn("path", F.array_join("path", " / "))


@query()
def t_hashed_embedding(spark, sf_dir):
    return hashed_embedding(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("embedding", F.array_join(F.col("embedding").cast("array<string>"), ","))
