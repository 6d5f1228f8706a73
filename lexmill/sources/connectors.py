"""Document sources: a folder, exported records of issue trackers and wikis, and a crawl over stored pages.

All give external_id, title, text, version and url. Nothing is fetched: remote systems are read from their exports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.changes import missing
from lexmill.sources.markup import connector_text, html_title, links
from lexmill.sources.uploads import extension, read_uploads

DOCUMENT = ("external_id", "title", "text", "version", "url")


def folder(spark: SparkSession, directory: str, extensions: tuple[str, ...] = (".txt", ".md", ".html", ".csv", ".json")) -> DataFrame:
    """Files below a directory; the version is the SHA-256 of the bytes, the external id the path below the directory."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    f = f.select(F.col("path").alias("url"), F.substring_index("path", "/", -1).alias("name"), F.col("content").alias("data"), F.sha2("content", 256).alias("version"))
    below = F.element_at(F.split("url", F.lit(directory.rstrip("/").split(":")[-1] + "/"), 2), -1)
    return read_uploads(f.where(extension(F.col("name")).isin(*extensions)).withColumn("external_id", below)).select(*DOCUMENT)


def tombstones(known: DataFrame, seen: DataFrame, full: bool) -> DataFrame:
    """Known external ids that a full listing no longer shows; none for a partial one."""
    gone = missing(known, seen, "external_id").select("external_id")
    return gone if full else gone.limit(0)


def wiki_pages(export: DataFrame) -> DataFrame:
    """export(id, title, version, url, body as HTML) -> documents."""
    return export.select(F.col("id").cast("string").alias("external_id"), "title", connector_text(F.col("body")).alias("text"), F.col("version").cast("string").alias("version"), "url")


def issues(export: DataFrame) -> DataFrame:
    """export(key, summary, status, description, comments array<string>, updated, url) -> documents: fields and comments as lines."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    comments = F.transform(F.coalesce("comments", F.array().cast("array<string>")), lambda c: F.concat(F.lit("Comment: "), c))
    parts = F.concat(F.array(F.concat_ws(": ", "key", "summary"), line("Status", F.col("status")), F.col("description")), comments)
    return export.select(F.col("key").alias("external_id"), F.col("summary").alias("title"), F.array_join(F.array_compact(parts), "\n\n").alias("text"), F.col("updated").cast("string").alias("version"), "url")


def repository_files(export: DataFrame, allowed: tuple[str, ...] = (), extensions: tuple[str, ...] = (".md", ".txt", ".rst")) -> DataFrame:
    """export(path, blob_id, content, url) -> documents: text files below the allowed paths (all if none is named)."""
    below = F.lit(not allowed)
    for a in allowed:
        below |= F.col("path").startswith(a)
    kept = export.where(below & extension(F.col("path")).isin(*extensions))
    return kept.select(F.col("path").alias("external_id"), F.substring_index("path", "/", -1).alias("title"), F.col("content").alias("text"), F.col("blob_id").alias("version"), "url")


def crawl(pages: DataFrame, seeds: DataFrame, domains: list[str], depth: int = 2, exclude: str | None = None, most: int | None = None) -> DataFrame:
    """pages(url, html), seeds(url) -> url, depth of every page that links lead to in at most ``depth`` steps, shallowest first.

    Breadth-first by one join a step: a step takes the links of the last step's pages and drops what was seen. Only pages of the allowed
    hosts that no pattern excludes count; ``most`` keeps that many pages by depth and url. Steps are checkpointed where the session
    names a checkpoint folder.
    """
    ok = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).isin([d.lower() for d in domains])
    if exclude:
        ok &= ~F.col("url").rlike(exclude)
    known = pages.select("url").where(ok).distinct()
    edges = links(pages.where(ok), "url", "url", "html").select("url", F.col("link").alias("to"))
    keep = (lambda df: df.checkpoint()) if pages.sparkSession.conf.get("spark.checkpoint.dir", None) else (lambda df: df)
    front = seeds.select("url").join(known, "url", "left_semi").distinct().withColumn("depth", F.lit(0))
    seen = front = keep(front)
    for step in range(1, depth + 1):
        reached = front.join(edges, "url").select(F.col("to").alias("url")).distinct().join(known, "url", "left_semi")
        front = keep(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)


def crawled(pages: DataFrame, reached: DataFrame) -> DataFrame:
    """Documents of the pages that a crawl reached; a page without a title is named by its url."""
    p = pages.join(reached.select("url"), "url", "left_semi").withColumn("text", connector_text(F.col("html")))
    title = F.coalesce(F.nullif(html_title(F.col("html")), F.lit("")), F.col("url"))
    return p.select(F.col("url").alias("external_id"), title.alias("title"), "text", F.sha2("text", 256).alias("version"), "url")
