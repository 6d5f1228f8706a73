"""Encyclopaedia dumps: the index of a multistream archive, its streams, page elements, and entries of page archives."""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.sources.markup import redirect_target

# Fixed values.
SERVICE_PATHS = ("mainPage",)
SERVICE_PREFIXES = ("-", "I/", "M/", "S/", "skin/", "media/", "static/", "assets/")
SERVICE_SUFFIXES = (".css", ".js", ".json", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".woff", ".woff2", ".ttf", ".otf")
PAGE = "page_id long, title string, ns long, redirect string, revision_id long, revision_at string, text string"
_XML = "id long, title string, ns long, redirect struct<_title string>, revision struct<id long, timestamp string, text struct<_VALUE string>>"


def index_columns(lines: DataFrame, line: str = "value") -> DataFrame:
    """offset, page_id, title of lines offset:page_id:title (a title may hold colons), other columns kept; any other line is an error."""
    parts = F.split(F.col(line), ":", 3)
    good = F.col(line).rlike(r"^\d+:\d+:")
    checked = F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("not an index line: "), F.col(line))).cast("array<string>"))
    rest = [c for c in lines.columns if c != line]
    x = lines.where(F.trim(line) != "").withColumn("_p", checked)
    return x.select(*rest, x["_p"][0].cast("long").alias("offset"), x["_p"][1].cast("long").alias("page_id"), x["_p"][2].alias("title"))


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """The index (plain or bz2) with ``split`` (where its file split begins) and ``line`` (increasing inside a split)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return index_columns(lines)


def index_report(entries: DataFrame) -> DataFrame:
    """One row: entries, streams, first and last offset, and ``backward``, the number of offsets below the one before.

    Lines are compared inside their split; between splits only the splits' ends are, so no task holds the whole index.
    """
    inside = Window.partitionBy("split").orderBy("line")
    x = entries.withColumn("back", (F.col("offset") < F.lag("offset").over(inside)).cast("long"))
    per = x.groupBy("split").agg(
        F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"), F.min_by("offset", "line").alias("first"),
        F.max_by("offset", "line").alias("last"), F.coalesce(F.sum("back"), F.lit(0)).alias("back"),
    )
    per = per.withColumn("jump", (F.col("first") < F.lag("last").over(Window.orderBy("split"))).cast("long"))  # one row per split
    ends = per.agg(F.sum("n").alias("entries"), F.min("low").alias("first_offset"), F.max("high").alias("last_offset"), (F.sum("back") + F.coalesce(F.sum("jump"), F.lit(0))).alias("backward"))
    return ends.crossJoin(entries.agg(F.countDistinct("offset").alias("streams")))


def streams(entries: DataFrame, pages: int | None = None) -> DataFrame:
    """offset, n_pages, page_ids; with ``pages``, whole streams from the first on until that many pages are reached."""
    s = entries.groupBy("offset").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list("page_id")).alias("page_ids"))
    if pages is None:
        return s
    low = s.orderBy("offset").limit(pages)  # a stream has a page at least, so no later stream can be needed
    before = F.coalesce(F.sum("n_pages").over(Window.orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return low.withColumn("before", before).where(F.col("before") < pages).drop("before")


def pages_of_xml(xml: str) -> Iterator[tuple]:
    """Rows of PAGE; pages without a revision are skipped."""
    for page in ElementTree.fromstring(f"<pages>{xml}</pages>").iter("page"):
        revision = page.find("revision")
        if revision is not None:
            number = lambda v: int(v) if v else None
            redirect = page.find("redirect")
            yield (
                number(page.findtext("id")), page.findtext("title"), number(page.findtext("ns")), None if redirect is None else redirect.get("title"),
                number(revision.findtext("id")), revision.findtext("timestamp"), revision.findtext("text") or "",
            )


def read_streams(offsets: DataFrame, uri: str, block: int = 1 << 20) -> DataFrame:
    """Pages of the streams at some offsets: every task seeks to its streams and unpacks one at a time; a cut stream is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_file(path) as f:
            for batch in batches:
                for offset in batch["offset"]:
                    f.seek(int(offset))
                    unpack, parts = bz2.BZ2Decompressor(), []
                    while not unpack.eof:
                        data = f.read(block)
                        if not data:
                            raise EOFError(f"the stream at {offset} is cut")
                        parts.append(unpack.decompress(data))
                    yield pd.DataFrame(list(pages_of_xml(b"".join(parts).decode())), columns=[c.split()[0] for c in PAGE.split(", ")])

    return with_redirect(offsets.select("offset").distinct().mapInPandas(run, PAGE))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """All page elements of XML files (plain or bz2) by Spark's own reader."""
    x = spark.read.format("xml").option("rowTag", "page").schema(_XML.replace("text struct<_VALUE string>", "text string")).load(path)
    x = x.where("revision is not null")
    r = F.col("revision")
    return with_redirect(x.select(F.col("id").alias("page_id"), "title", "ns", F.col("redirect._title").alias("redirect"), r["id"].alias("revision_id"), r["timestamp"].alias("revision_at"), F.coalesce(r["text"], F.lit("")).alias("text")))


def with_redirect(pages: DataFrame) -> DataFrame:
    """The redirect element's title, or else the one that the text names."""
    return pages.withColumn("redirect", F.coalesce("redirect", redirect_target(F.col("text"))))


def aliases(pages: DataFrame) -> DataFrame:
    """title, aliases: titles of the redirects to a page, sorted."""
    return pages.where("redirect is not null").groupBy(F.col("redirect").alias("title")).agg(F.array_sort(F.collect_set("title")).alias("aliases"))


def service_path(path: Column) -> Column:
    p = F.regexp_replace(path, "^/+", "")
    tests = [p.isin(*SERVICE_PATHS), p.contains("/-/"), *(p.startswith(x) for x in SERVICE_PREFIXES), *(p.endswith(x) for x in SERVICE_SUFFIXES)]
    out = tests[0]
    for t in tests[1:]:
        out |= t
    return out


def archive_kind(path: Column, mimetype: Column, redirect: Column, text: Column, least: int = 40) -> Column:
    """redirect, article (HTML or plain text of some length outside the service paths) or skipped."""
    readable = F.lower(F.trim(F.substring_index(mimetype, ";", 1))).isin("text/html", "text/plain")
    article = readable & ~service_path(path) & (F.length(text) >= least)
    return F.when(redirect.isNotNull(), "redirect").when(article, "article").otherwise("skipped")


def source_url(base: Column, path: Column) -> Column:
    """The path below a base address, percent-encoded but for / : and @."""
    safe = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, sign in (("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        safe = F.replace(safe, F.lit(code), F.lit(sign))
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.replace(safe, F.lit("*"), F.lit("%2A")))
