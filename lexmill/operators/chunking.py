"""Documents to chunks, sections and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def word_chunks(docs: DataFrame, size: int = 220, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, source, text, keep) -> doc_id, source, ordinal, chunk_id, n_words, content, keep. No shuffle; blank texts have no chunk.

    A document is cut before its chunks become rows, so that no row carries the words of the others.
    """
    w = docs.select("doc_id", "source", *keep, T.words(F.col("text")).alias("w"))
    cut = F.transform(F.expr(f"sequence(0L, (size(w) - 1) div {size})"), lambda i: F.slice("w", (i * size + 1).cast("int"), F.lit(size)))
    parts = w.select("doc_id", "source", *keep, F.posexplode(F.when(F.size("w") > 0, cut)).alias("_n", "p")).withColumn("ordinal", F.col("_n").cast("long"))
    out = parts.select("doc_id", "source", "ordinal", T.stable_hash(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "p", *keep)
    return out.select("doc_id", "source", "ordinal", "chunk_id", F.size("p").cast("long").alias("n_words"), F.array_join("p", " ").alias("content"), *keep)


def with_neighbors(chunks: DataFrame) -> DataFrame:
    """Previous and next chunk of the same document."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks.withColumns({"prev_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})


def sections(chunks: DataFrame, path: list[str]) -> DataFrame:
    """Chunks grouped by path: level, first and last chunk, number of chunks, parent path."""
    key = F.concat_ws("/", *path)
    parent = F.concat_ws("/", *path[:-1])
    g = chunks.groupBy(key.alias("path"), parent.alias("parent"))
    order = F.struct("doc_id", "ordinal")
    return g.agg(F.min_by("chunk_id", order).alias("first_chunk"), F.max_by("chunk_id", order).alias("last_chunk"), F.count("*").alias("n_chunks")).withColumn(
        "level", F.lit(len(path)).cast("long")
    )


def parent_child(sections_: DataFrame, parent: int = 900, child: int = 220, tail: int = 180) -> DataFrame:
    """sections(doc_id, section, text) -> child windows with the length of their parent text.

    A window shorter than ``tail`` goes if its document has an earlier window.
    """
    w = sections_.select("doc_id", "section", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    c = w.select("doc_id", "section", F.size("w").alias("n"), F.explode(F.expr(f"sequence(0, (size(w) - 1) div {child})")).alias("ordinal"))
    c = c.withColumn("n_words", F.least(F.lit(child), F.col("n") - F.col("ordinal") * child).cast("long"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "ordinal"))
    c = c.withColumn("k", first).where((F.col("n_words") >= tail) | (F.col("k") == 1))
    return c.select("doc_id", "section", F.col("ordinal").cast("long").alias("ordinal"), "n_words", F.least("n", F.lit(parent)).cast("long").alias("parent_words"))


def located(starts: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """starts(key, start, ...), blocks(key, block, words, path, locator) -> the starts, and block, path and locator of the block that holds the word at start.

    An as-of join: block starts (running sums of words) and chunk starts of a document in one order, each chunk taking the last block before it, so that no range is joined. A block without words
    holds the word at its place first. Behind the last block: no block, the last path, no locator. Documents without blocks keep their starts, with nulls.
    """
    order = Window.partitionBy(key).orderBy("block")
    low = F.sum("words").over(order) - F.col("words")
    b = blocks.select(key, "block", "words", "path", "locator", low.alias("low"), F.last("path").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"))
    held = F.struct("block", "path", "locator", (F.col("low") + F.col("words")).alias("high"), "final")
    rest = [c for c in starts.columns if c not in (key, "start")]
    events = b.where("words > 0").select(key, F.col("low").alias("at"), F.lit(0).alias("kind"), held.alias("held"), F.lit(None).cast(f"struct<{', '.join(f'{c}: {k}' for c, k in starts.dtypes if c in rest)}>").alias("own"))
    asked = starts.select(key, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["held"].dataType).alias("held"), F.struct(*rest).alias("own"))
    last = F.last("held", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = events.unionByName(asked).withColumn("held", last).where("kind = 1")
    empty = b.where("words = 0").groupBy(key, F.col("low").alias("at")).agg(F.min_by(F.struct("block", "path", "locator"), "block").alias("empty"))
    found = found.join(empty, [key, "at"], "left")
    inside = F.col("at") < F.col("held.high")
    pick = lambda c: F.coalesce(F.col(f"empty.{c}"), F.when(inside, F.col(f"held.{c}")))
    return found.select(key, F.col("at").alias("start"), "own.*", pick("block").alias("block"), F.coalesce(pick("path"), F.col("held.final")).alias("path"), pick("locator").alias("locator"))


def page_chunks(pages: DataFrame, sections_: DataFrame, size: int = 220) -> DataFrame:
    """pages(page_id, title, ns, redirect), sections(page_id, section, path, text) -> page_id, ordinal, section, path, chunk_index, content.

    Pages of other name spaces go. A redirect is one chunk that says so, whatever sections it has; the others' sections are cut every
    ``size`` words, none across a section. ordinal counts a page's chunks from 1, chunk_index those of a section.
    """
    articles = pages.where("ns = 0")
    w = sections_.join(articles.where("redirect is null").select("page_id"), "page_id", "left_semi").select("page_id", "section", "path", T.words(F.col("text")).alias("w"))
    c = w.where(F.size("w") > 0).select("page_id", "section", "path", "w", F.explode(F.expr(f"sequence(0L, (size(w) - 1) div {size})")).alias("i"))
    ordinal = F.row_number().over(Window.partitionBy("page_id").orderBy("section", "i")).cast("long")
    content = F.array_join(F.slice("w", (F.col("i") * size + 1).cast("int"), F.lit(size)), " ")
    c = c.select("page_id", ordinal.alias("ordinal"), F.col("section").cast("long").alias("section"), "path", (F.col("i") + 1).alias("chunk_index"), content.alias("content"))
    one = F.lit(1).cast("long")
    said = F.concat("title", F.lit(" перенаправляет на "), "redirect", F.lit("."))
    r = articles.where("redirect is not null").select("page_id", one.alias("ordinal"), F.lit(0).cast("long").alias("section"), F.col("title").alias("path"), one.alias("chunk_index"), said.alias("content"))
    return c.unionByName(r)
