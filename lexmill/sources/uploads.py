"""Uploaded files: checks in order with the first failure's code, text and table readers, and the gate on what a reader made of them."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import replacement_ratio, words
from lexmill.operators.answers import first_failure

# Fixed values.
TEXT = (".txt", ".md", ".markdown", ".html", ".htm")
STRUCTURED = (".csv", ".tsv", ".json", ".jsonl")
OFFICE = (".pdf", ".docx", ".pptx", ".xlsx")
ARCHIVES = (".zip", ".7z", ".rar", ".tar", ".gz", ".bz2", ".xz")
MACROS = (".docm", ".xlsm", ".pptm")
REMOTE = r"""(?i)(?:src|href)\s*=\s*["']\s*https?://"""
LAYOUT_SIGNS = ("formula", "reading_order", "layout_warning")


def files(spark: SparkSession, directory: str) -> DataFrame:
    """name, data, size of every file below a directory."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return f.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").alias("data"), F.col("length").alias("size"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def _depth(value) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 0 if inner is None else 1 + max(map(_depth, inner), default=0)


def _json_depth(data: pd.Series, by_line: pd.Series) -> pd.Series:
    """Nesting of JSON values; -1 where a text is none."""

    def one(raw, lines) -> int:
        try:
            texts = [t for t in bytes(raw).decode().split("\n") if t.strip()] if lines else [bytes(raw).decode()]
            return max((_depth(json.loads(t)) for t in texts), default=0)
        except (ValueError, RecursionError):
            return -1

    return pd.Series([one(d, b) for d, b in zip(data, by_line)])


def failure(name: Column, data: Column, expected_size: Column, expected_sha256: Column, most: int = 50 << 20, depth: int = 64) -> Column:
    """Code of the first check that an upload fails; null if none."""
    ext, size = extension(name), F.octet_length(data)
    head, json_file, html = F.hex(F.substring(data, 1, 4)), ext.isin(".json", ".jsonl"), ext.isin(".html", ".htm")
    unreadable = ext.isin(*TEXT, *STRUCTURED) & ~F.is_valid_utf8(data.cast("string"))
    other = F.when(ext == ".pdf", head != "25504446").when(ext.isin(*OFFICE), head != "504B0304").otherwise(unreadable)
    nested = F.when(json_file, F.pandas_udf(_json_depth, "int")(F.when(json_file, data).otherwise(F.lit(b"0")), ext == ".jsonl"))
    checks = [
        ("ZERO_BYTE", size == 0), ("OVERSIZED", size > most), ("SIZE_MISMATCH", expected_size != size),
        ("CHECKSUM_MISMATCH", F.lower(expected_sha256) != F.sha2(data, 256)), ("ARCHIVE_NOT_ALLOWED", ext.isin(*ARCHIVES)),
        ("MACRO_OFFICE_NOT_ALLOWED", ext.isin(*MACROS)), ("UNSUPPORTED_EXTENSION", ~ext.isin(*TEXT, *STRUCTURED, *OFFICE)), ("SIGNATURE_MISMATCH", other),
        ("REMOTE_HTML_RESOURCE", html & data.cast("string").rlike(REMOTE)), ("INVALID_JSON", nested == -1), ("JSON_TOO_DEEP", nested > depth),
    ]
    return first_failure(checks)


def table_rows(data: bytes, tabs: bool) -> list[list[str]]:
    """Stripped cells of the rows that have any."""
    read = csv.reader(io.StringIO(bytes(data).decode("utf-8-sig")), delimiter="\t" if tabs else ",")
    return [row for row in ([c.strip() for c in r] for r in read) if any(row)]


def _content(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
    texts, tables = [], []
    for e, raw in zip(ext, data):
        raw, rows = bytes(raw), None
        if e in (".csv", ".tsv"):
            rows = table_rows(raw, e == ".tsv")
            text = "\n".join(" | ".join(r) for r in rows)
        elif e == ".json":
            text = json.dumps(json.loads(raw), ensure_ascii=False, indent=2, sort_keys=True)
        elif e == ".jsonl":
            text = "\n".join(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True) for x in raw.decode().split("\n") if x.strip())
        else:
            text = raw.decode()
        texts.append(text)
        tables.append(rows)
    return pd.DataFrame({"text": texts, "rows": tables})


def read_uploads(uploads: DataFrame) -> DataFrame:
    """uploads(name, data, ...) of text and structured files -> title (the name's stem), text, rows (cells of CSV and TSV); other kinds go."""
    ext = extension(F.col("name"))
    kept = uploads.where(ext.isin(*TEXT, *STRUCTURED)).withColumn("_c", F.pandas_udf(_content, "text string, rows array<array<string>>")(ext, F.col("data")))
    title = F.regexp_replace("name", r"\.[^./]+$", "")
    return kept.select(*(c for c in kept.columns if c not in ("_c", "data")), title.alias("title"), "_c.text", "_c.rows")


def markdown_blocks(texts: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """key, block, level (null for paragraphs), text, depth_path: blank lines and headings (# or one <hN> element) end a paragraph.

    A heading that equals the title clears the path. Blocks are numbered by windows over the lines of one text.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("at")
    line = F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))
    x = texts.where(F.col(text).isNotNull()).select(key, title, F.posexplode(F.split(text, "\r\n|\n|\r", -1)).alias("at", "line")).withColumn("line", line)
    marks, tag = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1), F.regexp_extract("line", r"(?i)^<h([1-6])[^>]*>.*</h[1-6]>$", 1)
    level = F.when(marks != "", F.length(marks)).when(tag != "", tag.cast("int"))
    words_ = F.when(marks != "", F.regexp_replace("line", r"^#{1,6}\s+|\s+#+$", "")).when(tag != "", F.trim(F.regexp_replace("line", "<[^<>]+>", ""))).otherwise(F.col("line"))
    x = x.withColumn("level", level).withColumn("line", words_)
    starts = (F.col("level").isNotNull() | (F.col("line") == "") | F.lag("level").over(order).isNotNull()).cast("int")
    x = x.withColumn("run", F.sum(starts).over(order)).where("line <> ''")
    b = x.groupBy(key, title, "run").agg(F.max("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), " ").alias("text"))
    runs = Window.partitionBy(key).orderBy("run")
    is_title = F.col("level").isNotNull() & (F.lower("text") == F.lower(F.col(title)))
    b = b.withColumn("part", F.coalesce(F.sum(is_title.cast("int")).over(runs), F.lit(0))).withColumn("depth", F.when(~is_title, F.col("level")))
    inside = Window.partitionBy(key, "part").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    heads = [F.last(F.when(F.col("depth") == n, F.struct("run", "text")), ignorenulls=True).over(inside) for n in range(1, 7)]
    above = [F.last(F.when(F.col("depth") < n, F.col("run")), ignorenulls=True).over(inside) for n in range(1, 7)]
    for n in range(1, 7):
        later = F.coalesce(above[n - 1], F.lit(-1))
        b = b.withColumn(f"_{n}", F.when(heads[n - 1]["run"] > later, heads[n - 1]["text"]))
    path = F.array_compact(F.array(F.col(title), *(F.col(f"_{n}") for n in range(1, 7))))
    return b.select(key, F.row_number().over(runs).cast("long").alias("block"), F.col("level").cast("long").alias("level"), "text", path.alias("path"))


def gate_reasons(name: Column, text: Column, warnings: Column, tables: Column, profile: Column) -> Column:
    """Why another reader should try: all that hold, in this order."""
    signs = F.lower(F.concat_ws(" ", name, warnings))
    layout = signs.rlike("|".join(LAYOUT_SIGNS))
    reasons = [
        ("high_quality_profile", profile == "high_quality"), ("empty_text", F.trim(F.coalesce(text, F.lit(""))) == ""), ("replacement_character_ratio", replacement_ratio(text) > 0.01),
        ("scanned_or_low_text_pdf", (extension(name) == ".pdf") & (F.size(words(text)) < 30)), ("expected_tables_missing", signs.contains("table") & (tables == 0)), ("complex_layout_signal", layout),
    ]
    return F.array_compact(F.array(*(F.when(test, code) for code, test in reasons)))
