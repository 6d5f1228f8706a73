"""Fill-in-middle: documents cut in three and rearranged around sentinels, so that a left-to-right model learns to fill a gap. DataFrame functions only.

``regexp_extract_all`` gives a text's units, ``conv`` of parts of a SHA-256 the cuts and the form, ``slice`` and ``array_join`` the three parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_columns, with_row

#: A word with the white space before it, or the white space at the end: every character is in exactly one unit.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hexadecimal SHA-256 of ``seed:doc_id``. A null doc_id counts as the word ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _pattern(sentinels: tuple[str, str, str]) -> str:
    return "|".join("\\Q" + s + "\\E" for s in sentinels)


def arranged(
    docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """docs(doc_id, text, ...) -> row (docs' columns as a struct), n, form, prefix, middle, suffix, output: one row per document.

    ``rate`` per cent of the documents are cut, of these ``suffix_first`` per cent get the form ``spm`` (suffix, prefix, middle), the others ``psm``; all
    others, and texts that are empty or hold a sentinel, stay ``plain``: their parts are null and their output is the text. Cuts lie between units, two equal ones
    give an empty middle. Everything hangs on seed, doc_id and text: reruns and any layout agree, rows with one doc_id and text are alike.
    Null text: as an empty one. No shuffle.
    """
    h = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    units = with_row(docs, text.alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"))
    n = F.size("units")
    a, b = (F.pmod(F.col(f"h{k}"), (n + 1).cast("long")).cast("int") for k in (1, 2))
    held = [F.contains("text", F.lit(s)) for s in sentinels]
    plain = (F.length("text") == 0) | held[0] | held[1] | held[2] | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cut = units.select("row", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    part = lambda first, count: F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, count), ""))
    parts = cut.select(
        "row", "text", "n", "form",
        part(F.lit(1), F.col("low")).alias("prefix"),
        part(F.col("low") + 1, F.col("high") - F.col("low")).alias("middle"),
        part(F.col("high") + 1, F.greatest(F.col("n").cast("int") - F.col("high"), F.lit(0))).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(F.col("form") == "plain", F.col("text"))
    output = output.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return parts.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from, parsed from its sentinels alone. A cut text holds none of them, so that exactly three are found."""
    parts = F.split(output, _pattern(sentinels), -1)  # the first is empty
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: one row per document, repeated rows included. Empty table: no rows."""
    out = arranged(docs.select("doc_id", "text"), **options)
    back = restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    return out.select(
        "row.doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def infill(docs: DataFrame, **options) -> DataFrame:
    """docs with every text rearranged, columns as they come, whatever their names. A null text stays null."""
    out = arranged(docs, **options)
    return out.select(*row_columns(docs, text=F.when(F.col("row.text").isNotNull(), F.col("output")).alias("text")))
