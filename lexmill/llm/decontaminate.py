"""Benchmark decontamination by spaced seeds.

Fixed masks read some positions of a window of words and ignore the others, so that a hash survives substitutions at the ignored
positions. Training and test hashes are joined; around each hit the whole item is laid over the document and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, row_columns, slices, text_key, texts_of, with_row, word_hashes

#: Which words of a window a seed reads (1) and ignores (0). The nine of 10 words let any two substitutions through, each pair by one of
#: them at least. Whatever has at most 20 % substituted has such a window, but for 15 to 17 words with three in the middle: the last mask.
MASKS = (
    "1111000101", "0001111101", "1110111000", "1101101010", "1010001111", "0111011010", "1011110010", "1100010111", "0110100111",
    "111110000011111",
)
_U = np.uint64
#: Bits of the filter that is sent to every task, whatever the size of the test set.
_BITS = 25


def normalized_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case without outer punctuation, and each word's text."""
    lowered = [t.decode("utf-8", "replace").lower().encode() if not t.isascii() else t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    h, start, _ = word_hashes(b" ".join(lowered).translate(_PLAIN))
    return h, np.searchsorted(ends, start, side="right")


#: ASCII punctuation counts as white space.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def seeds(h: np.ndarray, doc: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and their first words, for windows inside one text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    out = np.full(n, salt, dtype=_U)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += h[j : j + n] * _U((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1))
    inside = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :][:n])
    return mix(out[inside]), inside


def seed_runs(x: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of one seed at places in a row in one text: a word repeated a thousand times is one row."""
    new = np.r_[True, (x[1:] != x[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])] if len(x) else np.empty(0, bool)
    head = np.flatnonzero(new)
    return head, np.diff(np.r_[head, len(x)])


def _masks(short: list[int]) -> list[str]:
    """The spaced seeds, and masks for each length of items that are shorter than a seed: a full window for lengths under 5, else three
    that ignore a third each, so that one substitution anywhere passes one of them."""
    thirds = [["".join("0" if 3 * j // n == k else "1" for j in range(n)) for k in range(3)] if n >= 5 else ["1" * n] for n in short]
    return [*MASKS, *(mask for masks in thirds for mask in masks)]


def _item_seeds(masks: list[str], lengths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, item = normalized_words(texts_of(batch))
            size = np.bincount(item, minlength=batch.num_rows)
            if lengths:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(size[size > 0]))], ["n"])
                continue
            first = np.cumsum(size) - size
            for k, mask in enumerate(masks):
                x, at = seeds(h, item, mask, k)
                if k >= len(MASKS):  # a short item is one window, by its own masks; longer items have spaced seeds
                    own = size[item[at]] == len(mask)
                    x, at = x[own], at[own]
                head, count = seed_runs(x, at, item[at])
                x, at = x[head], at[head]
                node, place = batch.column("item").take(pa.array(item[at])), (at - first[item[at]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), node, pa.array(place), pa.array(place + count - 1)], ["h", "item", "item_at", "item_last"])

    return run


def _doc_hits(masks: list[str], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for part in slices(batch):
                h, doc = normalized_words(texts_of(part))
                first = np.searchsorted(doc, np.arange(part.num_rows))
                for k, mask in enumerate(masks):
                    x, at = seeds(h, doc, mask, k)
                    low = x & _U((1 << _BITS) - 1)
                    found = np.flatnonzero((filled[(low >> _U(3)).astype(np.int64)] >> (low & _U(7)).astype(np.uint8)) & 1)
                    x, at = x[found], at[found]
                    if len(x):
                        head, count = seed_runs(x, at, doc[at])
                        x, rows = x[head], doc[at[head]]
                        place = (at[head] - first[rows]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x.view(np.int64)), part.column("doc_id").take(pa.array(rows)), part.column("node").take(pa.array(rows)), pa.array(place), pa.array(place + count - 1)],
                            ["h", "doc_id", "node", "at", "last"],
                        )

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """2^25 bits, one set for each hash: at most 4 MB, filled from at most 2^19 words that Spark has or-ed together."""
    words = hashes.select(F.pmod("h", F.lit(1 << _BITS)).alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (_BITS - 6), dtype=np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.tobytes()


def _overlaps(least_words: int, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for piece in slices(part, "item_text"):
                    yield _compare(piece, least_words, least_share)

    return run


def _gains(same: np.ndarray, least_share: float) -> np.ndarray:
    """Sums, before and after each word, of what agreements gain: least_share of agreements are worth exactly nothing."""
    share = Fraction(str(least_share))
    return np.r_[0, np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))]


def longest_stretch(same: np.ndarray, least_share: float) -> tuple[int, int]:
    """Start and end of the longest stretch that starts and ends with an agreement and has least_share of them; (0, 0) if none."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0
    total = _gains(same, least_share)
    lowest = np.minimum.accumulate(total[hits])
    first = hits[np.searchsorted(-lowest, -total[hits + 1])]  # the earliest start whose sum is no higher than at the end
    k = int(np.argmax(hits + 1 - first))
    return int(first[k]), int(hits[k]) + 1


def _compare(rows: pa.RecordBatch, least_words: int, least_share: float) -> pa.RecordBatch:
    d, doc = normalized_words(texts_of(rows))
    i, item = normalized_words(texts_of(rows, "item_text"))
    d0, i0 = np.searchsorted(doc, np.arange(rows.num_rows)), np.searchsorted(item, np.arange(rows.num_rows))
    dn, n = np.bincount(doc, minlength=rows.num_rows), np.bincount(item, minlength=rows.num_rows)
    out = []
    for r, shifts in enumerate(rows.column("shifts").to_pylist()):
        best = (0, 0, 0)
        for shift in sorted({k for s in shifts for k in range(s["low"], s["high"] + 1)}):
            low, high = max(0, -shift), min(n[r], dn[r] - shift)
            same = i[i0[r] + low : i0[r] + high] == d[d0[r] + low + shift : d0[r] + high + shift]
            if n[r] < least_words:
                start, end = (0, high - low) if high - low == n[r] and _gains(same, least_share)[-1] >= 0 else (0, 0)
            else:
                start, end = longest_stretch(same, least_share)
            if (end - start, shift) > best[:2] and end - start >= min(least_words, n[r]):
                best = (end - start, shift, int(same[start:end].sum()), low + start)
        out.append(best if best[0] else None)
    ok = np.array([x is not None for x in out], dtype=bool)
    kept = rows.select(["doc_id", "node", "item"]).filter(pa.array(ok))
    hits = [x for x in out if x is not None]
    return pa.RecordBatch.from_arrays(
        [*kept.columns, pa.array([x[3] + x[1] for x in hits], pa.int64()), pa.array([x[0] for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.int64()), pa.array(n[ok].astype(np.int64))],
        ["doc_id", "node", "item", "doc_at", "overlap_words", "same_words", "item_words"],
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, least_share: float = 0.8) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row per contaminated document, text and distinct item text:
    doc_id, node (the document's text key), item (the item's text key), doc_at (first word of the overlap), overlap_words,
    same_words, item_words.

    Contaminated: without gaps, a stretch of at least ``least_words`` words of an item (a shorter item whole) stands in the
    document with at least ``least_share`` of its words the same. A stretch of a longer item starts and ends with equal words. Words: in lower case, ASCII punctuation as white space. Items
    without words, null and empty texts never match. Equal items are one, and so are rows of one doc_id and text.

    Seeds read 6 of 10 words or 10 of 15; items under 10 words have masks of their own length. For a least_share of 0.8 or more
    they miss nothing that the rule above names.
    """
    spark = docs.sparkSession
    items = materialize(benchmark.where("text is not null").groupBy(text_key().alias("item")).agg(F.any_value("text").alias("text")), "items")
    lengths = items.mapInArrow(_item_seeds([], True), "n long").where(F.col("n") < len(MASKS[0])).distinct()
    masks = _masks(sorted(r["n"] for r in lengths.collect()))
    tests = materialize(items.mapInArrow(_item_seeds(masks, False), "h long, item binary, item_at long, item_last long"), "seeds")
    bits = spark.sparkContext.broadcast(_bitmap(tests))
    keyed = docs.select("doc_id", "text", text_key().alias("node"))
    hits = keyed.where("text is not null").mapInArrow(_doc_hits(masks, bits), "h long, doc_id long, node binary, at long, last long")
    shifts = F.struct((F.col("at") - F.col("item_last")).alias("low"), (F.col("last") - F.col("item_at")).alias("high"))
    met = hits.join(tests, "h").select("doc_id", "node", "item", shifts.alias("shifts"))
    met = materialize(met.groupBy("doc_id", "node", "item").agg(F.collect_set("shifts").alias("shifts")), "hits")
    # texts of documents that were hit, each text once
    first = met.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("doc_id"))
    source = keyed.join(first, (keyed.node == first.node) & keyed.doc_id.eqNullSafe(first.doc_id), "left_semi")
    source = source.groupBy("node").agg(F.any_value("text").alias("text"))
    pairs = met.groupBy("node", "item").agg(F.any_value("shifts").alias("shifts"), F.lit(None).cast("long").alias("doc_id"))
    pairs = pairs.join(source, "node").join(items.withColumnRenamed("text", "item_text"), "item")
    judged = pairs.mapInArrow(
        _overlaps(least_words, least_share),
        "doc_id long, node binary, item binary, doc_at long, overlap_words long, same_words long, item_words long",
    ).drop("doc_id")
    return met.select("doc_id", "node", "item").join(judged, ["node", "item"]).select("doc_id", *judged.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document and benchmark item: doc_id, item_id, doc_at, overlap_words, same_words, item_words."""
    found = overlaps(docs, benchmark, **options)
    ids = benchmark.where("text is not null").select(text_key().alias("item"), "item_id").distinct()
    return found.join(ids, "item").select("doc_id", "item_id", "doc_at", "overlap_words", "same_words", "item_words").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones. Columns as they come, whatever their names."""
    nodes = overlaps(docs, benchmark, **options).select("node").distinct()
    return with_row(docs, text_key().alias("node")).join(nodes, "node", "left_anti").select(*row_columns(docs))
