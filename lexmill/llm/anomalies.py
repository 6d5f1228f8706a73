"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Each tree splits a small sample of the statistics at random places. Documents that few random splits set apart (short paths, averaged over all
trees) are anomalous; how short is too short is read off the labelled rows. Fixed rules of length and repetition come before it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, row_columns, slices, texts_of, with_row, word_hashes

#: Counts of a document, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks")
#: Bounds of the base rules: words at least, and per cent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
_BINS = 10_000
_U = np.uint64


def _bytes(chars: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(chars)] = True
    return found


_SYMBOL, _MARK, _SPACE = _bytes(b"#*$%&|<>"), _bytes(b"!?.,;:"), _bytes(b"\t\n\x0b\x0c\r ")
_UPPER, _LOWER, _DIGIT = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(b"0123456789")


def statistics(texts: list[bytes]) -> np.ndarray:
    """(text, count) of UTF-8 texts, in the order of ``COUNTS``.

    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in a window of three that the text has twice or more.
    n_lines: lines with a word. Letters are those of ASCII; n_marks are ``!?.,;:``.
    """
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = b" ".join(texts) + b" "
    b = np.frombuffer(data, dtype=np.uint8)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, ends - sizes, dtype=np.int64)

    h, start, _ = word_hashes(data)
    owner = np.searchsorted(ends, start, side="right")
    out[:, 0] = np.bincount(owner, minlength=len(texts))
    out[:, 1] = per_text(((b & 0xC0) != 0x80) & ~_SPACE[b])  # a code point has one byte that continues no other
    for column, kind in ((2, _SYMBOL), (6, _UPPER), (7, _LOWER), (8, _DIGIT), (9, _MARK)):
        out[:, column] = per_text(kind[b])
    for k, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip()]
        out[k, 3], out[k, 5] = len(lines) - len(set(lines)), len(lines)
    if len(h) > 2:
        window = mix(mix(mix(h[:-2]) * _U(0xD6E8FEB86659FD93) ^ h[1:-1]) * _U(0xA0761D6478BD642F) ^ h[2:])
        window = mix(window + owner[2:].astype(_U) * _U(0x9E3779B97F4A7C15))  # windows of different texts differ
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        _, place, count = np.unique(window[inside], return_inverse=True, return_counts=True)
        again, covered = inside[count[place] > 1], np.zeros(len(h), dtype=bool)
        for k in range(3):
            covered[again + k] = True
        out[:, 4] = np.bincount(owner[covered], minlength=len(texts))
    return out


def _counts(texts: pa.Array) -> pa.Array:
    parts = [statistics(texts_of(part)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
    found = np.concatenate([np.empty((0, len(COUNTS)), np.int64), *parts])
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(COUNTS))], list(COUNTS))


def counts(text: str = "text") -> Column:
    """A struct of ``COUNTS`` of a text. Null: zeros."""
    return F.arrow_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))(text)


def features(c: np.ndarray) -> np.ndarray:
    """Statistics between 0 and 1 of counts (columns as in ``COUNTS``), for the forest to split on: length, word length, symbols a word, lines that repeat,
    words in repeated windows, capitals among letters, digits among characters, marks a word."""
    c = c.astype(np.float64)
    words, lines, letters, chars = (np.maximum(n, 1) for n in (c[:, 0], c[:, 5], c[:, 6] + c[:, 7], c[:, 1]))
    parts = (np.log1p(c[:, 0]) / 16, c[:, 1] / words / 20, c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / letters, c[:, 8] / chars, c[:, 9] / words)
    return np.clip(np.stack(parts, axis=1), 0, 1).astype(np.float32)


def base_failed():
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# ---------------------------------------------------------------- the forest


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length to one of n rows in a random binary tree."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random tree over rows x: (feature or -1, split, path) by node; the children of node k are 2k (below the split) and 2k + 1.

    A split falls anywhere in what is left of a statistic's range, not between the least and largest row: where all sampled rows have no symbols,
    a split still parts them from those that have some, and the side without rows ends at once. path: of a leaf, its depth and the mean path that its rows
    would still have.
    """
    rng = np.random.default_rng(seed)
    feature, split, path = np.full(2 << depth, -1, np.int16), np.zeros(2 << depth, np.float32), np.zeros(2 << depth, np.float32)
    todo = [(1, 0, np.arange(len(x)), np.zeros(x.shape[1]), np.ones(x.shape[1]))]
    while todo:
        node, level, rows, low, high = todo.pop()
        if level == depth or len(rows) <= 1:
            path[node] = level + expected_path(len(rows))
            continue
        f = rng.integers(x.shape[1])
        at = np.float32(rng.uniform(low[f], high[f]))
        feature[node], split[node] = f, at
        above = x[rows, f] >= at
        below_high, above_low = high.copy(), low.copy()
        below_high[f] = above_low[f] = at
        todo += [(2 * node, level + 1, rows[~above], low, below_high), (2 * node + 1, level + 1, rows[above], above_low, high)]
    return feature, split, path


def anomaly(x: np.ndarray, forest: list, depth: int, norm: float) -> np.ndarray:
    """2 ** -(mean path / norm): near 1 where a few splits set a row apart, below 0.5 where it takes many."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, path in forest:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + (x[rows, f] >= split[node]), node)
        total += path[node]
    return np.exp2(-total / max(len(forest), 1) / norm)


def _grown(depth: int, seed: int):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows.sort_values(list(COUNTS), kind="stable")[list(COUNTS)].to_numpy(np.int64)  # the same tree whatever order the rows come in
        tree = int(rows["tree"].iloc[0])
        feature, split, path = grow(features(counts), depth, seed * 1_000_003 + tree)
        return pd.DataFrame({"tree": [tree], "n": [len(rows)], "feature": [feature.astype(np.int64)], "split": [split], "path": [path]})

    return one


def fit(good: DataFrame, trees: int = 100, sample: int = 256, depth: int = 12, sample_rows: int = 25_600, seed: int = 11) -> dict:
    """A forest from the counts of good rows (doc_id and ``COUNTS``). It learns from at most ``sample_rows`` of them, the first by a seeded hash; each
    of the ``trees`` takes about ``sample`` of these and is grown in a task of its own. Its size hangs on these parameters alone. No rows: no trees.
    """
    chosen = good.select("doc_id", *COUNTS).orderBy(F.xxhash64(F.lit(seed), "doc_id", *COUNTS), "doc_id", *COUNTS).limit(sample_rows)
    chosen = materialize(chosen, "forest-sample")
    share = int(1_000_000 * min(1.0, sample / max(chosen.count(), 1)))
    dealt = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    dealt = dealt.where(F.pmod(F.xxhash64(F.lit(seed + 1), "tree", "doc_id", *COUNTS), F.lit(1_000_000)) < share)
    grown = dealt.groupBy("tree").applyInPandas(_grown(depth, seed), "tree int, n long, feature array<int>, split array<float>, path array<float>")
    found = sorted(grown.collect(), key=lambda r: r["tree"])
    forest = [(np.array(r["feature"], np.int16), np.array(r["split"], np.float32), np.array(r["path"], np.float32)) for r in found]
    norm = float(expected_path(np.mean([r["n"] for r in found]))) if found else 1.0
    return {"forest": forest, "depth": depth, "norm": max(norm, 1e-9)}


def scorer(model: dict):
    """A column function of the columns ``COUNTS`` -> anomaly score (0 without trees)."""

    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        x = features(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1))
        return pa.array(anomaly(x, model["forest"], model["depth"], model["norm"]) if model["forest"] else np.zeros(len(x)), pa.float64())

    return score


def calibrated(scored: DataFrame, most_good_lost: float) -> float:
    """The score from which on documents go, from all labelled rows (score, quality): of the cuts that lose at most ``most_good_lost`` of the good
    rows, that with the largest share of bad rows caught less good rows lost (of equal ones the highest), moved to the middle of the gap below it.
    One label missing, or no cut better than none: infinity.

    Spark counts the rows into at most 10,000 bins of scores; only these counts come to the driver.
    """
    bins = scored.groupBy(F.floor(F.col("score") * _BINS).alias("bin")).agg(F.expr("count_if(quality > 0) as good"), F.expr("count_if(quality <= 0) as bad"))
    counted = sorted(bins.collect(), key=lambda r: -r["bin"])
    good, bad = (np.array([r[name] for r in counted], dtype=np.int64) for name in ("good", "bad"))
    if not good.sum() or not bad.sum():
        return math.inf
    lost, caught = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    gain = np.where(lost <= most_good_lost, caught - lost, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return math.inf
    below = counted[best + 1]["bin"] + 1 if best + 1 < len(counted) else counted[best]["bin"]
    return (counted[best]["bin"] + below) / 2 / _BINS


def trained(counted: DataFrame, labels: DataFrame, most_good_lost: float = 0.01, **options) -> tuple[dict, float]:
    """(forest, cut) from counted documents (doc_id, ``COUNTS``) and labels(doc_id, quality, ...): the forest learns from good rows that pass the base
    rules, the cut from all labelled rows that pass them. Quality 0 is bad; of several labels of one doc_id the least counts, null ones don't; labels and
    documents without a partner take no part.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = materialize(counted.where(~base_failed()).select("doc_id", *COUNTS).join(label, "doc_id"), "labelled")
    model = fit(known.where("quality > 0"), **options)
    return model, calibrated(known.select("quality", scorer(model)(*COUNTS).alias("score")), most_good_lost)


def _verdict(cut: float):
    return ~base_failed() & (F.col("score") < F.lit(cut))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score: a row per document.

    kept is false where the base rules fail, else the forest's verdict. Null and empty texts have no words and fail. Repeated rows and equal texts get
    equal verdicts. A document's own label is no input of its verdict. Empty labels: only the base rules judge. Empty table: no rows.
    """
    counted = materialize(docs.select("doc_id", counts().alias("c")).select("doc_id", "c.*"), "counts")
    model, cut = trained(counted, labels, **options)
    out = counted.select("*", base_failed().alias("base_failed"), scorer(model)(*COUNTS).alias("score"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", _verdict(cut).alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that the base rules or the forest reject. Columns as they come, whatever their names; only labelled texts are read twice."""
    label = labels.select("doc_id").distinct()
    model, cut = trained(docs.select("doc_id", "text").join(label, "doc_id", "left_semi").select("doc_id", counts().alias("c")).select("doc_id", "c.*"), labels, **options)
    counted = with_row(docs, counts().alias("c")).select("row", "c.*")
    return counted.withColumn("score", scorer(model)(*COUNTS)).where(_verdict(cut)).select(*row_columns(docs))
