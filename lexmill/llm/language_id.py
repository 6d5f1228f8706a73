"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_columns, with_row

#: Families of languages that are easily confused. A language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
}
UNDETERMINED = "und"
_SCALE = 1000.0
_lut: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points in lower case; 0 for what is no letter."""
    if not _lut:
        _lut.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x10000)], dtype=np.uint32))
    high = codes >= 0x10000
    out = _lut[0][np.where(high, 0, codes)]
    for c in np.unique(codes[high]):
        if c < 0x110000 and chr(c).isalpha():
            out[codes == c] = ord(chr(c).lower()[0])
    return out


def ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter bigrams and trigrams of several texts with their texts' indexes, and how many letters each text has."""
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    c = _letters(codes)
    letters = np.bincount(doc[c > 0], minlength=len(texts))
    keep = np.r_[True, (c[1:] > 0) | (c[:-1] > 0)] if len(c) else np.empty(0, bool)  # a run of other characters counts once
    c, doc = c[keep], doc[keep]
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    grams = np.concatenate([two[doc[:-1] == doc[1:]], three[doc[:-2] == doc[2:]]])
    owner = np.concatenate([doc[:-1][doc[:-1] == doc[1:]], doc[:-2][doc[:-2] == doc[2:]]])
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    grams ^= grams >> np.uint32(13)
    return (grams % np.uint32(buckets)).astype(np.int64), owner, letters


def _parts(texts: pa.Array, most: int = 1 << 20):
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def _features(buckets: int):
    @F.arrow_udf("array<float>")
    def features(texts: pa.Array) -> pa.Array:
        rows = []
        for part in _parts(texts, 1 << 18):
            grams, owner, _ = ngrams(part, buckets)
            n = np.maximum(np.bincount(owner, minlength=len(part)), 1)
            rows.append(np.bincount(owner * buckets + grams, minlength=len(part) * buckets).reshape(len(part), buckets) * (_SCALE / n)[:, None])
        flat = np.concatenate(rows).astype(np.float32) if rows else np.empty((0, buckets), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * buckets), pa.array(flat.ravel()))

    return features


def held_out() -> Column:
    """True for the documents that no model learns from; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, rows: int, most_languages: int) -> tuple[DataFrame, list[str]]:
    """At most ``rows`` labelled rows, the same number of each language, by the hash of doc_id; and the languages in order."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = known.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages among the labels")
    if not counts:
        return known.limit(0).select("lang", "text"), []
    per = max(1, rows // len(counts))
    bound = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * per / r["count"])) for r in counts], "lang string, share double")
    pick = known.select("lang", "doc_id", "text", F.xxhash64("doc_id", F.lit("sample")).alias("h")).join(F.broadcast(bound), "lang")
    pick = pick.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    pick = pick.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per).select("lang", "text")
    return pick, sorted(r["lang"] for r in counts)


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear SVM (squared hinge loss) for signs y, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    scale = np.linalg.norm(x[:, :-1], axis=1).mean() or 1.0
    x[:, :-1] /= scale
    w, alpha, diagonal = np.zeros(x.shape[1]), np.zeros(len(x)), 0.5 / cost
    norms, rng = np.einsum("ij,ij->i", x, x) + diagonal, np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w[:-1] / scale, float(w[-1])


def _trained(rows: pd.DataFrame) -> pd.DataFrame:
    """One machine from the rows of two values."""
    rows = rows.sort_values(["lang", "text_hash"], kind="stable")  # the same machine whatever order the rows come in
    weights, intercept = train_machine(np.stack(rows["features"].to_numpy()), np.where(rows["first"], 1.0, -1.0))
    return pd.DataFrame({"place": rows["place"].iloc[:1], "a": rows["a"].iloc[:1], "b": rows["b"].iloc[:1], "weights": [weights], "intercept": [intercept]})


def fit(docs: DataFrame, families: dict[str, str] | None = None, sample_rows: int = 3000, most_languages: int = 1024, buckets: int = 2048) -> dict:
    """A model from documents(doc_id, text, lang) that are not held out.

    It learns from a bounded sample: at most ``sample_rows`` rows in all, shared evenly by the languages (one at least of each). More
    than ``most_languages`` of them are an error: such labels are no languages. No labelled row: a model without languages, which calls everything ``und``.

    Every machine is trained in a task of its own, from the sampled rows of its two values.
    """
    families = FAMILIES if families is None else families
    spark = docs.sparkSession
    sample, languages = _sample(docs, sample_rows, most_languages)
    model = {"buckets": buckets, "families": {}, "between": [], "within": {}}
    for lang in languages:
        model["families"].setdefault(families.get(lang, lang), []).append(lang)
    if len(languages) < 2:
        return model
    # place: "" between families, else the family
    machines = [("", a, b) for a, b in combinations(sorted(model["families"]), 2)]
    machines += [(f"f{name}", a, b) for name, members in model["families"].items() for a, b in combinations(members, 2)]
    roles = []
    for place, a, b in machines:
        for value, first in ((a, True), (b, False)):
            roles += [(lang, place, a, b, first) for lang in ([value] if place else model["families"][value])]
    roles = spark.createDataFrame(roles, "lang string, place string, a string, b string, first boolean")
    train = sample.select("lang", F.xxhash64("text").alias("text_hash"), _features(buckets)("text").alias("features"))
    rows = materialize(train, "language-sample").join(F.broadcast(roles), "lang")
    found = rows.groupBy("place", "a", "b").applyInPandas(_trained, "place string, a string, b string, weights array<double>, intercept double").collect()
    of = {(r["place"], r["a"], r["b"]): (r["a"], r["b"], np.array(r["weights"], dtype=np.float32) * _SCALE, r["intercept"]) for r in found}
    model["between"] = [of[m] for m in machines if not m[0] and m in of]
    for name in model["families"]:
        model["within"][name] = [of[m] for m in machines if m[0] == f"f{name}" and m in of]
    return model


def _decide(values: list[str], pairs: list, scores: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the value with most votes (then the largest sum of confidences) for each of n texts, and its mean confidence."""
    votes, sure = np.zeros((n, len(values))), np.zeros((n, len(values)))
    for a, b, *_ in pairs:
        p = 1 / (1 + np.exp(-np.clip(2 * scores[a, b], -60, 60)))
        i, j = values.index(a), values.index(b)
        votes[:, i] += p >= 0.5
        votes[:, j] += p < 0.5
        sure[:, i] += p
        sure[:, j] += 1 - p
    best = np.argmax(votes * 1e3 + sure, axis=1)
    return best, sure[np.arange(n), best] / (len(values) - 1) if len(values) > 1 else np.ones(n)


def predictor(model: dict):
    """A column function text -> struct<lang_pred, score>. Null or letterless: ``und`` and 0. Whole texts, whatever their length."""
    buckets, names = model["buckets"], sorted(model["families"])
    machines = [*model["between"], *(m for pairs in model["within"].values() for m in pairs)]

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, owner, letters = ngrams(texts, buckets)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        scores = {(a, b): np.bincount(owner, weights=w[grams], minlength=len(texts)) / n + c for a, b, w, c in machines}
        lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        if names:
            family, sure = _decide(names, model["between"], scores, len(texts))
            for k, name in enumerate(names):
                members = model["families"][name]
                best, inner = _decide(members, model["within"].get(name, []), scores, len(texts))
                own = (family == k) & (letters > 0)
                lang[own] = np.array(members, dtype=object)[best[own]]
                score[own] = (sure * inner)[own]
        return lang.tolist(), score

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        judged = [judge(part) for part in _parts(texts)]
        lang = pa.array([x for names, _ in judged for x in names], pa.string())
        score = pa.array(np.concatenate([s for _, s in judged]) if judged else np.empty(0), pa.float64())
        return pa.StructArray.from_arrays([lang, score], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score: one row per document, repeated rows included.

    lang, source and doc_id never enter a prediction; they only choose and label the rows learned from.
    """
    predict = predictor(fit(docs.select("doc_id", "text", "lang"), **options))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least_score: float = 0.0, **options) -> DataFrame:
    """docs without those that the model rejects: ``und``, or a score below ``least_score``. Columns as they come."""
    predict = predictor(fit(docs.select("doc_id", "text", "lang"), **options))
    judged = with_row(docs, predict("text").alias("p"))
    return judged.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least_score)).select(*row_columns(docs))
