"""Spelling variants by anagram hashing: words of nearly the same letters share an integer key, then the order of the letters decides.

A word's key is the sum of a power of each letter. Two words are one letter apart where their keys differ by one letter's value (added, removed) or by the
difference of two (exchanged). Each word gives its key less each of its letters, and its own: equal numbers are such pairs. Beside the key stands the half
of the word that the edit did not touch, since one half always stays as it is: this keeps words of the same few letters apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Runs of letters; only A to Z are lower-cased. Fixed values.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sums stay below it, so that words of any length have keys.
_MODULUS = (1 << 61) - 1
POWER = 5


def words(docs: DataFrame, least_length: int = 6, noise: int = 199) -> DataFrame:
    """docs(doc_id, text, ...) -> word, one row an occurrence, of at least ``least_length`` code points.

    Where ``noise`` divides the CRC-32 of ``doc_id:run``, the run loses one letter (noise 0: none does). A null doc_id counts as the word ``null``.
    """
    run = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = run.where(F.length("run") >= least_length).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if not noise:
        return run.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    return run.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length)


def counted(docs: DataFrame, least_count: int = 5, **options) -> DataFrame:
    """word, n: words of at least ``least_count`` occurrences, counted before and after the exchange."""
    return words(docs, **options).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_value(letter: Column, power: int = POWER) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(power))).cast("long")  # exact: below 2 ** 53


def anagram_key(letters: Column, power: int = POWER) -> Column:
    """The sum of the values of an array of letters; equal for anagrams."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, x: (total + letter_value(x, power)) % _MODULUS)


def _keys(vocabulary: DataFrame) -> DataFrame:
    """word, n, full, key, common, side, half, whole: the keys under which a word meets its near words.

    full is the word's own key; common is the length of what two such words share. whole: the key is full, for words with one letter more; else
    it is full less a letter outside the half that is kept. Equal letters on one side give one row.
    """
    w = vocabulary.select("word", "n", F.split("word", "").alias("letters"))
    w = w.select("word", "n", "letters", F.size("letters").alias("length"), anagram_key(F.col("letters")).alias("full"))

    def kept(common: Column, side: str) -> Column:
        """The first half of the common part, or the rest at the end."""
        half = F.floor(common / 2).cast("int")
        return F.xxhash64(F.substring("word", F.lit(1), half) if side == "p" else F.substring("word", F.col("length") - common + half + 1, common - half))

    def row(key: Column, common: Column, side: str, whole: bool) -> Column:
        return F.struct(key.alias("key"), common.alias("common"), F.lit(side).alias("side"), kept(common, side).alias("half"), F.lit(whole).alias("whole"))

    less = F.col("length") - 1
    half = F.floor(less / 2).cast("int")
    outside = {"p": F.slice("letters", half + 1, F.col("length") - half), "s": F.slice("letters", F.lit(1), half)}
    own = F.array(*(row(F.col("full"), F.col("length"), side, True) for side in outside))

    def without(side: str) -> Column:
        return F.transform(F.array_distinct(outside[side]), lambda x: row(F.pmod(F.col("full") - letter_value(x), F.lit(_MODULUS)), less, side, False))

    return w.select("word", "n", "full", F.explode(F.concat(own, without("p"), without("s"))).alias("k")).select("word", "n", "full", "k.*")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(word, n), word unique -> a, b, n_a, n_b: each pair that one inserted, deleted or replaced code point parts, once (a before b).

    A pair meets on the side of its first halves where these are equal, else on the other; so none comes twice. Words of equal keys are anagrams and never near.
    """
    keys = materialize(_keys(vocabulary), "anagram-keys")
    a, b = (keys.select(*(F.col(c).alias(f"{c}_{x}") if c not in ("key", "common", "side", "half") else F.col(c) for c in keys.columns)) for x in "ab")
    met = a.join(b, ["key", "common", "side", "half"]).where("word_a < word_b and full_a != full_b and not (whole_a and whole_b)")
    kept = F.floor(F.col("common") / 2).cast("int")
    first = F.substring("word_a", F.lit(1), kept) == F.substring("word_b", F.lit(1), kept)
    near = met.where((F.col("side") == F.when(first, "p").otherwise("s")) & (F.levenshtein("word_a", "word_b", 1) == 1))
    return near.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), F.col("n_a"), F.col("n_b"))


def forms(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """vocabulary(word, n) -> word, n, n_near, form, form_n: form is the near word of largest n (ties: the first by code points), if that is at least
    ``ratio`` times the word's; else null."""
    pairs = materialize(near_pairs(vocabulary), "near-words")
    ways = [F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("near")).alias("x")) for x, y in ("ab", "ba")]
    best = pairs.select(F.inline(F.array(*ways))).groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("best"))
    joined = vocabulary.join(best, "word", "left")
    chosen = -F.col("best.less") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """links(word, form), no form null -> word, root: forms followed to the last, by pointers that double in reach each round.

    A form has ``ratio`` times its word's count, so that chains are short (28 steps at ratio 5 for any 64-bit count) and rounds are at most five.
    """
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(ahead, "root", "left_semi").isEmpty():
            return at
        moved = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        release(at)
        at = moved


def variants(docs: DataFrame, ratio: int = 5, **options) -> DataFrame:
    """docs(doc_id, text, ...) -> word, form, root, n, n_near, form_n: one row a word of the corpus with enough occurrences.

    Every occurrence of every whole text counts, repeated rows too. Null texts have no words; no such words, or an empty table: no rows.
    Counting combines before its exchange; after it everything hangs on the number of different words.
    """
    vocabulary = materialize(counted(docs, **options), "vocabulary")
    found = materialize(forms(vocabulary, ratio), "forms")
    ends = roots(found.where("form is not null").select("word", "form"))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
