"""Line dedup by a deletion-neighbourhood join.

A line is its words. Two lines are near-equal if at most ``edits`` words inserted, deleted or replaced turn one into the other. Every line
emits the hashes of its variants with up to so many words deleted. Near-equal lines share one: what is left of both when the words that an
edit touches are gone. A variant also says before which of its words something was deleted (its gaps). Of two lines that share a variant the
gaps alone tell how many edits lie between them at most, and for one of the shared variants they tell exactly how many. So lines
meet through the earliest line of each (variant, gaps); the distance is verified on the words, and the earliest line stays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, release, row_columns, slices, texts_of, words_of_docs
from .substrings import keyed

_U = np.uint64
_C = _U(0xD6E8FEB86659FD93)
#: Two primes under 2 ** 31, and what a word's hash is multiplied by for each word before it. Unlike powers of two, primes have no sequences of words
#: that share their sums whatever the words are.
_PRIMES = np.array([[2147483647], [2147483629]], dtype=_U)
_BASES = (1481765933, 1085377743)
_INVERSE = tuple(pow(b, -1, int(p)) for b, p in zip(_BASES, _PRIMES[:, 0]))
#: Variants that a task makes at a time.
_SLICE = 1 << 16


def _powers(n: int, bases: tuple[int, int]) -> np.ndarray:
    """The powers 0 to n of both bases, by doubling."""
    found = np.ones((2, 1), dtype=_U)
    while found.shape[1] <= n:
        step = np.array([[pow(b, found.shape[1], int(p))] for b, p in zip(bases, _PRIMES[:, 0])], dtype=_U)
        found = np.hstack([found, found * step % _PRIMES])
    return found[:, : n + 1]


def _named(sums: np.ndarray, salt) -> np.ndarray:
    return mix(((sums[0] << _U(31)) | sums[1]) * _C + salt)


class Lines:
    """The lines of several texts as word hashes, with prefix sums from which any part's hash follows."""

    def __init__(self, texts: list[bytes]):
        self.lines = [line for text in texts for line in text.split(b"\n")]
        counts = [text.count(b"\n") + 1 for text in texts]
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.at = np.arange(len(self.lines)) - np.repeat(np.cumsum(counts) - counts, counts) if self.lines else np.empty(0, np.int64)
        h, self.owner = words_of_docs(self.lines) if self.lines else (np.empty(0, _U), np.empty(0, np.int64))
        self.n = np.bincount(self.owner, minlength=len(self.lines))
        self.first = np.cumsum(self.n) - self.n
        self.index = np.arange(len(h)) - self.first[self.owner]
        most = int(self.n.max()) if len(self.n) else 0
        self.q = _powers(most + 1, _INVERSE)
        weighed = (h % _PRIMES) * _powers(most + 1, _BASES)[:, self.index] % _PRIMES
        self.sums = np.hstack([np.zeros((2, 1), _U), np.cumsum(weighed, axis=1)])  # of 31 bits each, so that a batch's words don't overflow

    def _moved(self, low: np.ndarray, high: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Sums of words low to high, as if they stood so many words further to the front of their line."""
        return (self.sums[:, high] - self.sums[:, low]) % _PRIMES * self.q[:, back] % _PRIMES

    def part(self, line: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of words low to high of lines, as if the part began a line."""
        f = self.first[line]
        return self._moved(f + low, f + high, low)

    def names(self, which: np.ndarray) -> list[bytes]:
        """128 bits that stand for the words of lines."""
        return [hashlib.blake2b(b" ".join(self.lines[k].split()), digest_size=16).digest() for k in which.tolist()]

    def _keys(self, line: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of parts (which lines, low, high, salt) of lines, each key of a line once."""
        found = [(line[ok], _named(self.part(line[ok], low[ok], high[ok]), salt[ok])) for ok, low, high, salt in parts]
        lines, keys = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((keys, lines))
        lines, keys = lines[order], keys[order]
        fresh = np.r_[True, (lines[1:] != lines[:-1]) | (keys[1:] != keys[:-1])] if len(lines) else np.empty(0, bool)
        return lines[fresh], keys[fresh]

    def pieces(self, edits: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, key): parts of which a near-equal line has one too.

        Of ``edits`` + 1 pieces of a line the edits leave one alone; in the other line it stands at most ``edits`` words further on or back.
        With one edit the first half stands where it stood or the last half as far from the end.
        """
        line = np.flatnonzero(self.n >= least_words)
        n, parts = self.n[line], []
        zero, every = np.zeros_like(n), np.ones(len(n), dtype=bool)
        if edits == 1:
            for low, high, side in ((zero, n // 2, 1), (zero, (n - 1) // 2, 1), (n // 2, n, 2), (n - n // 2, n, 2)):
                parts.append((every, low, high, (high - low).astype(_U) * _U(4) + _U(side)))
            return self._keys(line, parts)
        for own in range(-edits, edits + 1):  # words of the line that is cut, more or fewer
            size = np.maximum(n + own, 0)
            for k in range(edits + 1):
                low, high = size * k // (edits + 1), size * (k + 1) // (edits + 1)
                for shift in range(-edits, edits + 1):
                    a, b = low + shift, high + shift
                    ok = (size > 0) & (a >= 0) & (b <= n)
                    parts.append((ok, np.maximum(a, 0), np.minimum(b, n), (size.astype(_U) * _U(64) + _U(k)) * _U(0xA0761D6478BD642F)))
        return self._keys(line, parts)

    def variants(self, edits: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """(line, gaps, key), some at a time: each line without up to ``edits`` of its words; gaps: for each deleted word how many kept ones stand before it."""
        every = np.arange(len(self.n))
        yield every, [b""] * len(every), _named(self.part(every, np.zeros_like(self.n), self.n), self.n.astype(_U))
        for at in range(0, len(self.owner) if edits else 0, _SLICE):  # one deleted word, for all lines at once
            line, i = self.owner[at : at + _SLICE], self.index[at : at + _SLICE]
            n, f = self.n[line], self.first[line]
            rest = (self.part(line, np.zeros_like(i), i) + self._moved(f + i + 1, f + n, np.ones_like(i))) % _PRIMES
            yield line, [b"%d" % k for k in i.tolist()], _named(rest, (n - 1).astype(_U))
        for count in range(2, edits + 1):
            for k in np.flatnonzero(self.n >= count).tolist():
                n, f = int(self.n[k]), int(self.first[k])
                picks = combinations(range(n), count)
                while chosen := list(islice(picks, _SLICE)):
                    edges = np.hstack([np.full((len(chosen), 1), -1), np.array(chosen), np.full((len(chosen), 1), n)])
                    total = np.zeros((2, len(chosen)), dtype=_U)
                    for j in range(count + 1):  # the part between two deleted words, moved up by the words deleted before
                        total = (total + self._moved(f + edges[:, j] + 1, f + edges[:, j + 1], np.full(len(chosen), j))) % _PRIMES
                    gaps = [b",".join(b"%d" % (g - j) for j, g in enumerate(pick)) for pick in chosen]
                    yield np.full(len(chosen), k), gaps, _named(total, _U(n - count))


def edits_between(a: bytes, b: bytes) -> int:
    """How many edits the gaps of two lines with one variant allow for at most: in each gap, deleted words of both sides are replaced ones."""
    x, y = (Counter(g.split(b",")) if g else Counter() for g in (a, b))
    return sum(max(x[g], y[g]) for g in x | y)


def within_edits(a: list[bytes], b: list[bytes], edits: int) -> bool:
    """Whether at most ``edits`` words inserted, deleted or replaced turn a into b. Rows of the table are cut to the band that matters."""
    if abs(len(a) - len(b)) > edits:
        return False
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    far = edits + 1
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            options = [row.get(j, far) + 1, new.get(j - 1, far) + 1]
            if j:
                options.append(row.get(j - 1, far) + (x != b[j - 1]))
            else:
                options.append(i)
            new[j] = min(options)
        if min(new.values()) > edits:
            return False
        row = new
    return row.get(len(b), far) <= edits


def _line_rows(edits: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines = Lines(texts_of(part))
                keep = np.flatnonzero(lines.n > 0)
                owner, key = lines.pieces(edits, least_words)
                pieces = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(lines.n)))].astype(np.int32), pa.array(key.view(np.int64)))
                take = pa.array(lines.text[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lines.names(keep), pa.binary()), part.column("id").take(take), part.column("tie").take(take),
                        pa.array(lines.at[keep].astype(np.int32)), pieces.take(pa.array(keep)),
                    ],
                    ["line", "id", "tie", "at", "pieces"],
                )

    return run


def _pick_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each text, their words joined by one space."""
    for batch in batches:
        for part in slices(batch):
            rows = []
            for text, i, tie, wanted in zip(texts_of(part), part.column("id").to_pylist(), part.column("tie").to_pylist(), part.column("wanted").to_pylist()):
                lines = text.split(b"\n")
                rows += [(w["line"], i, tie, w["at"], b" ".join(lines[w["at"]].split())) for w in wanted]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, ["line", "id", "tie", "at", "text"])


def _exact_variants(texts: list[bytes], edits: int) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """As ``Lines.variants``, named by 128 bits of the words that are left."""
    for k, text in enumerate(texts):
        words = text.split()
        for count in range(min(edits, len(words)) + 1):
            picks = combinations(range(len(words)), count)
            while chosen := list(islice(picks, _SLICE)):
                left = [b" ".join(w for i, w in enumerate(words) if i not in pick) for pick in chosen]
                gaps = [b",".join(b"%d" % (g - j) for j, g in enumerate(pick)) for pick in chosen]
                yield np.full(len(chosen), k), gaps, [hashlib.blake2b(b"%d:" % (len(words) - count) + x, digest_size=16).digest() for x in left]


def _variant_rows(edits: int, bits: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                for owner, gaps, key in _exact_variants(texts, edits) if exact else Lines(texts).variants(edits):
                    take = pa.array(owner)
                    names = pa.array(key, pa.binary()) if exact else pa.array((key >> _U(64 - bits)).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(gaps, pa.binary()), *(part.column(c).take(take) for c in ("line", "id", "tie", "at"))],
                        ["key", "gaps", "line", "id", "tie", "at"],
                    )

    return run


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                ok = [within_edits(a.split(), b.split(), edits) for a, b in zip(texts_of(part, "text_a"), texts_of(part, "text_b"))]
                yield part.select(["line", "first"]).append_column("ok", pa.array(ok, pa.bool_()))

    return run


def _close(edits: int):
    @F.udf("boolean", useArrow=True)
    def close(a: bytes, b: bytes) -> bool:
        return edits_between(bytes(a), bytes(b)) <= edits

    return close


def _met(variants: DataFrame, edits: int) -> DataFrame:
    """(line, first): each line with the earliest lines of the (variant, gaps) that it is near, where they are earlier."""
    place = F.struct("id", "tie", "at")
    groups = variants.groupBy("key", "gaps").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    if edits == 1:  # near is: the same word missing at the same place, or a word missing on one side alone
        replaced = variants.where(F.length("gaps") > 0).join(groups.where(F.col("first") != F.col("last")), ["key", "gaps"]).where(place > F.col("first")).select("line", "first")
        whole = variants.where(F.length("gaps") == 0).select("key", F.col("line").alias("other"), place.alias("there"))
        inserted = variants.where(F.length("gaps") > 0).join(whole, "key").select("line", "other", place.alias("here"), "there")
        behind = F.col("here") > F.col("there")
        inserted = inserted.select(F.when(behind, F.col("line")).otherwise(F.col("other")).alias("line"), F.when(behind, F.col("there")).otherwise(F.col("here")).alias("first"))
        return replaced.unionByName(inserted).distinct()
    # groups meet by variant: a variant has no more of them than ways to delete words from its line
    other = groups.select("key", F.col("gaps").alias("other"), F.col("first").alias("there"))
    near = groups.select("key", "gaps", "last").join(other, "key").where(F.col("there") < F.col("last")).where(_close(edits)("gaps", "other"))
    near = near.select("key", "gaps", "there").distinct()
    return variants.join(near, ["key", "gaps"]).where(place > F.col("there")).select("line", F.col("there").alias("first")).distinct()


def _variants(picked: DataFrame, edits: int, bits: int, exact: bool = False) -> DataFrame:
    return picked.mapInArrow(_variant_rows(edits, bits, exact), f"key {'binary' if exact else 'long'}, gaps binary, line binary, id long, tie long, at int")


def _compared(picked: DataFrame, edits: int, bits: int, exact: bool = False) -> DataFrame:
    """picked(line, id, tie, at, text) -> line, first, ok: lines that met by a variant, and whether their words are near."""
    pairs = _met(_variants(picked, edits, bits, exact), edits)
    text = picked.select("line", F.struct("id", "tie", "at").alias("first"), "text")
    pairs = pairs.join(text.select("line", F.col("text").alias("text_a")), "line").join(text.select("first", F.col("text").alias("text_b")), "first")
    return pairs.select("line", "first", "text_a", "text_b").mapInArrow(_verified(edits), "line binary, first struct<id: long, tie: long, at: int>, ok boolean")


def removed_lines(d: DataFrame, edits: int, least_words: int, bits: int = 62) -> DataFrame:
    """keyed documents -> id, tie, removed (0-based line numbers, ascending), for those that lose a line."""
    rows = d.select("text", "id", "tie").mapInArrow(_line_rows(edits, least_words), "line binary, id long, tie long, at int, pieces array<long>")
    place = F.struct("id", "tie", "at")
    lines = materialize(rows.groupBy("line").agg(F.min(place).alias("first"), F.any_value("pieces").alias("pieces")), "lines")

    pieces = lines.select(F.explode("pieces").alias("key"), "line")
    crowded = pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = lines.join(pieces.join(crowded, "key").select("line").distinct(), "line").select("line", "first.*")
    wanted = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("line", "at")).alias("wanted"))
    picked = d.join(wanted, ["id", "tie"]).select("text", "id", "tie", "wanted").mapInArrow(_pick_rows, "line binary, id long, tie long, at int, text string")
    picked = materialize(picked.dropDuplicates(["line"]), "picked")

    met = compared = materialize(_compared(picked, edits, bits), "compared")
    wrong = met.where("not ok").select("line").distinct()
    if not wrong.isEmpty():  # two variants shared a name, and one may have hidden another: all lines that share a name with such a line, by exact names
        variants = _variants(picked, edits, bits)
        keys = variants.join(wrong, "line", "left_semi").select("key").distinct()
        others = variants.join(keys, "key", "left_semi").select("line").distinct()
        compared = compared.unionByName(_compared(picked.join(others, "line", "left_semi"), edits, bits, exact=True))
    partner = compared.where("ok").groupBy("line").agg(F.min("first").alias("partner"))

    bounds = lines.select("line", "first").join(partner, "line", "left").select("line", F.least("first", F.coalesce("partner", "first")).alias("bound"))
    judged = rows.select("line", "id", "tie", "at").join(bounds, "line").where(place > F.col("bound"))
    gone = materialize(judged.groupBy("id", "tie").agg(F.sort_array(F.collect_set("at")).alias("removed")), "removed")
    release(lines, picked, met)
    return gone


def line_decisions(docs: DataFrame, edits: int = 1, least_words: int = 5, bits: int = 62) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_lines, n_removed, removed (0-based line numbers, ascending): one row per document.

    A line (between line feeds; its words) is removed if an equal or near-equal line stands earlier: in a smaller doc_id (null first),
    or higher up in the same document; of rows with one doc_id and different texts, a fixed one counts as earlier. Judged on the input, not on
    what is left. Near-equal are lines at most ``edits`` words apart that both have ``least_words`` words: the similarity asked for, since in a
    line of four words one is a quarter of it. Lines without words stay and equal no other. Equal rows are one document. Null text: one empty line.

    Equal lines (by 128 bits of their words) fold into one row first. Only lines with a piece that another line has emit their variants;
    near-equal lines share a piece. A bucket of n lines gives n pairs for each of its gaps, each with the earliest line there: all
    lines of one variant and one gap are as far apart. So nothing is lost and no group meets in one task. Variants have names of ``bits`` bits;
    where words show that two of them shared one, the lines concerned are done again by 128-bit names.
    """
    d = keyed(docs)
    n_lines = (F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1).cast("long")
    slim = d.select("doc_id", "id", "tie", n_lines.alias("n_lines"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    rows = slim.join(removed_lines(d, edits, least_words, bits), ["id", "tie"], "left")
    return rows.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))


def dedup_lines(docs: DataFrame, edits: int = 1, least_words: int = 5) -> DataFrame:
    """docs with the removed lines taken out of text. Columns as they come; documents of which nothing is left stay, with empty text."""
    d = keyed(docs, rows=True)
    d = d.join(removed_lines(d.select("doc_id", "text", "id", "tie"), edits, least_words), ["id", "tie"], "left")
    left = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains(F.col("removed"), k))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return d.select(*row_columns(docs, text=text.alias("text")))
