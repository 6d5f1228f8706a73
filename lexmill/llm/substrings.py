"""Substring dedup by recompression: words covered by a long word sequence that also starts earlier are removed.

A round of recompression names every maximal run of one symbol (symbol, length), then gives every symbol a side, left or right, by a bit of its
name, and names the pairs of a left symbol and the right symbol behind it. Names are made from what they stand for, so that every
task finds the same one. Equal stretches get equal symbols but near their ends; each symbol carries the words that it depends on, and
any window that holds those words holds the symbol.

A level lets symbols grow to a least number of words and then stand still. Its Spark round names the symbols of the corpus, counts
in how many documents each stands, and sends the shared names back. A symbol of one document alone rules out every window that must
hold it; the next level grows longer symbols where windows are left. Windows left in the end are grouped by name, and every stretch
that is to be removed is compared with its earlier place word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, release, slices, text_key, texts_of, with_row, words_of_docs

_U = np.uint64
_NULL_ID = -(1 << 63)
#: Levels: the least words of a symbol, and rounds.
LEVELS = ((4, 5),)
#: Words in a row that are compared at once, in the coordinates of the earlier place.
BLOCK = 32
#: Names of symbols keep their upper bits; two symbols of one name look shared and only rule out less. Lower bits: 1 in the marks of
#: documents with windows that no symbol of the level covers; marks are spread, so that no key is hot.
_LOW_BITS, _MARKS = 16, 1024


class Symbols:
    """The symbols of several texts: name, text, first word, end, and the words [low, high) that the symbol depends on.

    low and high reach one word beyond the symbol, so that a text's first or last symbol depends on what no window holds.
    """

    def __init__(self, h: np.ndarray, doc: np.ndarray):
        self.words, self.name, self.doc = h, h, doc
        self.start = np.arange(len(h), dtype=np.int64)
        self.end, self.low, self.high = self.start + 1, self.start - 1, self.start + 2
        self.round = 0

    def _take(self, at: np.ndarray) -> None:
        for k in ("name", "doc", "start", "end", "low", "high"):
            setattr(self, k, getattr(self, k)[at])

    def runs(self, least: int) -> None:
        """Names runs of equal symbols under ``least`` words."""
        growing = self.end - self.start < least
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1]) & growing[1:]
        if same.any():
            head = np.flatnonzero(np.r_[True, ~same])
            length = np.diff(np.r_[head, len(same) + 1])
            end, low, high = self.end[head + length - 1], np.minimum.reduceat(self.low, head), np.maximum.reduceat(self.high, head)
            self._take(head)
            self.end, self.low, self.high, growing = end, low, high, growing[head]
            run = np.flatnonzero(length > 1)
            self.name[run] = mix(self.name[run] * _U(0xA0761D6478BD642F) + length[run].astype(_U) * _U(0xE7037ED1A0B428DB))
        # a neighbour differs if the next word does; else its own words must be known
        w = self.words
        behind = np.flatnonzero(growing[:-1] & (w[np.minimum(self.end[:-1], len(w) - 1)] == w[self.start[:-1]]))
        before = np.flatnonzero(growing[1:] & (w[self.start[1:] - 1] == w[self.end[1:] - 1])) + 1
        self._depend(behind, behind + 1, before, before - 1)

    def _depend(self, a: np.ndarray, on_a: np.ndarray, b: np.ndarray, on_b: np.ndarray) -> None:
        """a's and b's symbols depend on what others depend on."""
        low, high = self.low.copy(), self.high.copy()
        for at, on in ((a, on_a), (b, on_b)):
            low[at] = np.minimum(low[at], self.low[on])
            high[at] = np.maximum(high[at], self.high[on])
        self.low, self.high = low, high

    def pairs(self, least: int) -> None:
        """Names pairs of a left and a right symbol, both under ``least`` words."""
        growing = self.end - self.start < least
        right = ((self.name >> _U(self.round % 64)) & _U(1)).astype(bool)
        self.round += 1
        left, right = growing & ~right, growing & right
        pair = left[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        first = np.flatnonzero(pair)
        second = first + 1
        # a left symbol is alone because of the symbol behind it, a right one because of the symbol before
        alone_left = np.flatnonzero(left[:-1] & ~pair)
        alone_right = np.flatnonzero(right[1:] & ~pair) + 1
        self._depend(alone_left, alone_left + 1, alone_right, alone_right - 1)
        self.name = self.name.copy()
        self.name[first] = mix(self.name[first] * _U(0xD6E8FEB86659FD93) + self.name[second] * _U(0x8EBC6AF09C88C6E3))
        self.end = self.end.copy()
        self.end[first] = self.end[second]
        self.low[first] = np.minimum(self.low[first], self.low[second])
        self.high[first] = np.maximum(self.high[first], self.high[second])
        keep = np.ones(len(left), dtype=bool)
        keep[second] = False
        self._take(np.flatnonzero(keep))

    def grow(self, least: int, rounds: int) -> None:
        for _ in range(rounds if len(self.name) else 0):
            self.name = self.name.copy()
            self.runs(least)
            self.pairs(least)


class Windows:
    """Some texts' windows and which of them may repeat in another document."""

    def __init__(self, texts: list[bytes], window: int):
        self.h, self.doc = words_of_docs(texts)
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        self.window = window
        self.n = max(0, len(self.h) - window + 1)
        self.alive = self.doc[: self.n] == self.doc[len(self.h) - self.n :] if self.n else np.zeros(0, bool)
        self.symbols = Symbols(self.h, self.doc)

    def _holding(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols among ``which`` that a window can hold, and the first and last starts of such windows."""
        s = self.symbols
        a, b = np.maximum(s.high[which] - self.window, 0), np.minimum(s.low[which], self.n - 1)
        some = a <= b
        return which[some], a[some], b[some]

    def _covered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(a, minlength=self.n + 1) - np.bincount(b + 1, minlength=self.n + 1))[: self.n] > 0

    def level(self, least: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grows symbols. -> those (text, key, first window, last window) that stand in windows left, and the windows that hold one."""
        self.symbols.grow(least, rounds)
        s = self.symbols
        which, a, b = self._holding(np.flatnonzero(s.end - s.start >= least))
        left = np.r_[0, np.cumsum(self.alive)]
        used = left[b + 1] > left[a]
        which, a, b = which[used], a[used], b[used]
        keys = (s.name[which] >> _U(_LOW_BITS)) << _U(_LOW_BITS)
        return s.doc[which], keys, a, b, self._covered(a, b)

    def rule_out(self, doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, shared: tuple[np.ndarray, np.ndarray]) -> None:
        """Windows that hold a symbol whose key isn't among their text's shared ones are no repeats."""
        one = lambda d, k: mix(k ^ mix(d.astype(_U)))
        own = ~np.isin(one(doc, key), one(*shared))
        self.alive &= ~self._covered(a[own], b[own])


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of every element of a list column, and the elements. Null as empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), pc.list_flatten(lists)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in slices(batch, "data"):
            yield part, [unpack(x) if x else b"" for x in part.column("data").to_pylist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in slices(batch):
            data = [pack(t) if t else None for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(data, pa.binary())], ["id", "tie", "data"])


def _left(part: pa.RecordBatch, texts: list[bytes], window: int, levels) -> Windows:
    """The texts' windows after some levels whose shared keys are in ``keys``."""
    w = Windows(texts, window)
    if levels:
        rows, keys = _flat(part.column("keys"))
        shared = rows, keys.to_numpy(zero_copy_only=False).view(_U)
        for least, rounds in levels:
            doc, key, a, b, _ = w.level(least, rounds)
            w.rule_out(doc, key, a, b, shared)
    return w


def _symbol_rows(window: int, levels, level: int):
    """(key, id, tie): each document's different symbols of a level in windows that are left, and a mark if there is none in some window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _opened(batches):
            w = _left(part, texts, window, levels[:level])
            doc, key, _, _, covered = w.level(*levels[level])
            bare = np.unique(w.doc[: w.n][w.alive & ~covered])
            ids = part.column("id").to_numpy(zero_copy_only=False)
            marks = (mix(ids[bare].astype(np.int64).view(_U)) % _U(_MARKS)) << _U(_LOW_BITS) | _U(1)
            doc, key = np.r_[doc, bare], np.r_[key, marks]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            fresh = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])] if len(doc) else np.empty(0, bool)
            take = pa.array(doc[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(key[fresh].view(np.int64)), part.column("id").take(take), part.column("tie").take(take)], ["key", "id", "tie"])

    return run


def _window_names(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over the words of the windows at some starts."""
    x, y = np.zeros(len(starts), _U), np.zeros(len(starts), _U)
    for j in range(window):
        word = h[starts + j]
        x += word * _U((0x9E3779B97F4A7C15 * (2 * j + 5)) & (2**64 - 1) | 1)
        y = y * _U(0xD6E8FEB86659FD93) + (word ^ (word >> _U(29)))
    return mix(x), mix(y)


def _window_rows(window: int, levels):
    """Each document's different windows that are left: (h, g, id, tie, at), h and g together 96 bits that name the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _opened(batches):
            w = _left(part, texts, window, levels)
            found = np.flatnonzero(w.alive)
            x, y = _window_names(w.h, found, window)
            order = np.lexsort((found, x, w.doc[found]))
            found, x, y = found[order], x[order], y[order]
            doc = w.doc[found]
            fresh = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (doc[1:] != doc[:-1])] if len(found) else np.empty(0, bool)
            found, x, y, doc = found[fresh], x[fresh], y[fresh], doc[fresh]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x.view(np.int64)), pa.array((y >> _U(32)).astype(np.uint32).view(np.int32)),
                    part.column("id").take(take), part.column("tie").take(take), pa.array((found - w.first[doc]).astype(np.int32)),
                ],
                ["h", "g", "id", "tie", "at"],
            )

    return run


def stretches(at: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every maximal stretch of windows that start one after the other at one earlier place. Sorted by at."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, (np.diff(at) != 1) | np.any([np.diff(p) != 0 for p in place], axis=0)]
    head = np.flatnonzero(new)
    return head, np.diff(np.r_[head, len(at)])


def _piece_rows(window: int):
    """(id, tie, block, offset, words): what a document's repeated stretches claim about blocks of the earlier documents' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _opened(batches):
            rows = []
            for text, starts in zip(texts, part.column("starts")):
                words = text.split()
                at, i, t, there = (starts.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "fid", "ftie", "fat"))
                order = np.argsort(at, kind="stable")
                at, i, t, there = (x[order].astype(np.int64) for x in (at, i, t, there))
                for k, n in zip(*stretches(at, i, t, there - at)):
                    low, high = int(there[k]), int(there[k]) + int(n) + window - 1
                    shift = int(at[k]) - low
                    for block in range(low // BLOCK, (high - 1) // BLOCK + 1):
                        a, b = max(low, block * BLOCK), min(high, (block + 1) * BLOCK)
                        rows.append((int(i[k]), int(t[k]), block, a - block * BLOCK, b" ".join(words[a + shift : b + shift])))
            rows = list(set(rows))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "tie", "block", "offset", "words"])

    return run


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tie, block, here): the wanted blocks of the earlier documents' words."""
    for part, texts in _opened(batches):
        rows = []
        for text, i, t, blocks in zip(texts, part.column("id").to_pylist(), part.column("tie").to_pylist(), part.column("blocks").to_pylist()):
            words = text.split()
            rows += [(i, t, k, b" ".join(words[k * BLOCK : (k + 1) * BLOCK])) for k in blocks]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "tie", "block", "here"])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrong = []
        for offset, words, here in zip(*(batch.column(c).to_pylist() for c in ("offset", "words", "here"))):
            claimed = words.split(b" ")
            wrong.append(here.split(b" ")[offset : offset + len(claimed)] != claimed)
        yield batch.select(["id", "tie", "block"]).filter(pa.array(wrong, pa.bool_()))


def _alike(w: Windows, found: np.ndarray) -> np.ndarray:
    """Those windows that share some of their words, place for place, with another window of their text: the others repeat nothing. One sort of one number a
    window, instead of names over all of its words."""
    key = w.doc[found].astype(_U) * _U(0x9E3779B97F4A7C15)
    for k, j in enumerate(np.unique(np.linspace(0, w.window - 1, 4).astype(np.int64))):
        key += w.h[found + j] * _U((0xD6E8FEB86659FD93 * (2 * k + 1)) & (2**64 - 1) | 1)
    rising = np.sort(key)
    twice = rising[1:][rising[1:] == rising[:-1]]
    if not len(twice):
        return found[:0]
    return found[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]


def _repeated_inside(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that also start earlier in the same text, in order, and the earlier places."""
    found = _alike(w, np.flatnonzero(w.alive))
    x, y = _window_names(w.h, found, w.window)
    doc = w.doc[found]
    order = np.lexsort((found, y, x, doc))
    x, y, doc = x[order], y[order], doc[order]
    same = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (doc[1:] == doc[:-1])
    head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0)) if len(order) else order
    again = np.flatnonzero(np.r_[False, same]) if len(order) else order
    at, there = found[order[again]], found[order[head[again]]]
    by = np.argsort(at, kind="stable")
    return at[by], there[by]


def _kept_rows(window: int):
    """Takes out what windows at ``starts`` cover, and what windows cover that start earlier in the same document; all words of a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _opened(batches):
            w = Windows(texts, window)
            own, there = _repeated_inside(w)
            rows, starts = _flat(part.column("starts"))
            every = np.r_[own, w.first[rows] + starts.to_numpy(zero_copy_only=False)].astype(np.int64)
            edge = np.bincount(every, minlength=len(w.h) + 1) - np.bincount(every + window, minlength=len(w.h) + 1)
            copy = pc.fill_null(part.column("copy"), False).to_numpy(zero_copy_only=False) & (w.size >= window)
            gone = (np.cumsum(edge)[: len(w.h)] > 0) | copy[w.doc]
            removed = np.bincount(w.doc[gone], minlength=len(texts))
            inside = dict.fromkeys(w.doc[own].tolist())
            kept = []
            for k, (text, f, n) in enumerate(zip(texts, w.first, w.size)):
                words = text.split()
                if k in inside:
                    own_k = slice(*np.searchsorted(own, (f, f + n)))
                    at, before = own[own_k] - f, there[own_k] - f
                    for a, count in zip(*stretches(at, before - at)):
                        a, b, count = int(at[a]), int(before[a]), int(count) + window - 1
                        if words[a : a + count] != words[b : b + count]:
                            raise ValueError("two different passages share a name")
                kept.append(b" ".join(compress(words, ~gone[f : f + n]) if removed[k] else words))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("tie"), pa.array(w.size), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "tie", "n_words", "n_removed", "kept"],
            )

    return run


def keyed(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, text, id (null as the least number) and tie: 1 for a null doc_id, else 0; 64 bits of the text's MD5 where rows share a doc_id.

    rows: with all columns of docs as one struct ``row``.
    """
    d = with_row(docs, F.col("doc_id"), F.col("text"), F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"))
    d = d if rows else d.drop("row")
    again = d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        found = d.withColumn("tie", F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"))
        found.ids_repeat = False
        return found
    again = again.withColumn("again", F.lit(True))
    tie = F.when(F.col("again"), F.coalesce(F.conv(F.substring(F.md5(F.col("text")), 1, 16), 16, -10).cast("long"), F.lit(-1))).otherwise(0)
    found = d.join(again, "id", "left").withColumn("tie", tie.cast("long")).drop("again")
    found.ids_repeat = True
    return found


def folded(d: DataFrame) -> DataFrame:
    """keyed documents -> text, id, tie: one row for each (id, tie), that is for rows of one doc_id and one text. Only texts whose doc_id others have too
    are shuffled, one a task and (id, tie)."""
    slim = d.select("text", "id", "tie")
    if not d.ids_repeat:
        return slim
    repeated = slim.where("tie != 0").groupBy("id", "tie").agg(F.any_value("text").alias("text"))
    return slim.where("tie = 0").unionByName(repeated)


def copies(d: DataFrame) -> DataFrame:
    """(id, tie) of the keyed documents whose text an earlier one has."""
    nodes = d.where("text is not null").select("id", "tie", text_key().alias("node"))
    place = F.struct("id", "tie")
    heads = nodes.groupBy("node").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1").select("node", "head")
    return nodes.join(heads, "node").where(place > F.col("head")).select("id", "tie", F.lit(True).alias("copy")).distinct()


def by_document(rows: DataFrame, value, name: str) -> DataFrame:
    """(id, tie, ...) -> id, tie and the list of values. Gathered after the shuffle: one value is smaller than a list of one."""
    return rows.repartition("id", "tie").groupBy("id", "tie").agg(F.collect_list(value).alias(name))


def _shared(rows: DataFrame) -> DataFrame:
    """(key, id, tie) -> id, tie, keys: each document's symbols that another document has too, and its mark."""
    marks = rows.sparkSession.range(_MARKS).select(F.shiftleft("id", _LOW_BITS).bitwiseOR(F.lit(1)).alias("key"))
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").where(F.col("key").bitwiseAND(1) == 0).unionByName(marks)
    return by_document(rows.join(again, "key").select("id", "tie", "key"), "key", "keys")


def _verify(packed: DataFrame, later: DataFrame, window: int) -> None:
    """Compares the words of all repeated stretches with the earlier documents' own; a difference is an error."""
    starts = by_document(later, F.struct("at", "fid", "ftie", "fat"), "starts").hint("merge")
    claimed = packed.join(starts, ["id", "tie"]).select("data", "starts").mapInArrow(_piece_rows(window), "id long, tie long, block int, offset int, words binary")
    claimed = materialize(claimed.distinct(), "pieces")
    wanted = claimed.select("id", "tie", "block").distinct()
    blocks = packed.join(by_document(wanted, "block", "blocks").hint("merge"), ["id", "tie"]).select("data", "id", "tie", "blocks")
    blocks = blocks.mapInArrow(_block_rows, "id long, tie long, block int, here binary").dropDuplicates(["id", "tie", "block"])
    different = claimed.join(blocks, ["id", "tie", "block"]).select("id", "tie", "block", "offset", "words", "here").mapInArrow(_differing, "id long, tie long, block int")
    if not materialize(different, "different").isEmpty():
        raise ValueError("two different passages share a name")
    release(claimed)


def repeats(packed: DataFrame, copied: DataFrame, window: int, levels) -> DataFrame:
    """(id, tie, at, fid, ftie, fat): windows of the packed documents that no copy is, which an earlier document has too, and where."""
    suspects = packed.join(copied.hint("merge"), ["id", "tie"], "left_anti").select("data", "id", "tie")
    for level in range(len(levels)):
        rows = suspects.mapInArrow(_symbol_rows(window, levels, level), "key long, id long, tie long")
        rows = materialize(rows, "symbols")
        marked = materialize(_shared(rows), "shared").hint("merge")
        release(rows)
        both = F.concat("keys", "more") if level else F.col("more")
        suspects = suspects.join(marked.withColumnRenamed("keys", "more"), ["id", "tie"]).select("data", "id", "tie", both.alias("keys"))
    windows = suspects.mapInArrow(_window_rows(window, levels), "h long, g int, id long, tie long, at int")
    windows = materialize(windows, "windows")
    firsts = windows.groupBy("h", "g").agg(F.min(F.struct("id", "tie", "at")).alias("first"))
    later = windows.join(firsts, ["h", "g"]).where(F.col("id") > F.col("first.id"))
    later = materialize(later.select("id", "tie", "at", F.col("first.id").alias("fid"), F.col("first.tie").alias("ftie"), F.col("first.at").alias("fat")), "later")
    release(windows)
    return later


def _judged(d: DataFrame, window: int, levels) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keyed documents -> the packed texts; id, tie and starts of windows to remove; id and tie of copies."""
    one = folded(d)
    packed = one.mapInArrow(_packed, "id long, tie long, data binary")
    copied = materialize(copies(one), "copies")
    later = repeats(packed, copied, window, levels)
    _verify(packed, later, window)
    return packed, by_document(later.select("id", "tie", "at"), "at", "starts"), copied


def dedup_substrings(docs: DataFrame, window: int = 20, levels=LEVELS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_removed, kept: one row per document, repeated rows included.

    Removed is every word in a window of ``window`` words that also starts earlier: in a smaller doc_id (null first), or earlier in
    the same document. Rows with one doc_id are no earlier than each other, but for equal texts under different ids. Windows are
    judged on the input. kept: the other words, joined by one space. Null, empty or short texts lose nothing; an empty table gives
    no rows. levels: (least words of a symbol, rounds) of the Spark rounds; without any, every window is named and grouped.

    Results are exact: symbols only rule out, and words decide. If two different passages ever shared a 96-bit name, the job would fail.

    Rows of one doc_id and one text fold to one before anything else, and are joined back in the end. A copy of a whole text is settled by its text's key and
    emits nothing. Each Spark round is a job of its own that writes its result and
    drops its shuffle files: the packed texts, and one symbol for about seven words; then the windows left, and the pieces to
    compare, in blocks of the earlier document, so that a passage of many copies is compared once. Counts and least places are
    pre-aggregated; the joins back are plain equi-joins, which adaptive execution splits where one symbol or window is hot.
    """
    d = keyed(docs)
    packed, starts, copied = _judged(d, window, levels)
    told = packed.join(starts.hint("merge"), ["id", "tie"], "left").join(copied, ["id", "tie"], "left").select("data", "id", "tie", "starts", "copy")
    kept = told.mapInArrow(_kept_rows(window), "id long, tie long, n_words long, n_removed long, kept string")
    if d.ids_repeat:
        kept = d.select("id", "tie").join(materialize(kept, "kept"), ["id", "tie"])
    return kept.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


def dedup_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what is kept."""
    return dedup_substrings(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
