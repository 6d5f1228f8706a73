"""Near-duplicate documents by BagMinHash signatures, bands and exact multiset overlap.

A document is the multiset of its five-word shingles. Each (shingle, weight level) owns a Poisson process over time whose points
fall on random signature registers; a register keeps its earliest point. Two documents then agree on a register with a probability
that is exactly their weighted Jaccard similarity. Levels are grouped hierarchically into [0,1), [1,2), [2,4), [4,8) ...: one process
of a rate in proportion serves a whole group and its points are thinned by the document's weight, so that a shingle of weight w
costs log w processes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, release, row_columns, shingles_of_docs, slices, text_key, texts_of, with_row
from .components import connected_components

_U = np.uint64
#: A block of a bucket: so many texts or bytes of text, about. Shingles that are compared at once.
_BLOCK_TEXTS, _BLOCK_BYTES, _WIDTH = 256, 1 << 22, 4096


def bags(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight): each text's distinct shingles with multiplicities, as 44-bit elements."""
    h, doc = shingles_of_docs(texts, n)
    key = np.sort((doc.astype(_U) << _U(44)) | (h >> _U(20)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    weight = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), weight


def bagminhash(texts: list[bytes], registers: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x registers, 64-bit names of the earliest points) and whether a text has any shingle."""
    doc, element, weight = bags(texts, n)
    total = np.bincount(doc, weights=weight, minlength=len(texts))
    has = total > 0
    best = np.full(len(texts) * registers, np.inf)
    name = np.zeros(len(texts) * registers, dtype=_U)
    limit = np.divide(math.log(registers) + 4, total, out=np.zeros(len(texts)), where=has)
    open_docs = has.copy()
    # groups of levels: group 0 is [0, 1), group g is [2^(g-1), 2^g)
    groups = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(doc)), groups)
    group = np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups)
    low = np.where(group > 0, 2.0 ** (group - 1), 0.0)
    width = np.where(group > 0, low, 1.0)
    state = mix(element[owner] * _U(64) + group.astype(_U))
    p_doc, p_weight = doc[owner], weight[owner].astype(np.float64)
    while open_docs.any():
        live = np.flatnonzero(open_docs[p_doc])
        s, d, w, lo, wd, t = state[live], p_doc[live], p_weight[live], low[live], width[live], np.zeros(len(live))
        points = []
        while len(s):
            s = mix(s + _U(0x9E3779B97F4A7C15))
            t = t - np.log(((s >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * wd)
            stay = t < limit[d]
            s, d, w, lo, wd, t = s[stay], d[stay], w[stay], lo[stay], wd[stay], t[stay]
            r = mix(s ^ _U(0xA0761D6478BD642F))
            inside = lo + wd * ((r >> _U(40)).astype(np.float64) * 2.0**-24) < w
            points.append((d[inside] * registers + ((r & _U(0xFFFFFFFF)) % _U(registers)).astype(np.int64)[inside], t[inside], r[inside]))
        slot, at, ident = (np.concatenate(x) for x in zip(*points))
        np.minimum.at(best, slot, at)
        won = at == best[slot]
        name[slot[won]] = ident[won]
        open_docs &= np.isinf(best).reshape(len(texts), registers).any(axis=1)
        limit[open_docs] *= 2
    return name.reshape(len(texts), registers), has


def _banded(registers: int, bands: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                signature, has = bagminhash(texts_of(part), registers, n)
                rows = registers // bands
                keys = np.zeros((len(has), bands), dtype=_U)
                for j in range(rows):
                    keys = mix((keys ^ signature[:, j::rows][:, :bands]) + _U(j + 1))
                keys = mix(keys + np.arange(bands, dtype=_U)[None, :]).view(np.int64)
                offsets = np.r_[0, np.cumsum(np.where(has, bands, 0))].astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))
                length = pc.binary_length(part.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), length, arrays], ["doc_id", "node", "length", "bands"])

    return run


def similarity(a: list[bytes], b: list[bytes], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair."""
    doc, element, weight = bags([x for pair in zip(a, b) for x in pair], n)
    pair, side = doc >> 1, doc & 1
    order = np.lexsort((side, element, pair))
    pair, side, element, weight = pair[order], side[order], element[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (element[1:] == element[:-1]))
    common = np.bincount(pair[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=len(a))
    total = np.bincount(pair, weights=weight, minlength=len(a))
    return np.divide(common, total - common, out=np.zeros(len(a)), where=total > common)


def _verified(n: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                for pair in slices(part, "text_b"):
                    ok = pa.array(similarity(texts_of(pair, "text_a"), texts_of(pair, "text_b"), n) >= least)
                    yield pair.select(["a", "b"]).filter(ok)

    return run


def overlaps(left: list[bytes], right: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of a left and a right text: how much their shingle multisets have in common, and the sum of their sizes."""
    doc, element, weight = bags([*left, *right], n)
    size = np.bincount(doc, weights=weight, minlength=len(left) + len(right))
    # the k-th occurrence of a shingle is an element of its own, so that multisets are sets
    doc, element = np.repeat(doc, weight), np.repeat(element, weight)
    nth = (np.arange(len(doc)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(_U)
    _, column = np.unique(np.where(nth > 0, mix(element + (nth << _U(44))), element), return_inverse=True)
    on_left = doc < len(left)
    most = column.max(initial=-1) + 1
    shared = (np.bincount(column[on_left], minlength=most) > 0) & (np.bincount(column[~on_left], minlength=most) > 0)
    keep = shared[column]
    doc, column = doc[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    common = np.zeros((len(left), len(right)))
    cuts = np.searchsorted(column, np.arange(0, shared.sum() + _WIDTH, _WIDTH))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        has = np.zeros((len(left) + len(right), min(_WIDTH, column[-1] + 1 - k * _WIDTH)), dtype=np.float32)
        has[doc[a:b], column[a:b] - k * _WIDTH] = 1
        common += has[: len(left)] @ has[len(left) :].T
    return common, size[: len(left), None] + size[None, len(left) :]


def _linked(n: int, least: float):
    """One block of a bucket against another: (a, b), the classes of the pairs that reach the bound. A pair is compared in its first common bucket."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        is_left = rows.column("left").to_numpy()
        left, right = rows.filter(pa.array(is_left)), rows.filter(pa.array(~is_left))
        (ra, rb), (na, nb) = ([x.column(c).to_pylist() for x in (left, right)] for c in ("root", "node"))
        ids = {v: k for k, v in enumerate({*ra, *rb})}
        wanted = np.array([ids[x] for x in ra])[:, None] != np.array([ids[x] for x in rb])[None, :]
        # two texts that are both on the left side of their bucket meet twice
        place = {v: k for k, v in enumerate(sorted({*na, *nb}))}
        twice = right.column("minor").to_numpy()[None, :] & (np.array([place[x] for x in na])[:, None] >= np.array([place[x] for x in nb])[None, :])
        wanted &= ~twice
        if wanted.any():
            p, q = (np.array(x.column("bands").to_pylist()) for x in (left, right))
            key, before = rows.column("key")[0].as_py(), np.zeros_like(wanted)
            for band in range(p.shape[1]):
                equal = p[:, band][:, None] == q[:, band][None, :]
                wanted &= ~(before & equal & (p[:, band] == key)[:, None])
                before |= equal
        if not wanted.any():
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        rows_in, columns_in = wanted.any(axis=1), wanted.any(axis=0)
        texts = [[t for t, ok in zip(texts_of(x.to_batches()[0], "text"), used) if ok] for x, used in ((left, rows_in), (right, columns_in))]
        common, total = overlaps(*texts, n)
        found = np.zeros_like(wanted)
        found[np.ix_(rows_in, columns_in)] = (total > common) & (common >= least * (total - common))
        pairs = {(ra[i], rb[j]) for i, j in zip(*np.nonzero(found & wanted))}
        return pa.table({"a": pa.array([x[0] for x in pairs], pa.binary()), "b": pa.array([x[1] for x in pairs], pa.binary())})

    return run


def _links_between_classes(entries: DataFrame, texts: DataFrame, roots: DataFrame, text_of, n: int, least: float) -> DataFrame:
    """(a, b): classes so far (their roots) that a pair of texts of one bucket links. Every pair of a bucket whose texts are of different classes is compared.

    A bucket's largest class is not compared with itself: the texts of its other classes (left) are laid in blocks over blocks of all.
    """
    live = entries.where("size > 2").select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    live = materialize(live.join(mixed, "key").join(texts.select("node", "length"), "node"), "live")
    of_class = live.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / _BLOCK_TEXTS, size / _BLOCK_BYTES, F.lit(1))).cast("int")
    buckets = of_class.groupBy("key").agg(F.max(F.struct("n", "bytes", "root")).alias("major"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    buckets = buckets.select(
        "key", F.col("major.root").alias("major"), blocks(F.col("n"), F.col("bytes")).alias("all_blocks"),
        blocks(F.col("n") - F.col("major.n"), F.col("bytes") - F.col("major.bytes")).alias("left_blocks"),
    )
    rows = live.join(buckets, "key").withColumn("minor", F.col("root") != F.col("major"))
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = rows.where("minor").select("key", own("left_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(True).alias("left"), "minor", "node", "root")
    right = rows.select("key", every("left_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(False).alias("left"), "minor", "node", "root")
    members = materialize(left.unionByName(right), "blocks")
    source = text_of(members.select("node").distinct())
    full = members.join(source, "node").join(texts.select("node", "bands"), "node")
    return full.groupBy("key", "i", "j").applyInArrow(_linked(n, least), "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame, similarity_at_least: float = 0.8, shingle: int = 5, registers: int = 120, bands: int = 24, chain: int = 256
) -> DataFrame:
    """docs(doc_id, text, ...) -> (node, members, class_id, class_node, copies): one row per distinct text that has words.

    node is the text's key, members the number of its rows, class_id the least doc_id of its class (null only if all are null),
    class_node the text that carries it. Texts are linked where the weighted Jaccard similarity of their shingle multisets is at
    least the bound; classes are the links' connected components.

    Equal texts fold into one row before any pairing. Within a band's bucket each text is paired with the bucket's most central
    text (the one with most band neighbours in all) and with its neighbour in the order of its next band, in chains of about ``chain``
    texts: at most 2n pairs for a bucket of n texts, verified on the whole texts. Then every pair of a bucket whose texts are still in different classes is compared,
    block by block, so that no link inside a bucket is left out.

    Null and wordless texts have no row: they are nobody's copy. Ties: least doc_id, then least key. Other columns are ignored.
    """
    keyed = docs.select("doc_id", F.col("text"), text_key().alias("node"))
    signed = materialize(
        keyed.mapInArrow(_banded(registers, bands, shingle), "doc_id long, node binary, length long, bands array<long>").where(F.size("bands") > 0), "signed"
    )
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), F.any_value("length").alias("length"), F.any_value("bands").alias("bands"))
    texts = materialize(texts, "texts")

    entries = texts.select(
        "node",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(F.get("bands", i).alias("key"), F.get("bands", (i + 1) % bands).alias("next")))).alias("x"),
    ).select("node", "x.key", "x.next")
    crowded = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = materialize(entries.join(crowded, "key"), "entries")
    central = entries.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = entries.join(central, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))
    star = entries.join(hubs, "key").where(F.col("node") != F.col("hub")).select("node", F.col("hub").alias("other"))
    line = Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / chain))).orderBy("next", "node")
    chain = entries.select("node", F.lag("node").over(line).alias("other")).where("other is not null")
    pairs = star.unionByName(chain).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")

    def text_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(texts.select("node", "doc_id"), "node")
        rows = keyed.join(wanted, (keyed.node == wanted.node) & keyed.doc_id.eqNullSafe(wanted.doc_id), "left_semi")
        return rows.groupBy("node").agg(F.any_value("text").alias("text"))

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    source = text_of(wanted)
    found = (
        pairs.join(source.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(source.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_verified(shingle, similarity_at_least), "a binary, b binary")
    )
    roots = materialize(connected_components(found), "roots")
    merged = connected_components(_links_between_classes(entries, texts, roots, text_of, shingle, similarity_at_least))
    merged = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
    everyone = texts.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = everyone.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    member = texts.select("node", "doc_id", "members").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = member.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"), F.sum("members").alias("copies")
    )
    return member.join(heads, "root").select("node", "members", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("class_node"), "copies")


def document_classes(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per document: doc_id, class_id, copies (documents in its class), kept.

    kept: the document is its class's least doc_id. A document without words is its own class (class_id = doc_id).
    Repeated rows get equal rows; an empty table gives an empty one.
    """
    classes = near_duplicates(docs, **options)
    rows = docs.select("doc_id", text_key().alias("node")).join(classes, "node", "left")
    alone = F.col("copies").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (alone | ((F.col("node") == F.col("class_node")) & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class (the least doc_id; of its repeated rows, one). Columns as they come.

    Documents without words are nobody's copy and stay.
    """
    classes = near_duplicates(docs.select("doc_id", "text"), **options)
    rows = with_row(docs, F.col("doc_id").alias("id"), text_key().alias("node"))
    repeated = rows.groupBy("node", "id").agg(F.count("*").alias("n")).where("n > 1 and node is not null").select(F.col("node").alias("again"), F.col("id").alias("again_id"))
    wordless = rows.join(classes.select("node"), "node", "left_anti").select("row")
    heads = classes.where(F.col("node") == F.col("class_node")).select(F.col("node").alias("head"), F.col("class_id").alias("head_id"))
    heads = heads.join(repeated, (F.col("head") == F.col("again")) & F.col("head_id").eqNullSafe(F.col("again_id")), "left")
    kept = rows.join(heads, (F.col("node") == F.col("head")) & F.col("id").eqNullSafe(F.col("head_id")))
    once = kept.where("again is null").select("row")
    again = kept.where("again is not null").select("row", "node").dropDuplicates(["node"]).select("row")
    return once.unionByName(again).unionByName(wordless).select(*row_columns(docs))
