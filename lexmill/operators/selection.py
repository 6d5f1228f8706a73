"""Steps whose next choice hangs on the ones before: context selection under quotas and a budget, and question filtering.

Context selection runs per query on candidates that ranking has already limited; questions are filtered in rounds over similar pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.ranking import small
from lexmill.storage import settled

# Fixed values.
NEGATIVE = (
    "не используй", "не использовать", "исключи", "исключить", "отвлекающий", "отвлекающего", "дистрактор", "distractor", "ignore",
    "do not use", "exclude",
)
QUOTED = r"""[«"“]([^»"”]{2,160})[»"”]"""


def negative_titles(query: Column) -> Column:
    """Normalized quoted titles of the clauses that ask to leave something out."""
    clauses = F.filter(F.split(query, r"[.!?;\n\r]"), lambda c: F.lower(c).rlike("|".join(NEGATIVE)))
    titles = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(titles, T.normalize), lambda t: t != ""))


def select_context(
    candidates: DataFrame, most: int = 12, least: int = 4, per_document: int = 3, per_page: int = 2, budget: int = 4000, short: int = 0
) -> DataFrame:
    """candidates(query_id, query, rank, chunk_id, doc_id, page, title, content, parent) -> query_id, chunk_id, decision, final_rank, tokens.

    In rank order: titles that the query rules out go; a content of fewer than ``short`` words gives way to its parent text; repeats of a
    content or a parent go; a full document waits, and so does a full page unless the candidate brings a query term that nothing
    selected has; what would break the token budget goes. If fewer than ``least`` were selected, the waiting ones are tried again
    in order, still under the document limit and the budget. Null titles, contents and parents read as empty.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    c = candidates.withColumn("content", blank(F.col("content"))).withColumn("parent", blank(F.col("parent")))
    c = c.withColumn("expanded", (F.col("parent") != "") & (F.size(T.words(F.col("content"))) < short))
    c = c.withColumn("text", F.when(F.col("expanded"), F.col("parent")).otherwise(F.col("content")))
    wanted = T.distinct_tokens(blank(F.col("query")))
    c = c.select(
        "query_id", "rank", "chunk_id", "doc_id", "page", "expanded", F.md5("text").alias("hash"), F.md5(F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("text"))).alias("unit"),
        T.token_count(F.col("text")).alias("tokens"), F.array_intersect(wanted, T.distinct_tokens(F.col("text"))).alias("terms"),
        F.array_contains(negative_titles(blank(F.col("query"))), T.normalize(blank(F.col("title")))).alias("negative"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        documents, pages, known, covered = {}, {}, set(), set()
        used, chosen, waiting, decisions = 0, 0, [], {}

        def take(r, note: str) -> None:
            nonlocal used, chosen
            chosen += 1
            used += r.tokens
            documents[r.doc_id] = documents.get(r.doc_id, 0) + 1
            pages[r.page] = pages.get(r.page, 0) + 1
            known.update({r.hash, r.unit})
            covered.update(r.terms)
            decisions[r.Index] = (note, chosen)

        for r in group.sort_values(["rank", "chunk_id"]).itertuples():
            if chosen >= most:
                decisions[r.Index] = ("not_reached", None)
            elif r.negative:
                decisions[r.Index] = ("negative_title", None)
            elif {r.hash, r.unit} & known:
                decisions[r.Index] = ("duplicate", None)
            elif documents.get(r.doc_id, 0) >= per_document and not r.expanded:
                decisions[r.Index] = ("document_quota", None)
                waiting.append(r)
            elif pages.get(r.page, 0) >= per_page and not set(r.terms) - covered:
                decisions[r.Index] = ("page_quota", None)
                waiting.append(r)
            elif used + r.tokens > budget:
                decisions[r.Index] = ("budget", None)
            else:
                take(r, "selected")
        for r in waiting:
            fits = used + r.tokens <= budget and (r.expanded or documents.get(r.doc_id, 0) < per_document)
            if chosen < min(least, most) and fits and not {r.hash, r.unit} & known:
                take(r, "overflow")
        found = [decisions[i] for i in group.index]
        out = group[["query_id", "chunk_id", "tokens"]].copy()
        out["decision"], out["final_rank"] = [f[0] for f in found], pd.array([f[1] for f in found], dtype="Int64")
        return out

    kind = dict(candidates.dtypes)
    schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, tokens long, decision string, final_rank long"
    return c.groupBy("query_id").applyInPandas(run, schema)


def not_first(pairs: DataFrame, group: str) -> DataFrame:
    """pairs(group, a, b), a before b -> group, node: those that a walk in order drops, which keeps a node unless it is paired with one it has kept.

    All groups side by side, in rounds of joins: a node that no open pair has as its later end is kept, what is paired with it behind is dropped, and pairs of dropped nodes close.
    A round decides every node whose earlier partners are decided; there are as many rounds as the longest chain of undecided nodes needs.
    """
    open_ = settled(pairs.select(group, "a", "b").distinct(), "pairs")
    dropped = open_.select(group, F.col("b").alias("node")).limit(0)
    while not open_.isEmpty():
        kept = open_.select(group, "a").distinct().join(open_.select(group, F.col("b").alias("a")).distinct(), [group, "a"], "left_anti")
        now = settled(open_.join(kept, [group, "a"], "left_semi").select(group, F.col("b").alias("node")).distinct(), "dropped")
        dropped = dropped.unionByName(now)
        for end in ("a", "b"):
            open_ = open_.join(now.withColumnRenamed("node", end), [group, end], "left_anti")
        open_ = settled(open_, "pairs")
    return dropped


#: Cells of a part in which two similar sets differ at most, and how many equal ones make a signature.
_APART, _ALIKE = 2, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes(largest: int, most: float) -> list[tuple[int, int, int]]:
    """(last size, parts, apart) of classes of sizes, from 1 on, up to the class behind the one of ``largest``.

    Sets whose Jaccard similarity is over ``most`` lie in one class or in two next to each other. Their tokens are dealt into so many parts that in one of them at most ``apart``
    tokens differ; no parts: they are equal.
    """
    out, behind = [], 0
    while behind < 2:
        low = out[-1][0] + 1 if out else 1
        high = int(low / most + 1e-9)
        differ = int(2 * high * (1 - most) / (1 + most) + 1e-9)  # tokens that only one of two such sets has
        parts = differ // (_APART + 1) + 1 if differ else 0
        out.append((high, parts, differ // parts if parts else 0))
        behind += high >= largest
    return out


def _signed(hashes: np.ndarray, number: int, parts: int, apart: int) -> np.ndarray:
    """The signatures of a set in a class. Inside a part tokens fall into ``apart + _ALIKE`` cells, so that ``_ALIKE`` cells at least are equal; each choice of so many is a signature."""
    cells = apart + _ALIKE
    sums = np.zeros(parts * cells, np.uint64)
    np.add.at(sums, (hashes % np.uint64(parts * cells)).astype(np.int64), hashes)
    chosen = np.array(list(combinations(range(cells), _ALIKE)))
    out = np.arange(number * 1_000_000, number * 1_000_000 + parts * len(chosen), dtype=np.uint64).reshape(parts, -1)
    for column in chosen.T:
        out = out * _ODD
        out = (out ^ (out >> np.uint64(29))) + sums.reshape(parts, cells)[:, column]
    out = out * _ODD
    return (out ^ (out >> np.uint64(29))).ravel()


def _signatures(most: float, rows: int = 200_000):
    """(..., hashes of a set's distinct tokens) -> (..., sig): signatures of each set in its own class and the next. Similar sets share one at least; their number grows with the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            classes = _classes(int(sizes.max(initial=1)), most)
            of = np.searchsorted([high for high, _, _ in classes], sizes)
            found, row, total = [], [], 0
            for i in range(batch.num_rows):
                for number in (of[i], of[i] + 1):
                    _, parts, apart = classes[number]
                    if parts:
                        found.append(_signed(hashes[ends[i] - sizes[i] : ends[i]], int(number), parts, apart))
                        row.append(np.full(len(found[-1]), i))
                        total += len(found[-1])
                if found and (total > rows or i == batch.num_rows - 1):
                    at = pa.array(np.concatenate(row))  # the hashes themselves are not repeated
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(np.concatenate(found).view(np.int64))], names=[*batch.schema.names[:-1], "sig"])
                    found, row, total = [], [], 0

    return run


def similar(sets: DataFrame, group: str, key: str, most: float) -> DataFrame:
    """sets(group, key, t), t different sets of tokens -> group, a, b (a before b): all pairs of a group whose Jaccard similarity is over ``most``.

    Candidates share a signature of about ten tokens, not a single one, so that sets that merely have a rare word in common don't meet, however many there are.
    """
    hashed = sets.select(group, key, F.transform("t", lambda w: F.xxhash64(w)).alias("h"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in hashed.dtypes[:2])
    signed = settled(hashed.mapInArrow(_signatures(most), f"{kinds}, sig long"), "signatures")
    shared = settled(signed.groupBy(group, "sig").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    a = signed.join(small(shared), [group, "sig"], "left_semi")
    pairs = a.join(a.select(group, "sig", F.col(key).alias("_k")), [group, "sig"]).where(F.col(key) < F.col("_k"))
    pairs = settled(pairs.select(group, key, "_k").distinct(), "candidates")
    both = sets.join(small(pairs), [group, key]).join(sets.select(group, F.col(key).alias("_k"), F.col("t").alias("u")), [group, "_k"])
    return both.where(T.jaccard(F.col("t"), F.col("u")) > most).select(group, F.col(key).alias("a"), F.col("_k").alias("b"))


def fresh_questions(questions: DataFrame, group: str, key: str, text: str, most: float = 0.86) -> DataFrame:
    """Questions in key order, each kept unless its tokens' Jaccard similarity with a kept one of its group is over ``most``.

    A group is one generation run. Of equal sets only the first can be kept: if it isn't, what drops it drops the others too. So pairs are looked for among different sets
    only (``similar``); and only pairs, not texts, reach the rounds that decide in order. Questions without tokens are similar to none. A key may have several questions: those of equal
    tokens are one, others follow each other.
    """
    tokens = T.distinct_tokens(F.col(text))
    name = F.array_join(F.array_sort(tokens), " ")
    node = F.struct(F.col(key).alias("key"), F.xxhash64(name).alias("set"))
    free = F.col(group).isNull() | F.col(key).isNull() | (F.size(tokens) == 0)
    q = questions.where(~free).select(group, F.sha2(name, 256).alias("_set"), node.alias("_node"), tokens.alias("t"))
    first = q.groupBy(group, "_set").agg(F.min_by("t", "_node").alias("t"), F.min("_node").alias("_node"))
    sets = settled(first.select(group, "_node", "t"), "sets")
    gone = not_first(similar(sets, group, "_node", most), group)
    kept = sets.select(group, "_node").join(gone.withColumnRenamed("node", "_node"), [group, "_node"], "left_anti").withColumn("_kept", F.lit(True))
    return questions.withColumns({"_node": node, "_free": free}).join(kept, [group, "_node"], "left").where("_free or _kept").select(*questions.columns)
