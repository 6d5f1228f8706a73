"""Lexical ranking by one pass over tokens, for tables of queries whose terms fit in a task.

Tokens of chunks are written once, in the order in which the documents are read: no row is shuffled. A search counts its terms, then scores slices of chunks against blocks of queries as
products of matrices. A task passes on what may be among its own k best of a query; only that is shuffled. Larger tables of queries take the index (``inverted``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.ranking import few, ranked, small

#: (query, field, term) rows that tasks hold at most; cells of the matrices that a task multiplies at a time.
WEIGHTS, CELLS = 100_000, 2_000_000
#: Scores are ranked by six decimals.
_SLACK = 2e-6


def tokenized(chunks: DataFrame, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """chunks(chunk_id, fields, ...) -> the other columns, and each field's tokens; null for a null field."""
    others = [c for c in chunks.columns if c not in fields]
    return chunks.select(*others, *(F.when(F.col(f).isNotNull(), T.tokens(F.col(f))).alias(f) for f in fields))


def weighed(tokens: DataFrame, queries: DataFrame, k1: float, boosts: dict[str, float]) -> DataFrame:
    """queries(query_id, text) -> query_id, field, term, weight, average, for the terms that chunks have."""
    terms = queries.select("query_id", F.explode(T.distinct_tokens(F.col("text"))).alias("term"))
    own = tokens.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in boosts)))).where("t is not null")
    totals = own.groupBy("field").agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("average"))  # a row a field
    df = own.select("field", F.explode(F.array_distinct("t")).alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair))[F.col("field")]
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(df, "term").join(F.broadcast(totals), "field").select("query_id", "field", "term", (boost * idf * (k1 + 1)).alias("weight"), "average")


def _blocks(rows: list[Row]) -> list[tuple]:
    """Queries in blocks, each with its query ids, and for each field its terms, their mean length and a matrix of terms by queries."""
    by_query: dict = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append(r)
    blocks, ids, terms = [], [], set()
    for q in sorted(by_query):
        more = terms | {(r["field"], r["term"]) for r in by_query[q]}
        if ids and (len(ids) + 1) * len(more) > CELLS:
            blocks.append(ids)
            ids, more = [], {(r["field"], r["term"]) for r in by_query[q]}
        ids, terms = [*ids, q], more
    out = []
    for ids in [*blocks, ids] if ids else []:
        fields = {}
        for f in dict.fromkeys(r["field"] for q in ids for r in by_query[q]):
            at = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for q in ids for r in by_query[q] if r["field"] == f))}
            matrix, average = np.zeros((len(at), len(ids))), 0.0
            for i, q in enumerate(ids):
                for r in by_query[q]:
                    if r["field"] == f:
                        matrix[at[r["term"]], i], average = r["weight"], r["average"]
            fields[f] = list(at), average, matrix
        out.append((ids, fields))
    return out


def _scores(part: pa.RecordBatch, fields: dict, queries: int, k1: float, b: float) -> np.ndarray:
    """Chunks by queries."""
    best = np.zeros((part.num_rows, queries))
    for f, (terms, average, matrix) in fields.items():
        lists = part.column(f)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        term = pc.index_in(lists.flatten(), value_set=pa.array(terms, pa.string()))
        asked = pc.is_valid(term).to_numpy(zero_copy_only=False)
        cell = np.repeat(np.arange(part.num_rows), length)[asked] * len(terms) + term.drop_null().to_numpy()
        tf = np.bincount(cell, minlength=part.num_rows * len(terms)).reshape(part.num_rows, -1).astype(np.float64)
        norm = k1 * (1 - b + b * length / average)
        np.maximum(best, np.divide(tf, tf + norm[:, None], out=np.zeros_like(tf), where=tf > 0) @ matrix, out=best)
    return best


def _best(blocks: list[tuple], k: int, k1: float, b: float, keep: tuple[str, ...], per: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict = {}  # the k best scores of each query of a block so far, in a group
        for batch in batches:
            for number, (ids, fields) in enumerate(blocks):
                step = max(16, CELLS // max(len(ids), *(len(t) for t, _, _ in fields.values())))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    score = _scores(part, fields, len(ids), k1, b)
                    coded = part.column(per).dictionary_encode() if per else None
                    of = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False) if per else np.zeros(part.num_rows, np.int32)
                    for g in np.unique(of):
                        own, key = np.flatnonzero(of == g), (number, coded.dictionary[int(g)].as_py() if per and g >= 0 else None)
                        mine = score[own]
                        known = np.vstack([reached.get(key, np.zeros((0, len(ids)))), mine])
                        reached[key] = known if len(known) <= k else np.partition(known, len(known) - k, axis=0)[-k:]
                        floor = reached[key].min(axis=0) - _SLACK if len(reached[key]) == k else np.zeros(len(ids))
                        row, query = np.nonzero((mine > 0) & (mine >= floor))
                        if len(row):
                            rows = part.take(pa.array(own[row]))
                            columns = [pa.array(ids, schema.field("query_id").type).take(pa.array(query)), *(rows.column(c) for c in keep), pa.array(mine[row, query])]
                            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def search(
    tokens: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, boosts: dict[str, float] | None = None, columns: tuple[str, ...] = (), per: str | None = None
) -> DataFrame | None:
    """tokens (as from ``tokenized``), queries(query_id, text) -> query_id, chunk_id, columns, score, rank: the top k of each query, as ``ranking.bm25`` has them.

    boosts, per: as in ``inverted.search``. None where the queries have more than ``WEIGHTS`` terms, which no task should hold.
    """
    boosts = boosts or {"content": 1.0}
    if not few(queries.select("query_id", F.explode(T.distinct_tokens(F.col("text")))), WEIGHTS // len(boosts)):
        return None
    rows = weighed(tokens, queries, k1, boosts).collect()
    keep = tuple(dict.fromkeys(("chunk_id", *columns, *([per] if per else []))))
    kinds = dict(tokens.dtypes)
    names = {"query_id": dict(queries.dtypes)["query_id"], **{c: kinds[c] for c in keep}, "score": "double"}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c, arrow[t]) for c, t in names.items()])
    own = tokens.select(*keep, *(f for f in boosts if f not in keep))
    hits = own.mapInArrow(_best(_blocks(rows), k, k1, b, keep, per, schema), ", ".join(f"{c} {t}" for c, t in names.items()))
    top = ranked(hits.withColumn("score", F.round("score", 6)), "score", ["chunk_id"], ["query_id", *([per] if per else [])], k)
    rest = ["query_id", "chunk_id", *columns, "score", "rank"]
    return top.select(*([F.col(per).cast("string").alias("per")] if per else []), *rest)
