"""Lexical and dense retrieval over tables of queries, fusion, reranking and quotas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def few(df: DataFrame, rows: int = 500_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, bound: DataFrame | None = None, rows: int = 500_000) -> DataFrame:
    """df, to be broadcast where it has at most so many rows; beyond that Spark joins by exchanges. bound: a cheaper table with as many rows at least."""
    return F.broadcast(df) if few(df if bound is None else bound, rows) else df


def postings(chunks: DataFrame, terms: DataFrame | None = None, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """chunks(chunk_id, fields), terms(term) -> chunk_id, field, length, term, tf: only of the terms asked for, or all.

    Tokens of other terms go before the exchange where the terms are few. All postings of a chunk lie together.
    """
    own = F.array(*(F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("t")) for f in fields))
    t = chunks.select("chunk_id", F.explode(own).alias("x")).select("chunk_id", "x.field", F.size("x.t").alias("length"), F.explode("x.t").alias("term"))
    hits = t if terms is None else t.join(terms, "term", "left_semi")
    return hits.repartition("chunk_id").groupBy("chunk_id", "field", "length", "term").agg(F.count("*").alias("tf"))


def ranked(scored: DataFrame, score: str, tie: list[str], by: list[str], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank within ``by``, best first, ties by id; top k."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    out = scored.withColumn(name, F.row_number().over(w).cast("long"))
    return out if k is None else out.where(F.col(name) <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, fields: dict[str, float] | None = None) -> DataFrame:
    """chunks(chunk_id, content or the fields), queries(query_id, text) -> query_id, chunk_id, score, rank: the top k of each query.

    fields: boosts; a chunk scores as its best field does, each field with its own frequencies and mean length. A null field is none.
    Scores are summed where the chunk's postings lie, and each task passes on its own top k; only they are shuffled to the query.
    """
    fields = fields or {"content": 1.0}
    terms = queries.select("query_id", F.explode(T.distinct_tokens(F.col("text"))).alias("term"))
    hits = postings(chunks, small(terms.select("term").distinct()), tuple(fields))
    sizes = chunks.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), T.token_total(F.col(f)).alias("n")) for f in fields))).alias("x")).select("x.*")
    sizes = sizes.where("n is not null").groupBy("field").agg(F.count("*").alias("docs"), F.avg("n").alias("average"))  # one row a field
    frequency = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*(F.lit(x) for pair in fields.items() for x in pair))[F.col("field")]
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(frequency, "term").join(F.broadcast(sizes), "field").select("query_id", "field", "term", idf.alias("idf"), "average", boost.alias("boost"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    scored = hits.join(small(asked, terms, 500_000 // len(fields)), ["field", "term"]).groupBy("query_id", "chunk_id", "field", "boost").agg(F.sum(part).alias("part"))
    best = scored.groupBy("query_id", "chunk_id").agg(F.round(F.max(F.col("boost") * F.col("part")), 6).alias("score"))
    return ranked(best, "score", ["chunk_id"], ["query_id"], k)


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; null ones as zeros."""
    lists = lists.combine_chunks()
    known = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), len(flat) // max(1, known.sum())))
    out[known] = np.nan_to_num(flat.reshape(known.sum(), -1))
    return out


def _nearest(k: int, schema: pa.Schema, cells: int = 4_000_000):
    """Of each query of a group its k best vectors of the group, and those of equal score: products of matrices, so many cells at a time."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            v, q = matrix(vectors["embedding"]), matrix(queries["q"])
            step = max(1, cells // len(v))
            for at in range(0, len(q), step):
                score = q[at : at + step] @ v.T
                worst = np.partition(score, len(v) - k, axis=1)[:, len(v) - k, None] - 2e-6 if len(v) > k else 0.0
                query, vector = np.nonzero((score >= worst) & (score > 0))
                columns = [queries["query_id"].take(pa.array(query + at)), *(vectors[c].take(pa.array(vector)) for c in schema.names[1:-1]), pa.array(score[query, vector])]
                found.append(pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, on: list[str], keep: list[str], k: int) -> DataFrame:
    """vectors(on, keep, embedding), queries(on, query_id, q) -> query_id, keep, score: at least the k best positive ones of every query in each group of ``on``."""
    kinds = {"query_id": dict(queries.dtypes)["query_id"], **{c: dict(vectors.dtypes)[c] for c in keep}, "score": "double"}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c, arrow[t]) for c, t in kinds.items()])
    own = [*dict.fromkeys([*on, *keep]), "embedding"]
    left = vectors.select(*own).toDF(*own).groupBy(*on)
    right = queries.select(*on, "query_id", "q").toDF(*on, "query_id", "q").groupBy(*on)
    scored = left.cogroup(right).applyInArrow(_nearest(k, schema), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return scored.withColumn("score", F.round("score", 6)).where("score > 0")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, by: tuple[str, ...] = (), slice_rows: int = 16_384) -> DataFrame:
    """vectors(vec_id, embedding, by), queries(query_id, q) -> query_id, by, vec_id, score, rank: exact, positive scores only; by: the top k of each of these columns' values.

    Queries are cut into blocks and vectors into slices, by their number; a task multiplies one block by one slice and passes on its own top k.
    """
    blocks, slices = max(1, -(-queries.count() // block)), max(16, -(-vectors.count() // slice_rows))
    q = queries.where("q is not null").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    q = q.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    v = vectors.where("embedding is not null").withColumn("_slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    v = v.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q, on = q.withColumn("_block", F.col("_block").cast("int")), ["_block", "_slice"]
    if by:  # vectors of a value stand in groups of their own, so that each has its best
        q = q.join(small(v.select(*on, *by).distinct()), on)
        on = [*on, *by]
    near = nearest(v, q, on, [*by, "vec_id"], k)
    return ranked(near, "score", ["vec_id"], ["query_id", *by], k)


def rrf(lanes: DataFrame, by: list[str], key: list[str], constant: int = 60) -> DataFrame:
    """lanes(by, key, rank) -> by, key, score (sum of 1 / (constant + rank) over lanes), lanes, rank."""
    fused = lanes.groupBy(*by, *key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.count("*").alias("lanes"))
    return ranked(fused, "score", key, by)


def coverage(query: Column, content: Column) -> Column:
    """Share of the query's distinct tokens that the content has."""
    q = T.distinct_tokens(query)
    return F.round(F.size(F.array_intersect(q, T.tokens(content))) / F.greatest(F.size(q), F.lit(1)), 6)


def first_per(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def distinct_documents_first(rows: DataFrame, by: str, document: str, rank: str, most: int) -> DataFrame:
    """Each group's best row of its first ``most`` documents, then the rest in order: a new rank."""
    own = F.row_number().over(Window.partitionBy(by, document).orderBy(rank))
    r = rows.withColumn("_own", own)
    lead = F.sum((F.col("_own") == 1).cast("int")).over(Window.partitionBy(by).orderBy(rank))
    r = r.withColumn("_late", ~((F.col("_own") == 1) & (lead <= most)))
    return r.withColumn("new_rank", F.row_number().over(Window.partitionBy(by).orderBy("_late", rank)).cast("long")).drop("_own", "_late")


def interleaved(rows: DataFrame, by: str, lane: str, rank: str) -> DataFrame:
    """Round robin over lanes: first of each lane, then second of each; position from 1."""
    offset = F.row_number().over(Window.partitionBy(by, lane).orderBy(rank))
    r = rows.withColumn("_offset", offset)
    return r.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("_offset", lane)).cast("long")).drop("_offset")


def grouped_hits(rows: DataFrame, by: list[str], group: str, score: str, hit: str, most: int = 3) -> DataFrame:
    """Best score, number of hits and the best few hits of each group."""
    n = F.row_number().over(Window.partitionBy(*by, group).orderBy(F.desc(score), hit))
    r = rows.withColumn("_n", n)
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", hit)))), lambda x: x[hit].cast("string")), ",")
    return r.groupBy(*by, group).agg(F.max(score).alias("best"), F.count("*").alias("hits"), top.alias("top"))


def facets(rows: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """Counts of every value of some columns, the most frequent ones of each: field, value, n."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")).select("f.*")
    counted = pairs.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    return first_per(counted, ["field"], [F.desc("n"), "value"], most)
