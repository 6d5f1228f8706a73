"""A persisted inverted index: postings in blocks with score bounds, written once, read by every query, updated by changed documents.

Chunks are dealt into ranges (a cluster of similar documents, and a hash bucket of documents inside it) and numbered there. A block holds one term's postings
in one range as arrays, and the largest frequency and least length among them: no chunk of the range can score more for this term, whatever k1, b and the
corpus' mean length are. Blocks lie in folders by a hash of the term. A search sums these bounds by query and range, scores each query's most promising
ranges, and then only those others whose bound reaches the k-th best score so far.

Updates write a new generation of the ranges that they touch. A range counts by its last generation, and a generation by its table of ranges, which is written last.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexmill.functions import text as T
from lexmill.operators.ranking import ranked, small
from lexmill.storage import folders, settled

#: Folders of terms.
BUCKETS = 32
#: Queries that one task scores against a range at a time.
QUERY_BLOCK = 1024
#: Bounds are compared with scores of six decimals.
_SLACK = 2e-6


_SCHEMAS = {
    "layout": "cluster string, first long, buckets long, generation int",
    "ranges": "range long, field string, docs long, total long, generation int",
    "blocks": "field string, term string, range long, n long, slots array<int>, tfs array<int>, lengths array<int>, most int, least int, generation int, bucket int",
}


class Index(NamedTuple):
    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        """Chunks have columns of their own: the schema of their first generation, since one without rows tells none."""
        schema = _SCHEMAS.get(name) or self.spark.read.parquet(f"{self.path}/{name}/generation=0").schema.add("generation", IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def layout(self) -> DataFrame:
        """cluster, first, buckets: which ranges a cluster's documents are dealt into."""
        return self._table("layout").select("cluster", "first", "buckets")

    @property
    def ranges(self) -> DataFrame:
        """range, generation, field, docs, total of every range's last generation; docs have the field, total is their tokens."""
        r = self._table("ranges")
        if folders(self.spark, f"{self.path}/ranges") == 1:
            return r
        last = r.groupBy("range").agg(F.max("generation").alias("generation"))
        return r.join(last, ["range", "generation"])

    def _live(self, rows: DataFrame) -> DataFrame:
        if folders(self.spark, f"{self.path}/ranges") == 1:
            return rows
        return rows.join(small(self.ranges.select("range", "generation").distinct()), ["range", "generation"], "left_semi")

    @property
    def chunks(self) -> DataFrame:
        """range, slot and the columns of the chunks."""
        return self._live(self._table("chunks")).drop("generation")

    @property
    def blocks(self) -> DataFrame:
        """field, bucket, term, range, n, slots, tfs, lengths, most (tf), least (length)."""
        return self._live(self._table("blocks")).drop("generation")


class _Asked(NamedTuple):
    """An index as some queries see it: only the blocks of their terms, read from the folders once."""

    index: Index
    blocks: DataFrame

    @property
    def ranges(self) -> DataFrame:
        return self.index.ranges


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _cluster(column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def _blocks(rows: pa.Table) -> pa.Table:
    """The blocks of one range from its chunks' tokens (range, slot, field, tokens)."""
    found = []
    for field in dict.fromkeys(rows["field"].to_pylist()):
        own = rows.filter(pc.equal(rows["field"], field))
        lists = own["tokens"].combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        slot = own["slot"].to_numpy()
        coded = lists.flatten().dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | np.repeat(slot, length)
        key, tf = np.unique(key, return_counts=True)
        term, at = key >> 32, key & 0xFFFFFFFF
        sizes = np.zeros(int(slot.max()) + 1, np.int32)
        sizes[slot] = length
        head = np.flatnonzero(np.r_[True, np.diff(term) != 0])
        edge = np.r_[head, len(term)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (at, tf, sizes[at])]
        found.append(
            pa.table(
                [
                    pa.array([field] * len(head)), coded.dictionary.take(pa.array(term[head])), pa.array(np.full(len(head), rows["range"][0].as_py(), np.int64)),
                    pa.array(np.diff(edge).astype(np.int64)), *lists, pa.array(np.maximum.reduceat(tf, head).astype(np.int32)), pa.array(np.minimum.reduceat(sizes[at], head)),
                ],
                ["field", "term", "range", "n", "slots", "tfs", "lengths", "most", "least"],
            )
        )
    return pa.concat_tables(found)


def _write(index: Index, placed: DataFrame, fields: tuple[str, ...], generation: int, every: DataFrame | None = None) -> None:
    """placed: chunks with their range. every(range): ranges that this generation replaces, though nothing is left of them."""
    slot = F.row_number().over(Window.partitionBy("range").orderBy("chunk_id")) - 1
    numbered = placed.withColumn("slot", slot.cast("int"))
    numbered.write.parquet(f"{index.path}/chunks/generation={generation}")
    own = index.spark.read.schema(numbered.schema).parquet(f"{index.path}/chunks/generation={generation}")
    kinds = F.array(*(F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("tokens")) for f in fields))
    t = own.select("range", "slot", F.inline(kinds)).where(F.size("tokens") > 0)
    blocks = t.groupBy("range").applyInArrow(_blocks, "field string, term string, range long, n long, slots array<int>, tfs array<int>, lengths array<int>, most int, least int")
    blocks = blocks.withColumn("bucket", _bucket())
    blocks.repartition("bucket").sortWithinPartitions("bucket", "field", "term", "range").write.partitionBy("bucket").parquet(f"{index.path}/blocks/generation={generation}")
    written = index.spark.read.schema(_SCHEMAS["blocks"]).parquet(f"{index.path}/blocks/generation={generation}")
    tokens = written.groupBy("range", "field").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda n, x: n + x)).alias("total"))
    has = own.groupBy("range").agg(F.array(*(F.struct(F.lit(f).alias("field"), F.count(f).alias("docs")) for f in fields)).alias("x")).select("range", F.inline("x"))
    totals = has.join(tokens, ["range", "field"], "left").select("range", "field", "docs", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    if every is not None:
        gone = every.join(totals.select("range").distinct(), "range", "left_anti")
        totals = totals.unionByName(gone.select("range", F.lit(fields[0]).alias("field"), F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("total")))
    totals.coalesce(1).write.parquet(f"{index.path}/ranges/generation={generation}")


def _placed(index: Index, chunks: DataFrame, cluster: str | None) -> DataFrame:
    c = chunks.withColumn("cluster", _cluster(cluster)).join(small(index.layout), "cluster")
    return c.select(*chunks.columns, (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("buckets"))).alias("range"))


def build(chunks: DataFrame, path: str, fields: tuple[str, ...] = ("content",), cluster: str | None = None, range_rows: int = 512) -> Index:
    """Writes the index of chunks(chunk_id, doc_id, fields, ...) to a new folder. chunk_id is unique; other columns are kept beside.

    cluster: a column whose equal values lie together, so that whole ranges don't concern a query. range_rows: chunks of a range, about; a document's chunks
    lie in one range, so that a document is replaced by writing few of them. A null field is none.
    """
    index = Index(chunks.sparkSession, path)
    chunks = settled(chunks, "chunks")  # cut once, then counted and placed
    sizes = chunks.groupBy(_cluster(cluster).alias("cluster")).agg(F.ceil(F.count("*") / range_rows).cast("long").alias("buckets"))  # one row a cluster
    before = F.sum("buckets").over(Window.orderBy("cluster")) - F.col("buckets")
    sizes.select("cluster", before.alias("first"), "buckets").write.parquet(f"{path}/layout/generation=0")
    _write(index, _placed(index, chunks, cluster), fields, 0)
    return index


def update(index: Index, changed: DataFrame, doc_ids: DataFrame, fields: tuple[str, ...] = ("content",), cluster: str | None = None, range_rows: int = 512) -> int:
    """Replaces the documents doc_ids(doc_id): their chunks go, and those in changed (columns as in ``build``) come. -> number of ranges written anew.

    Documents that are only in doc_ids are deleted, those only in changed are new. Other ranges stay as they are.
    """
    generation = index._table("ranges").agg(F.max("generation")).first()[0] + 1
    known, top = index.layout, index.layout.agg(F.coalesce(F.max(F.col("first") + F.col("buckets")), F.lit(0))).first()[0]
    new = changed.groupBy(_cluster(cluster).alias("cluster")).agg(F.ceil(F.count("*") / range_rows).cast("long").alias("buckets")).join(known, "cluster", "left_anti")
    first = F.lit(top) + F.sum("buckets").over(Window.orderBy("cluster")) - F.col("buckets")
    new = settled(new.select("cluster", first.alias("first"), "buckets"), "layout")
    if not new.isEmpty():
        new.write.parquet(f"{index.path}/layout/generation={generation}")
    placed = settled(_placed(index, changed, cluster), "changed")
    gone = doc_ids.select("doc_id").unionByName(placed.select("doc_id")).distinct()
    old = index.chunks
    touched = old.join(gone, "doc_id", "left_semi").select("range").unionByName(placed.select("range")).distinct()
    touched = settled(touched, "touched")
    kept = old.join(small(touched), "range", "left_semi").join(gone, "doc_id", "left_anti").drop("slot")
    _write(index, kept.select(*placed.columns).unionByName(placed), fields, generation, touched)
    return touched.count()


def _part(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    return tf / (tf + k1 * (1 - b + b * length / average))


def weighed(index: Index, queries: DataFrame, k1: float, boosts: dict[str, float]) -> DataFrame:
    """queries(query_id, text) -> query_id, field, bucket, term, weight, average, for the terms that the index has."""
    terms = queries.select("query_id", F.explode(T.distinct_tokens(F.col("text"))).alias("term")).withColumn("bucket", _bucket())
    heads = index.blocks.where(F.col("field").isin(*boosts)).select("field", "bucket", "term", "n").join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    totals = index.ranges.where(F.col("field").isin(*boosts)).groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("total") / F.sum("docs")).alias("average"))  # a row a field
    df = heads.groupBy("field", "bucket", "term").agg(F.sum("n").alias("df"))
    boost = F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair))[F.col("field")]
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = terms.join(df, ["bucket", "term"]).join(F.broadcast(totals), "field")
    return settled(found.select("query_id", "field", "bucket", "term", (boost * idf * (k1 + 1)).alias("weight"), "average"), "weights")


def bounds(index: Index, weights: DataFrame, k1: float, b: float, groups: DataFrame | None = None) -> DataFrame:
    """query_id, group (of groups(range, group)), range, bound, place in the group: what no chunk of the range can exceed for the query, for all pairs that share a term, the most promising range first."""
    each = index.blocks.select("field", "bucket", "term", "range", "most", "least").join(weights, ["field", "bucket", "term"])
    part = F.col("weight") * _part(F.col("most"), F.col("least"), F.col("average"), k1, b)
    each = each.groupBy("query_id", "range", "field").agg(F.sum(part).alias("bound")).groupBy("query_id", "range").agg(F.max("bound").alias("bound"))
    each = each.withColumn("group", F.lit("")) if groups is None else each.join(groups, "range")
    return settled(ranked(each, "bound", ["range"], ["query_id", "group"], name="place"), "bounds")


def _best_slots(k: int, k1: float, b: float, kind: pa.DataType):
    """The k best slots of a range for each of a block of queries: one matrix of queries by slots for each field, to which each term adds an outer product."""
    names = ["range", "query_id", "slot", "score"]

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), kind, pa.int32(), pa.float64())], names)
        ids = asked["query_id"].combine_chunks()
        coded = ids.dictionary_encode()
        query, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        fields, terms = blocks["field"].to_pylist(), blocks["term"].to_pylist()
        at = {x: i for i, x in enumerate(zip(fields, terms))}
        flat = {c: blocks[c].combine_chunks() for c in ("slots", "tfs", "lengths")}
        edge = flat["slots"].offsets.to_numpy()
        slots, tfs, lengths = (flat[c].values.to_numpy() for c in ("slots", "tfs", "lengths"))
        width = int(slots[edge[0] : edge[-1]].max()) + 1
        best = np.zeros((n, width))
        weight, average = asked["weight"].to_numpy(), asked["average"].to_numpy()
        rows: dict[tuple[str, str], list[int]] = {}
        for i, x in enumerate(zip(asked["field"].to_pylist(), asked["term"].to_pylist())):
            if x in at:
                rows.setdefault(x, []).append(i)
        for field in dict.fromkeys(f for f, _ in rows):
            total = np.zeros((n, width))
            for (f, term), own in rows.items():
                if f == field:
                    low, high = edge[at[f, term]], edge[at[f, term] + 1]
                    tf = tfs[low:high].astype(np.float64)
                    part = tf / (tf + k1 * (1 - b + b * lengths[low:high] / average[own[0]]))
                    total[np.ix_(query[own], slots[low:high])] += np.outer(weight[own], part)
            best = np.maximum(best, total)
        out = []
        shown = np.round(best, 6)
        for q in range(n):
            found = np.flatnonzero(best[q] > 0)
            if len(found) > k:
                worst = np.partition(shown[q, found], len(found) - k)[len(found) - k]
                found = found[shown[q, found] >= worst]  # ties stay until chunk ids decide
            out.append((q, found))
        counts = [len(f) for _, f in out]
        picked = np.concatenate([f for _, f in out]).astype(np.int32)
        of = np.repeat(np.arange(n), counts)
        return pa.table(
            [pa.array(np.full(len(picked), blocks["range"][0].as_py(), np.int64)), coded.dictionary.take(pa.array(of)), pa.array(picked), pa.array(best[of, picked])], names
        )

    return run


def scored(index: Index, pairs: DataFrame, weights: DataFrame, queries: int, k: int, k1: float, b: float) -> DataFrame:
    """pairs(query_id, range) -> query_id, range, slot, score: each pair's k best chunks and those of equal score. A task holds one range and a block of queries;
    queries: how many there are."""
    kind = dict(pairs.dtypes)["query_id"]
    blocks = max(1, -(-queries // QUERY_BLOCK))
    p = pairs.select("query_id", "range", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part"))
    asked = p.join(weights, "query_id")
    wanted = asked.select("field", "bucket", "term", "range", "part").distinct()
    own = index.blocks.join(wanted, ["field", "bucket", "term", "range"])
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fresh = lambda df, *columns: df.select(*columns).toDF(*columns).groupBy("range", "part")  # noqa: E731  both sides come from one table
    left = fresh(own, "range", "part", "field", "term", "slots", "tfs", "lengths")
    right = fresh(asked, "range", "part", "query_id", "field", "term", "weight", "average")
    return left.cogroup(right).applyInArrow(_best_slots(k, k1, b, arrow), f"range long, query_id {kind}, slot int, score double")


def survivors(every: DataFrame, hits: DataFrame, k: int, pilot: int) -> DataFrame:
    """The (query_id, group, range) behind each query's ``pilot`` first ones of a group whose bound reaches the k-th best of their hits, and so may hold one of the k best."""
    last = ranked(hits, "score", ["range", "slot"], ["query_id", "group"]).where(F.col("rank") == k).select("query_id", "group", F.col("score").alias("reached"))
    rest = every.where(F.col("place") > pilot).join(last, ["query_id", "group"], "left").where(F.col("bound") + _SLACK >= F.coalesce("reached", F.lit(0.0)))
    return rest.select("query_id", "group", "range")


def search(
    index: Index, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, boosts: dict[str, float] | None = None, columns: tuple[str, ...] = (), pilot: int = 2,
    per: str | None = None,
) -> DataFrame:
    """queries(query_id, text) -> query_id, chunk_id, columns, score, rank: the top k of each, as a scan of all chunks would give.

    pilot: ranges of each query that are scored before any is skipped. boosts: fields and their weights (content alone by default); a chunk scores as its best field does. Ties by chunk_id. A query without a known
    term has no rows. per: a column that the index's clusters don't mix; then each query has its top k in each of its values, and a rank there, by the statistics of the whole index.
    """
    boosts = boosts or {"content": 1.0}
    terms = queries.select(F.explode(T.distinct_tokens(F.col("text"))).alias("term")).distinct().withColumn("bucket", _bucket())
    asked = _Asked(index, settled(index.blocks.where(F.col("field").isin(*boosts)).join(small(terms), ["bucket", "term"], "left_semi"), "blocks"))
    weights = weighed(asked, queries, k1, boosts)
    groups = index.chunks.groupBy("range").agg(F.first(per).cast("string").alias("group")) if per else None  # a row a range
    every = bounds(asked, weights, k1, b, groups)
    size = every.agg(F.count_distinct("query_id").alias("queries"), F.max("place").alias("ranges")).first()
    score = lambda pairs: scored(asked, pairs, weights, size["queries"], k, k1, b)
    named = lambda hits: hits.withColumn("group", F.lit("")) if groups is None else hits.join(groups, "range")
    hits = named(score(every.where(F.col("place") <= pilot).select("query_id", "range")))
    if (size["ranges"] or 0) > pilot:
        hits = settled(hits, "pilot")
        hits = hits.unionByName(named(score(survivors(every, hits, k, pilot).select("query_id", "range"))))
    hits = hits.withColumn("score", F.round("score", 6))
    close = F.rank().over(Window.partitionBy("query_id", "group").orderBy(F.desc("score")))
    found = settled(hits.withColumn("place", close).where(F.col("place") <= k).drop("place"), "hits")
    rows = index.chunks.select("range", "slot", "chunk_id", *columns).join(found, ["range", "slot"])
    top = ranked(rows.select("query_id", "group", "chunk_id", *columns, "score"), "score", ["chunk_id"], ["query_id", "group"], k)
    return top.withColumnRenamed("group", "per") if per else top.drop("group")
