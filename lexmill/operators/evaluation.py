"""Retrieval and answer metrics, rollups, splits and gates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import settled


def retrieval_metrics(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """results(query_id, doc_id, rank), gold(query_id, doc_id) -> query_id, gold_n, recall_k..., mrr, ndcg; zero where nothing is found."""
    size = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("gold_n"))
    once = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hit = once.join(gold.distinct(), ["query_id", "doc_id"])
    top = max(ks)
    sums = hit.where(F.col("rank") <= top).groupBy("query_id").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks),
        F.min("rank").alias("first"),
        F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold_n", F.lit(top)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    q = size.join(sums, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return q.select(
        "query_id", "gold_n", *(zero(F.col(f"hits_{k}") / F.col("gold_n")).alias(f"recall_{k}") for k in ks), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg")
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""
    common = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))
    )
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.round(2.0 * common / (F.size(a) + F.size(b)), 6))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. A column of the usual table is one integer with a bit for each token of a, and adding carries a whole run of bits at once."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    every = (1 << len(a)) - 1
    column = every
    for token in b:
        hit = column & places.get(token, 0)
        column = ((column + hit) | (column - hit)) & every
    return len(a) - column.bit_count()


def _rouge_l(a: pa.Array, b: pa.Array) -> pa.Array:
    scores = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        x, y = x or [], y or []
        scores.append(2.0 * lcs_length(x, y) / (len(x) + len(y)) if x and y else float(len(x) == len(y)))
    return pa.array(scores, pa.float64())


def rouge_l(a: str | Column, b: str | Column) -> Column:
    """F1 of the longest common subsequence of two token arrays; order-dependent, so outside Spark's expressions."""
    return F.arrow_udf(_rouge_l, "double")(a, b)


def nearest_rank(value: str, share: float) -> Column:
    """The value at rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def task_scores(found: DataFrame, gold: DataFrame, hard: DataFrame, tasks: DataFrame, margin: int = 20) -> DataFrame:
    """One row for each of tasks(query_id), with every retrieval metric of it.

    found(query_id, rank, before, score, page_id, chunk_id): the final list; before is a chunk's rank ahead of reranking. gold(query_id, page_id, chunk_id), hard(query_id, page_id).
    page_recall_k and chunk_recall_k count distinct gold pages and chunks among the first k; document_* read the list of pages with each page once. gained: by how many ranks reranking moves the first gold chunk
    up (a missing one stands at ``margin`` + 1; null if both miss). false_positives: the share of hard negatives among the first ``margin`` pages; dangerous: those among the first
    three, above gold, of a score of a half, or of at least 0.6 times the best gold's. lead: rank of the first hard page less that of the first gold one, a missing one at ``margin`` + 1. No gold: zeros, null margins.
    """
    g_page, g_chunk = gold.select("query_id", "page_id", F.lit(1).alias("gp")).distinct(), gold.select("query_id", "chunk_id", F.lit(1).alias("gc")).distinct()
    size = gold.groupBy("query_id").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("chunk_id").alias("chunks"))
    x = found.where(F.col("rank") <= margin).join(g_page, ["query_id", "page_id"], "left").join(g_chunk, ["query_id", "chunk_id"], "left")
    x = x.join(hard.select("query_id", "page_id", F.lit(1).alias("bad")).distinct(), ["query_id", "page_id"], "left")
    first = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy("rank")) == 1
    x = x.withColumn("once", first)
    x = x.withColumn("place", F.when(F.col("once"), F.sum(F.col("once").cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))))
    best = Window.partitionBy("query_id")
    x = x.withColumns({"gold_rank": F.min(F.when(F.col("gp") == 1, F.col("rank"))).over(best), "gold_score": F.max(F.when(F.col("gp") == 1, F.col("score"))).over(best)})
    bad = (F.col("bad") == 1) & F.col("gp").isNull()
    danger = (F.col("rank") <= 3) | (F.col("rank") < F.col("gold_rank")) | (F.col("score") >= 0.5) | (F.col("score") >= 0.6 * F.col("gold_score"))
    count = lambda flag, what: F.count_distinct(F.when(flag, F.col(what)))
    gain = lambda place: F.sum(F.when(place <= 10, 1 / F.log2(place + 1)))
    in_chunks, in_pages = F.when(F.col("gc") == 1, F.col("rank")), F.when((F.col("gp") == 1) & F.col("once"), F.col("place"))
    s = x.groupBy("query_id").agg(
        *(count((F.col("gp") == 1) & (F.col("rank") <= k), "page_id").alias(f"p{k}") for k in (1, 5, 10, 20)), *(count((F.col("gc") == 1) & (F.col("rank") <= k), "chunk_id").alias(f"c{k}") for k in (5, 10, 20)),
        *(count((F.col("gp") == 1) & (F.col("place") <= k), "page_id").alias(f"d{k}") for k in (1, 5, 10)), F.min(in_chunks).alias("fc"), F.min(in_pages).alias("fp"), gain(in_chunks).alias("gc"), gain(in_pages).alias("gp"),
        F.min(F.when(F.col("gc") == 1, F.col("before"))).alias("fb"), count(bad, "page_id").alias("bad"), count(bad & danger, "page_id").alias("danger"), F.count_distinct("page_id").alias("n"),
        F.min(F.when(F.col("bad") == 1, F.col("rank"))).alias("fh"), F.min(F.when(F.col("gp") == 1, F.col("rank"))).alias("fg"),
    )
    t = tasks.select("query_id").join(size, "query_id", "left").join(s, "query_id", "left")
    share = lambda n, of: F.round(F.coalesce(F.col(n) / F.col(of), F.lit(0.0)), 6)
    ideal = lambda of: F.aggregate(F.sequence(F.lit(1), F.least(F.col(of), F.lit(10)).cast("int")), F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1))
    mrr = lambda first: F.round(F.when(F.col(first) <= 10, 1 / F.col(first)).otherwise(0.0), 6)
    ndcg = lambda gained, of: F.round(F.when(F.col(of) > 0, F.coalesce(F.col(gained), F.lit(0.0)) / ideal(of)).otherwise(0.0), 6)
    late = lambda c: F.coalesce(F.col(c), F.lit(margin + 1))
    return t.select(
        "query_id", *(share(f"p{k}", "pages").alias(f"page_recall_{k}") for k in (1, 5, 10, 20)), *(share(f"c{k}", "chunks").alias(f"chunk_recall_{k}") for k in (5, 10, 20)), mrr("fc").alias("mrr"), ndcg("gc", "chunks").alias("ndcg"),
        *(share(f"d{k}", "pages").alias(f"document_recall_{k}") for k in (1, 5, 10)), mrr("fp").alias("document_mrr"), ndcg("gp", "pages").alias("document_ndcg"),
        F.when(F.col("fc").isNotNull() | F.col("fb").isNotNull(), late("fb") - late("fc")).cast("long").alias("gained"), share("bad", "n").alias("false_positives"), share("danger", "n").alias("dangerous"),
        F.when(F.col("fg").isNotNull() | F.col("fh").isNotNull(), late("fh") - late("fg")).cast("long").alias("lead"),
    )


#: Ranks (from 1) of a group's n values.
P50, P95, FLOOR95 = "ceil(0.5 * n)", "ceil(0.95 * n)", "floor((n - 1) * 0.95) + 1"


def order_statistics(rows: DataFrame, by: list[str], value: str, **ranks: str) -> DataFrame:
    """rows(by, value) -> by, n, and the value at each rank, given in SQL by n, the number of values. Nulls are no values; groups without values have no row.

    Exact, and no group meets in one task: values are counted first, the different ones dealt out by ranges of (by, value), and running counts inside a range start
    from the totals of the ranges before.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ranged = settled(counted.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "part").agg(F.sum("c").alias("t"))  # a row a group and range
    group = Window.partitionBy(*by)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*by, "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"), F.sum("t").over(group).alias("n"))
    wanted = F.array(*(F.expr(f"cast({r} as bigint)") for r in ranks.values()))
    ahead = ahead.withColumn("ranks", wanted).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("part").alias("_part"), "ahead", "n", "ranks")
    same = F.col("part") == F.col("_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    high = F.col("ahead") + F.sum("c").over(Window.partitionBy("part", *by).orderBy(value))
    x = ranged.join(ahead, same).withColumn("high", high)
    holds = lambda k: (F.col("high") - F.col("c") < F.col("ranks")[k]) & (F.col("ranks")[k] <= F.col("high"))
    return x.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(holds(k), F.col(value))).alias(name) for k, name in enumerate(ranks)))


def apportion(families: DataFrame, total: int) -> DataFrame:
    """families(family, weight, place) -> family, n: whole numbers that add up to total, by largest remainder, ties by place."""
    everything = Window.partitionBy()
    raw = F.col("weight") * total / F.sum("weight").over(everything)
    f = families.withColumn("raw", raw).withColumn("base", F.floor("raw"))
    f = f.withColumn("left", total - F.sum("base").over(everything))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), "place"))
    return f.withColumn("k", rank).select("family", (F.col("base") + (F.col("k") <= F.col("left")).cast("int")).cast("long").alias("n"))


def hashed_split(tasks: DataFrame, by: list[str], key: Column, share: float) -> DataFrame:
    """The first share of each stratum in the order of a hash is dev, the rest test."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(F.md5(key.cast("string").cast("binary"))))
    n = F.count("*").over(w)
    return tasks.withColumn("split", F.when(k <= F.ceil(n * share), "dev").otherwise("test"))
