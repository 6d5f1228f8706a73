"""The persisted index against ranking without one: same rows, blocks skipped, documents replaced."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import inverted, ranking
from lexmill.storage import new_folder

SCHEMA = "chunk_id string, doc_id long, lang string, title string, content string"
FIELDS = {"title": 3.0, "content": 1.0}


def corpus(seed, docs=60, first=0):
    rng = random.Random(seed)
    rows = []
    for d in range(first, first + docs):
        lang = rng.choice(["a", "b", None])
        words = [f"{lang}{k}" for k in range(40)] + ["the", "of"] * 8
        for n in range(rng.randint(1, 4)):
            title = None if d % 5 == 0 else " ".join(rng.choices(words, k=3))
            rows.append((f"{d:03d}-{n}", d, lang, title, None if d % 17 == 3 else " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))))
    return rows


def asked(spark):
    texts = ["a1 a2 the", "b0 b30 of the", "none0 the", "zzz", "", None, "a39 b39 a38 b38 the of", "the the of"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    c = spark.createDataFrame(corpus(1), SCHEMA)
    return c, inverted.build(c, new_folder(spark, "index"), tuple(FIELDS), "lang", range_rows=8)


@pytest.mark.parametrize("k, k1, b", [(1, 1.2, 0.75), (3, 2.0, 0.3), (10, 1.2, 0.75), (500, 1.2, 1.0)])
def test_same_as_without_index(spark, built, k, k1, b):
    c, index = built
    q = asked(spark)
    assert rows(inverted.search(index, q, k, k1, b)) == rows(ranking.bm25(c.select("chunk_id", "content"), q, k, k1, b))
    assert rows(inverted.search(index, q, k, k1, b, FIELDS)) == rows(ranking.bm25(c.select("chunk_id", *FIELDS), q, k, k1, b, FIELDS))


def test_ranges_are_skipped_and_bounds_hold(spark, built):
    c, index = built
    q = asked(spark)
    weights = inverted.weighed(index, q, 1.2, {"content": 1.0})
    every = inverted.bounds(index, weights, 1.2, 0.75)
    first = every.where("place <= 2").select("query_id", "range")
    rest = inverted.survivors(every, inverted.scored(index, first, weights, 8, 2, 1.2, 0.75).withColumn("group", F.lit("")), 2, 2)
    assert first.count() + rest.count() < every.count()
    full = inverted.scored(index, every.select("query_id", "range"), weights, 8, 1, 1.2, 0.75)
    over = full.join(every, ["query_id", "range"]).where("score > bound + 1e-9")
    assert full.count() > 20 and over.count() == 0


def test_top_of_every_group(spark, built):
    c, index = built
    q = asked(spark)
    got = sorted((r["query_id"], r["per"], r["rank"], r["chunk_id"], r["score"]) for r in inverted.search(index, q, 3, per="lang").where("per is not null").collect())
    every = ranking.bm25(c.select("chunk_id", "content"), q, 10_000).drop("rank").join(c.select("chunk_id", "lang"), "chunk_id").where("lang is not null")
    want = ranking.ranked(every, "score", ["chunk_id"], ["query_id", "lang"], 3)
    assert got == sorted((r["query_id"], r["lang"], r["rank"], r["chunk_id"], r["score"]) for r in want.collect())


def test_search_reads_only_the_folders_of_its_terms(spark, built):
    _, index = built
    plan = index.blocks.where(F.col("bucket").isin(3)).select("n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_documents_replaced(spark):
    old = corpus(2)
    c = spark.createDataFrame(old, SCHEMA)
    index = inverted.build(c, new_folder(spark, "index"), tuple(FIELDS), "lang", range_rows=8)
    ranges = index.ranges.select("range").distinct().count()
    new = [r for r in corpus(3, docs=3)] + [(f"9{r[0]}", r[1] + 900, "new language", r[3], r[4]) for r in corpus(4, docs=2)]
    changed, gone = {r[1] for r in new}, {7, 8}
    written = inverted.update(index, spark.createDataFrame(new, SCHEMA), spark.createDataFrame([(i,) for i in changed | gone | {12345}], "doc_id long"), tuple(FIELDS), "lang", 8)
    assert 0 < written < ranges
    now = [r for r in old if r[1] not in changed | gone] + new
    want = spark.createDataFrame(now, SCHEMA)
    q = asked(spark)
    assert rows(inverted.search(index, q, 10, boosts=FIELDS)) == rows(ranking.bm25(want.select("chunk_id", *FIELDS), q, 10, fields=FIELDS))
    assert sorted(r["chunk_id"] for r in index.chunks.collect()) == sorted(r[0] for r in now)
    # a range that nothing is left of, and a second generation
    inverted.update(index, spark.createDataFrame([], SCHEMA), spark.createDataFrame([(r[1],) for r in now if r[2] == "b"], "doc_id long"), tuple(FIELDS), "lang", 8)
    left = spark.createDataFrame([r for r in now if r[2] != "b"], SCHEMA)
    assert rows(inverted.search(index, q, 5)) == rows(ranking.bm25(left.select("chunk_id", "content"), q, 5))


def test_empty_index_and_queries(spark, built):
    none = inverted.build(spark.createDataFrame([], SCHEMA), new_folder(spark, "index"), tuple(FIELDS))
    assert inverted.search(none, asked(spark)).count() == 0
    assert inverted.search(built[1], asked(spark).limit(0)).count() == 0


def test_queries_share_the_index(spark, tmp_path):
    from lexmill.plans import relations

    sf = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(30).write.parquet(f"{sf}/documents.parquet")
    a = relations.corpus_index(spark, sf)
    assert relations.corpus_index(spark, sf) is a
    docs.limit(40).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    b = relations.corpus_index(spark, sf)
    assert b is not a and b.chunks.select("doc_id").distinct().count() == 40
