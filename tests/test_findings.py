"""Faults that showed on larger tables only, on small tables that would have shown them."""

import hashlib
import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import embedding, lookup, ranking, scan, selection
from lexmill.operators.chunking import word_chunks
from lexmill.plans import catalog, relations
from lexmill.storage import new_folder

SF = "/root/testdata/sf0.001"


def test_names_of_a_long_text_take_one_pass(spark):
    words = [f"Name{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(4000)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, "NAMEaaa Nameaaa The -Nameaab- nameaac Name-aad"), (3, ""), (4, None)], "id long, text string")
    began = time.time()
    found = {r["id"]: r["n"] for r in d.select("id", T.names(F.col("text")).alias("n")).collect()}
    assert time.time() - began < 20  # every word against all words took minutes
    assert found == {1: words[:10], 2: ["NAMEaaa", "Nameaab", "Name-aad"], 3: [], 4: None}


def test_latency_rounds_as_the_sql_does(spark):
    """1.005 lies below its digits: times 100 it rounds down, by its decimal digits up, which changes the order."""
    at = new_folder(spark, "orders").removeprefix("file://")
    rows = [(3 * i, 1, "O", price, "1-URGENT") for i, price in enumerate([1005.0, 1004.0, 1009.0, 8.5e3 + 0.325e3, 2675.0, 2674.0, 1115.0, 1114.0, 4.35e3, 1.115e5, 1.1149e5], 1)]
    rows += [(3 * (100 + i), 1, "O", i * 10.0 + 5.0, "1-URGENT") for i in range(2000)] + [(3 * (5000 + i), 1, "O", i * 10.0 + 10.0, "1-URGENT") for i in range(2000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{at}/orders.parquet/*.parquet'")
    want = sorted(con.sql(catalog.ORACLE_SQL["d_priority"]).fetchall())
    assert sorted((r["config"], r["task_id"], r["place"]) for r in catalog.QUERIES["d_priority"](spark, f"file://{at}").collect()) == want


SCHEMA = "chunk_id string, doc_id long, lang string, title string, content string"


def corpus(seed, docs=80):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        lang = rng.choice(["a", "b", None])
        words = [f"{lang}{k}" for k in range(40)] + ["the", "of"] * 8
        for n in range(rng.randint(1, 4)):
            text = " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))
            rows.append((f"{d:03d}-{n}", d, lang, None if d % 5 == 0 else " ".join(rng.choices(words, k=3)), None if d % 17 == 3 else text))
    return rows + [(f"copy{i:03d}", 1000 + i, "a", "a1", "a1 a2 a2 of") for i in range(50)]


@pytest.mark.parametrize("cells", [scan.CELLS, 40])
def test_one_pass_ranks_as_bm25(spark, monkeypatch, cells):
    """Also where blocks hold a query or two, slices few chunks, and ties are more than k."""
    monkeypatch.setattr(scan, "CELLS", cells)
    c = spark.createDataFrame(corpus(1), SCHEMA).repartition(3)
    texts = ["a1 a2 the", "b0 b30 of the", "none0 the", "zzz", "", None, "a39 b39 a38 b38 the of", "the the of"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    rows = lambda df, *by: sorted((r["query_id"], *(str(r[x]) for x in by), r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    boosts = {"title": 3.0, "content": 1.0}
    t = scan.tokenized(c, tuple(boosts))
    for k in (1, 7, 500):
        assert rows(scan.search(t, q, k)) == rows(ranking.bm25(c.select("chunk_id", "content"), q, k))
        assert rows(scan.search(t, q, k, 2.0, 0.3, boosts)) == rows(ranking.bm25(c.select("chunk_id", *boosts), q, k, 2.0, 0.3, boosts))
    every = ranking.bm25(c.select("chunk_id", "content"), q, 10_000).drop("rank").join(c.select("chunk_id", "lang"), "chunk_id")
    assert rows(scan.search(t, q, 3, per="lang"), "per") == rows(ranking.ranked(every, "score", ["chunk_id"], ["query_id", "lang"], 3), "lang")
    assert scan.search(t, q.limit(0)).count() == 0 == scan.search(t.limit(0), q).count()


def test_too_many_terms_take_the_index(spark, monkeypatch):
    want = sorted(map(tuple, catalog.QUERIES["d_pack_context"](spark, SF).collect()))
    monkeypatch.setattr(scan, "WEIGHTS", 5)
    assert sorted(map(tuple, catalog.QUERIES["d_pack_context"](spark, SF).collect())) == want


def test_lexical_queries_shuffle_no_texts(spark):
    """The build of the inverted index shuffled every text and every posting."""
    plan = scan.tokenized(relations.fielded(spark, SF), tuple(relations.FIELDS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    docs = spark.createDataFrame([(1, "s", " ".join(f"w{i}" for i in range(441))), (2, "s", " "), (3, "s", None), (4, "s", "one")], "doc_id long, source string, text string")
    assert [(r["doc_id"], r["ordinal"], r["n_words"]) for r in word_chunks(docs).orderBy("doc_id", "ordinal").collect()] == [(1, 0, 220), (1, 1, 220), (1, 2, 1), (4, 0, 1)]


def test_nearest_vectors_are_matrix_products(spark):
    """Each pair was scored by a lambda over 64 numbers. Copies tie, a value of ``by`` may be null, a vector may be null."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] if i % 9 else None, rng.choice(["a", "b", None])) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, g string")
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q")
    found = ranking.knn(v, q, 5, block=7, by=("g",), slice_rows=10)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for a, x, _ in rows:
        for g in ("a", "b", None):
            scored = [(-sum(m * n for m, n in zip(x, y)), b) for b, y, h in rows if y and h == g] if a % 10 == 0 and x else []
            want += [(a, str(g), b, -s, n) for n, (s, b) in enumerate(sorted(p for p in scored if p[0] < 0)[:5], 1)]
    assert sorted((r["query_id"], str(r["g"]), r["vec_id"], r["score"], r["rank"]) for r in found.collect()) == sorted(want)


def test_similar_questions_meet_by_signatures_of_many_tokens(spark):
    """They met by single words of the prefix filter: pairs that share a word of a small vocabulary grow with the square of the table."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(300):
        t = rng.sample(words, rng.choice([1, 3, 6, 7, 8, 9, 12, 13, 20, 24, 40, 90, 150]))
        for _ in range(rng.choice([1, 1, 3, 6])):  # the text, copies in another order, and near ones on both sides of the bound
            near = [w for w in t if rng.random() > 0.05] + rng.sample(words, rng.choice([0, 0, 1, 2]))
            rng.shuffle(near)
            rows.append((rng.choice(["a", "a", "b"]), rng.choice([t, near, near])))
    rows = [(g, i, " ".join(t)) for i, (g, t) in enumerate(rows)] + [("a", 5000, ""), ("a", 5001, None), (None, 5002, "w1"), (None, 5003, "w1")]
    q = spark.createDataFrame(rows, "g string, i long, t string")
    want, kept, near = set(), {}, set()
    for g, i, t in rows:
        s = set((t or "").split())
        close = [k for k, x in kept.setdefault(g, []) if g and s | x and len(s & x) / len(s | x) > 0.86]
        near |= {(g, k, i) for k in close}
        if not close:
            kept[g].append((i, s))
            want.add((g, i))
    assert sorted((r["g"] or "", r["i"]) for r in selection.fresh_questions(q, "g", "i", "t").collect()) == sorted((g or "", i) for g, i in want) and len(near) > 50
    same = spark.createDataFrame([(g, i, f"{w} b c d e f g h i") for g, i, w in [("a", 1, "x y z"), ("a", 1, "u v"), ("a", 1, "j k l m n o p"), ("a", 1, "j k l m n o p q"), ("b", 1, "u v")]], "g string, i long, t string")
    assert [r["g"] for r in selection.fresh_questions(same, "g", "i", "t").orderBy("g").collect()] == ["a", "a", "a", "b"]  # several questions of one key
    different = {}
    for g, i, t in rows:
        if g and t:
            different.setdefault((g, frozenset(t.split())), i)
    sets = [(g, i, s) for (g, s), i in different.items()]
    pairs = {(g, min(i, j), max(i, j)) for n, (g, i, s) in enumerate(sets) for h, j, x in sets[:n] if g == h and len(s & x) / len(s | x) > 0.86}
    d = spark.createDataFrame([(g, i, list(s)) for g, i, s in sets], "g string, i long, t array<string>")
    assert {tuple(r) for r in selection.similar(d, "g", "i", 0.86).collect()} == pairs and len(pairs) > 50
    assert {tuple(r)[1:] for r in selection.similar(d, "g", "i", 0.6).where("g = 'b'").collect()} >= {p[1:] for p in pairs if p[0] == "b"}


def test_unlike_questions_make_no_candidates(spark):
    """2,000 sets of 24 of 300 words: almost every two share one of their rarest four words with thousands of others."""
    rng = random.Random(6)
    d = spark.createDataFrame([("a", i, rng.sample([f"w{k}" for k in range(300)], 24)) for i in range(2000)], "g string, i long, t array<string>")
    signed = d.select("g", "i", F.transform("t", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(selection._signatures(0.86), "g string, i long, sig long")
    assert signed.groupBy("sig").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0] < 2000
    assert signed.count() < 50 * 2000


def test_hashed_embedding_is_one_pass(spark, monkeypatch):
    """Every token of every text was shuffled twice, to be counted and to meet its hash. Also with slices of a row or two, and with a memory of few tokens."""
    monkeypatch.setattr(embedding, "CELLS", 100)
    monkeypatch.setattr(embedding, "KEPT", 3)
    rng = random.Random(8)
    texts = [None, "", " -- ", "a", "a a A ä", "x y", *(" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 300))) for _ in range(60))]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = embedding.hashed_embedding(d, "id", "text", 16)
    assert "Exchange" not in embedding.hashed_embedding(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["embedding"] for r in found.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        cells = [0.0] * 16
        for w in (t or "").lower().replace("--", "").split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            cells[int.from_bytes(h[:4], "big") % 16] += 1.0 if h[4] % 2 == 0 else -1.0
        norm = math.sqrt(sum(x * x for x in cells))
        assert got[i] == pytest.approx([x / norm if norm else 0.0 for x in cells], abs=1e-6)


def test_matching_lines_leave_texts_where_they_are(spark):
    """Every text of the table was shuffled to meet a few requests."""
    d = spark.createDataFrame([(1, "Alpha beta\nnothing\n\ngamma ALPHA"), (2, "alpha"), (3, None), (4, "alpha")], "doc_id long, text string")
    r = spark.createDataFrame([(10, 1, "alpha gamma the"), (11, 1, "beta"), (12, 3, "alpha"), (13, 4, None), (14, 9, "alpha")], "request_id long, doc_id long, query string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.matching_lines(d, r)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(10, 1, 1, 1), (10, 1, 4, 2), (11, 1, 1, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
