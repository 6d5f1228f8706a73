"""Operators against small independent models, edge cases, and streams against their batch twins."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import answers, evaluation, ranking
from lexmill.operators.changes import latest, snapshot_diff, upsert
from lexmill.plans.relations import containments
from lexmill.streaming import upserts, windows

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalize_is_casefold_and_isalnum(spark):
    for text in ["Straße GROSS", "a_b-c  d", "Ñandú №5", "", "…", "Привет, МИР!"]:
        folded = "".join(c if c.isalnum() else " " for c in text.casefold())
        assert one(spark, T.normalize(F.col("t")), t=text) == " ".join(folded.split())


def test_dates_values_hash(spark):
    text = "31.02.2020 and 5.3.2021, 2021-03-05, 7 мая 1999"
    assert one(spark, T.dates(F.col("t")), t=text) == ["2021-03-05", "1999-05-07"]
    assert one(spark, T.values(F.col("t")), t="12.03.21 1999 3,5 1999") == ["12.03.21", "1999", "3,5"]
    assert one(spark, T.stable_hash(F.col("a"), F.col("b"), length=40), a="x", b=None) == hashlib.sha1(b"x\x1fNone\x1f").hexdigest()


def test_language_ties_and_none(spark):
    assert tuple(one(spark, T.script_language(F.col("t")), t="аб ab")) == ("ru", 0.5)
    assert tuple(one(spark, T.script_language(F.col("t")), t="123")) == ("und", 0.0)


def test_bm25_against_model(spark):
    docs = {"a": "the cat sat on the mat", "b": "a cat and a dog", "c": "nothing here", "d": ""}
    found = ranking.bm25(spark.createDataFrame(list(docs.items()), "chunk_id string, content string"), spark.createDataFrame([(1, "cat the")], "query_id long, text string")).collect()
    n, lengths = len(docs), {k: len(v.split()) for k, v in docs.items()}
    average = sum(lengths.values()) / n

    def score(doc):
        s = 0.0
        for term in ("cat", "the"):
            df, tf = sum(term in v.split() for v in docs.values()), docs[doc].split().count(term)
            s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[doc] / average)) if tf else 0
        return round(s, 6)

    assert [(r["chunk_id"], r["score"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [("a", score("a"), 1), ("b", score("b"), 2)]


def test_knn_blocks_equal_one_block(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ranking.knn(e, q, 5, block=7).select("query_id", "vec_id", "rank")) == rows(ranking.knn(e, q, 5).select("query_id", "vec_id", "rank"))


def test_rrf_and_ties(spark):
    lanes = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (1, "y", 2)], "query_id long, chunk_id string, rank long")
    r = {x["chunk_id"]: (x["score"], x["rank"]) for x in ranking.rrf(lanes, ["query_id"], ["chunk_id"]).collect()}
    assert r == {"y": (round(1 / 61 + 1 / 62, 9), 1), "x": (round(1 / 61, 9), 2)}


def test_metrics_hand_case(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, doc_id long, rank long")
    gold = spark.createDataFrame([(1, 20), (2, 30)], "query_id long, doc_id long")
    m = {r["query_id"]: r for r in evaluation.retrieval_metrics(results, gold).collect()}
    assert (m[1]["recall_1"], m[1]["recall_5"], m[1]["mrr"], m[1]["ndcg"]) == (0.0, 1.0, 0.5, round(1 / np.log2(3), 6))
    assert (m[2]["recall_10"], m[2]["mrr"], m[2]["ndcg"]) == (0.0, 0.0, 0.0)


def test_rouge_and_f1(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(1)
    for _ in range(6):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(1, 15))] for _ in range(2))
        assert abs(one(spark, evaluation.rouge_l("a", "b"), a=a, b=b) - 2 * lcs(a, b) / (len(a) + len(b))) < 1e-9
    assert one(spark, evaluation.token_f1(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "z"]) == 0.4
    assert one(spark, evaluation.rouge_l("a", "b"), a=[], b=[]) == 1.0


def test_claims(spark):
    claims = spark.createDataFrame([("c1", "alpha beta gamma delta", ["e1"]), ("c2", "alpha omega", ["e1"]), ("c3", "nothing shared", ["e1"]), ("c4", "alpha", None), ("c5", "alpha", ["e9"])], "claim_id string, text string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "Alpha, beta; gamma")], "evidence_id string, text string")
    got = {r["claim_id"]: (r["status"], r["confidence"]) for r in answers.claim_support(claims, evidence).collect()}
    assert got == {"c1": ("supported", 0.75), "c2": ("partially_supported", 0.45), "c3": ("unsupported", 0.8), "c4": ("unsupported", 0.9), "c5": ("unsupported", 0.9)}


def test_containments_short_and_long(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "x two three y"), (3, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "ne two three four five six seven ei"), (2, "x two three"), (3, "zz two three")], "query_id long, text string")
    assert sorted(map(tuple, containments(docs, passages).select("query_id", "doc_id").collect())) == [(1, 1), (2, 2)]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, h string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, h string")
    assert dict(map(tuple, snapshot_diff(old, new, "k", "h").select("k", "change").collect())) == {1: "tombstone", 2: "changed", 3: "skipped", 4: "new"}
    assert sorted(map(tuple, upsert(old, new, ["k"], "h").collect()), key=lambda r: r[0]) == [(1, "a"), (2, "c"), (3, None), (4, "d")]


def stream_of(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stream_of(spark, e.unionByName(e.where("event_id % 23 = 0")), f"{tmp_path}/in")
    cases = {
        "tumbling": (windows.windowed(stream, "1 hour", delay="60 days"), windows.windowed(e.unionByName(e.where("event_id % 23 = 0")), "1 hour"), "complete"),
        "dedup": (windows.first_events(stream, "60 days").select("event_id"), e.select("event_id"), "append"),
    }
    for name, (streaming, batch, mode) in cases.items():
        q = streaming.writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"s_{name}").collect())) == sorted(map(tuple, batch.collect()))


def test_change_stream(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("seq"), (F.col("id") * 7).alias("v"))
    stream = stream_of(spark, rows, f"{tmp_path}/in")
    upserts.apply_changes(stream, f"{tmp_path}/out", "k", "seq").awaitTermination(120)
    now = sorted(map(tuple, upserts.current(spark, f"{tmp_path}/out", "k", "seq").select("k", "seq", "v").collect()))
    assert now == sorted(map(tuple, latest(rows, ["k"], [F.desc("seq")]).collect()))
