"""Selection, search in steps and research records against small models."""

import re

from pyspark.sql import functions as F

from lexmill.operators import research as R
from lexmill.operators.selection import fresh_questions, negative_titles, select_context


def column(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", f(F.col("t")).alias("x")).orderBy("i")
    return [r["x"] for r in rows.collect()]


def test_negative_titles(spark):
    got = column(spark, negative_titles, 'Find it. Ignore "The Fake"; use "Real One"!', "Исключи «Альфа-1» и «Бета».", "plain", None)
    assert got == [["the fake"], ["альфа 1", "бета"], [], None]


def test_select_context(spark):
    rows = [
        ("q", 1, "c1", "d1", "p1", "t", "alpha one two", ""), ("q", 2, "c2", "d1", "p1", "t", "three four", ""), ("q", 3, "c3", "d1", "p1", "t", "beta five", ""), ("q", 4, "c4", "d2", "p2", "t", "alpha one two", ""),
        ("q", 5, "c5", "d2", "p2", "Bad", "six", ""), ("q", 6, "c6", "d1", "p9", "t", "seven", ""), ("q", 7, "c7", "d3", "p3", "t", "w " * 50, ""), ("q", 8, "c8", "d3", "p3", "t", "x", "parent text"), ("q", 9, "c9", None, None, None, None, None),
        ("r", 1, "c1", "d1", "p1", "t", "other", None),
    ]
    c = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, doc_id string, page string, title string, content string, parent string")
    c = c.withColumn("query", F.when(F.col("query_id") == "q", 'alpha beta, ignore "bad"'))
    got = {(r["query_id"], r["chunk_id"]): (r["decision"], r["final_rank"]) for r in select_context(c, per_document=2, per_page=1, budget=30, least=6, short=2).collect()}
    assert got == {
        ("q", "c1"): ("selected", 1), ("q", "c2"): ("page_quota", None), ("q", "c3"): ("selected", 2), ("q", "c4"): ("duplicate", None), ("q", "c5"): ("negative_title", None),
        ("q", "c6"): ("document_quota", None), ("q", "c7"): ("budget", None), ("q", "c8"): ("selected", 3), ("q", "c9"): ("selected", 4), ("r", "c1"): ("selected", 1),
    }
    more = {r["chunk_id"]: (r["decision"], r["final_rank"]) for r in select_context(c.where("query_id = 'q'"), per_document=4, per_page=1, budget=30, least=6).collect()}
    assert more["c2"] == ("overflow", 6) and more["c6"] == ("selected", 3) and more["c8"] == ("selected", 4)


def test_fresh_questions_brute_force(spark):
    texts = ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m o", "b c d e f g h i j k l m n o", "x y", "", None, "x y z", "y x", "a b c d e f g h i j k l m n p"]
    rows = [(g, i, t) for g in ("g1", "g2") for i, t in enumerate(texts) if g == "g1" or i % 2]
    got = {(r["g"], r["i"]) for r in fresh_questions(spark.createDataFrame(rows, "g string, i long, t string"), "g", "i", "t").collect()}
    want, kept = set(), {}
    for g, i, t in rows:
        s = set((t or "").split())
        if all(not (s | k) or len(s & k) / len(s | k) <= 0.86 for k in kept.setdefault(g, [])):
            kept[g].append(s)
            want.add((g, i))
    assert got == want and len(want) < len(rows)


def test_subqueries_topics_gaps(spark):
    assert column(spark, R.subqueries, "Compare extraordinary  things; small vs gigantic monsters?", "", None) == [
        ["Compare extraordinary things; small vs gigantic monsters?", "compare extraordinary things gigantic monsters", "Compare extraordinary things", "small", "gigantic monsters"], [], [],
    ]
    assert column(spark, R.topic_questions, "Кто и где? Кто", "one", " ", None) == [["Кто и где? Кто?", "Кто?", "где?"], ["one?"], [], []]
    gap = spark.createDataFrame([("who wrote it", ["it", "Beta", "Beta", " ", "year"])], "q string, a array<string>").select(R.gap_query(F.col("q"), F.col("a"), 2).alias("x"))
    assert gap.first()["x"] == "who wrote it Beta year"


def test_coverage_and_steps(spark):
    q = spark.createDataFrame([(1, "where is alphabet?; who met gammas?"), (2, "nothing known"), (3, "delta")], "query_id long, text string")
    corpus = [("c1", "where is alphabet"), ("c2", "the gammas"), ("c3", "delta force"), ("c4", "who met gammas")]

    def search(asked):
        c = spark.createDataFrame(corpus, "chunk_id string, content string")
        last = F.element_at(F.filter(F.split(F.regexp_replace("text", "[?;]", ""), " "), lambda w: F.length(w) > 4), 1)
        return asked.withColumn("w", last).join(c, F.contains("content", F.col("w"))).select("query_id", "chunk_id", "content", F.lit(1.0).alias("score"))

    e = spark.createDataFrame([(1, "c1", "where is alphabet"), (1, "c2", "the gammas")], "query_id long, chunk_id string, content string")
    got = {(r["query_id"], r["part_no"]): (r["status"], r["evidence_ids"]) for r in R.coverage(q, e).collect()}
    assert got[1, 0] == ("covered", ["c1"]) and got[1, 1] == ("mentioned", ["c2"]) and got[3, 0] == ("missing", [])
    assert {r["query_id"]: r["ratio"] for r in R.coverage_ratio(R.coverage(q, e)).collect()} == {1: 0.75, 2: 0.0, 3: 0.0}
    evidence, state = R.step_search(q, search, steps=6, stalls=9)
    s = {r["query_id"]: r for r in state.collect()}
    assert s[1]["stop"] == "sufficient" and s[1]["steps"] > 1 and s[1]["ratio"] == 1.0
    assert s[3]["stop"] == "sufficient" and s[3]["steps"] == 1
    assert s[2]["stop"] in ("stalled", "no_subquery_left") and s[2]["ratio"] == 0.0
    rows = [(r["query_id"], r["chunk_id"]) for r in evidence.collect()]
    assert len(rows) == len(set(rows)) and (1, "c4") in rows


def test_report_faults(spark):
    e = "E-" + "0" * 32
    f = "E-" + "1" * 32
    rows = [("", [], None), (f"# H\n\nFact [{e}]", [e], None), ("Fact", [e], None), (f"Fact [{e}]", [e, e], None), (f"Fact [{e}]", [f], None), (f"A provider [{e}]", [e], None), (f"Fact [{e}]\n\nLimitations: none", [e], None)]
    d = spark.createDataFrame([(i, m, r) for i, (m, r, _) in enumerate(rows)], "i int, m string, r array<string>")
    got = [x["f"] for x in d.select("i", R.report_fault(F.col("m"), F.col("r"), F.array(F.lit(e))).alias("f")).orderBy("i").collect()]
    assert got == ["blank", None, "uncited_paragraph", "reference_repeated", "reference_unknown", "unsafe", None]


def test_claim_text(spark):
    assert column(spark, R.claim_text, " First one. Second.\nThird", "x" * 600, None) == ["First one", "x" * 500, None]
    assert re.fullmatch(R.REFERENCE, "[E-" + "a" * 32 + "]")
