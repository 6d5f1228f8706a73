"""JSON paths and merges, and the table functions."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import tables
from lexmill.operators import semistructured as J


def test_values_and_conditions(spark):
    texts = ['{"a": {"b": [1, "x"]}, "n": 7}', '{"a": {"b": []}, "n": "7"}', "no json", None, "[1]", '{"n": null}', '{"n": 7.5, "t": "Ab"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, j string")
    j = F.col("j")
    got = df.select("i", J.value_at(j, "$.a.b[1]", "string").alias("s"), J.value_at(j, "$.n", "int").alias("n"), J.meets(j, "$.n", "gte", [7], "int").alias("g"), J.meets(j, "$.t", "contains", ["aB"], "string").alias("c")).orderBy("i").collect()
    assert [r["s"] for r in got] == ["x", None, None, None, None, None, None]
    assert [r["n"] for r in got] == [7, 7, None, None, None, None, 7]
    assert [r["g"] for r in got] == [True, True, False, False, False, False, True]
    assert [r["c"] for r in got] == [False] * 6 + [True]


def test_merge_is_last_wins(spark):
    rows = [("u", 1, '{"a": 1, "b": {"x": [1, 2]}}'), ("u", 3, '{"a": null, "c\\"d": "t"}'), ("u", 2, '{"a": 2, "b": 3}'), ("u", 4, "[9]"), ("v", 1, "broken"), (None, 1, '{"a": "é"}'), ("w", 1, "{}"), ("u", 5, None)]
    m = J.merged(spark.createDataFrame(rows, "g string, n long, j string"), ["g"], ["n"], "j")
    want = {}
    for g, _, j in sorted(rows, key=lambda r: r[1]):
        try:
            x = json.loads(j)
        except (TypeError, ValueError):
            continue
        if isinstance(x, dict) and x:
            want.setdefault(g, {}).update(x)
    got = {}
    for r in m.collect():
        got.setdefault(r["g"], {})[r["key"]] = json.loads(r["value"])
    assert got == want
    assert {r["g"]: json.loads(r["json"]) for r in J.assembled(m, ["g"]).collect()} == want


def test_table_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "a b c d e", "k"), (2, "c", None), (3, None, "k"), (4, " \n", "k"), (5, "x y\tz", "l")], "doc_id long, text string, kind string")
    want = [(1, 0, 2, "a b"), (1, 1, 2, "c d"), (1, 2, 1, "e"), (2, 0, 1, "c"), (5, 0, 2, "x y"), (5, 1, 1, "z")]
    whole = spark.sql("SELECT * FROM word_windows(TABLE(SELECT * FROM {docs}), 2)", docs=docs)
    assert whole.columns == ["doc_id", "kind", "ordinal", "n_words", "content"]
    assert sorted((r["doc_id"], r["ordinal"], r["n_words"], r["content"]) for r in whole.collect()) == want
    named = spark.sql("SELECT * FROM word_windows(TABLE(SELECT doc_id AS i, text AS body FROM {docs}), 2, text => 'body')", docs=docs)
    assert named.columns == ["i", "ordinal", "n_words", "content"] and sorted(tuple(r) for r in named.collect()) == want
    lateral = spark.sql("SELECT d.doc_id, w.* FROM {docs} d, LATERAL text_windows(d.text, 2) w", docs=docs)
    assert sorted(tuple(r) for r in lateral.collect()) == want
    with pytest.raises(Exception, match="no column missing"):
        spark.sql("SELECT * FROM word_windows(TABLE(SELECT * FROM {docs}), 2, text => 'missing')", docs=docs)
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT * FROM word_windows(TABLE(SELECT * FROM {docs}), 0)", docs=docs)


def test_index_filter(spark):
    from lexmill.operators.access import index_filter

    rows = [(1, "pdf", None, "de", "2020-05-01", "The great Wall"), (2, None, "pdf", "fr", None, "Great the wall"), (3, "PDF", "x", None, "2021-01-01", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, lang string, day string, title string")
    fields = {"document_type": ["a", "b"], "language": ["lang"], "document_date": ["day"], "title": ["title"]}
    ids = lambda **f: [r["i"] for r in df.where(index_filter(fields, f)).orderBy("i").collect()]
    assert ids() == ids(language=" ", title=None) == [1, 2, 3]
    assert ids(document_type=" PDF ") == [1, 2] and ids(document_type="pdf", language="FR") == [2]
    assert ids(date_from="2020-05-01") == [1, 3] and ids(date_from="2020-05-01", date_to="2020-12-31") == [1]
    assert ids(title="great wall") == [1] and ids(title="GREAT  the") == [2] and ids(title="eat wall") == []
    assert ids(source_id="z") == []
