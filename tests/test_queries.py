"""Every query with SQL against that SQL in DuckDB; none may be empty or constant where it shouldn't be."""

import math

import duckdb
import pytest

from lexmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(repr([one(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)
    if name != "f_typed_filters":  # 200 documents have no match
        assert rows


def test_registry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "r_bm25" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_sql_has_rows(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert len(rows) > 1 and len(set(map(str, rows))) > 1


def test_topic_questions_of_the_whole_benchmark(spark):
    ids = {r["id"] - 1000 for r in catalog.QUERIES["d_topic_questions"](spark, SF).collect() if r["id"] >= 1000}
    assert ids == {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").collect()}
