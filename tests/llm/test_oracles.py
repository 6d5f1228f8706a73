"""Every query with SQL against that SQL in DuckDB."""

import duckdb
import pytest

from lexmill.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([list(r[i]) if isinstance(r[i], (list, tuple)) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rows, want = df.collect(), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)
    assert rows
