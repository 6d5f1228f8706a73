"""The index of cells against a scan of all vectors."""

import numpy as np
import pytest

from lexmill.operators import ranking, vectors
from lexmill.storage import new_folder


def clustered(spark, n=600, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims))
    x = centers[rng.integers(0, 8, n)] + 0.15 * rng.normal(size=(n, dims))
    x *= rng.uniform(0.3, 2.0, (n, 1))
    x[5] = 0.0
    rows = [(i, v.astype(np.float32).tolist(), int(i % 7)) for i, v in enumerate(x)] + [(n, None, 0), (n + 1, x[0].astype(np.float32).tolist(), 0), (n + 2, x[0].astype(np.float32).tolist(), 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    v = clustered(spark)
    return v, vectors.build(v, new_folder(spark, "cells"), cells=16)


def asked(v):
    return v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as q")


@pytest.mark.parametrize("where", [None, "label = 3", "label < 0"])
def test_same_as_a_scan(built, where):
    v, index = built
    known = v.where("embedding is not null")
    want = ranking.knn((known.where(where) if where else known).select("vec_id", "embedding"), asked(v).where("q is not null"))
    assert rows(vectors.search(index, asked(v), where=where)) == rows(want)


def test_cells_are_skipped(built):
    v, index = built
    reach = asked(v).where("q is not null")
    found = vectors._reach(index.cells.collect())
    from pyspark.sql import functions as F

    reach = ranking.ranked(reach.select("query_id", "q", F.inline(found("q"))), "bound", ["cell"], ["query_id"], name="place")
    hits = vectors.search(index, asked(v))
    left = vectors.survivors(reach, hits, 10, 2).count()
    assert left < 0.7 * reach.where("place > 2").count()
    scores = hits.where("rank = 1").count()
    assert scores > 20


def test_recall_of_probes(spark, built):
    v, index = built
    exact = {(r[0], r[2]) for r in rows(vectors.search(index, asked(v)))}
    some = {(r[0], r[2]) for r in rows(vectors.search(index, asked(v), probes=5))}
    assert len(exact & some) / len(exact) >= 0.9
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vectors.build(e, new_folder(spark, "cells"), cells=22)
    q = e.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as q")
    exact, some = ({(r[0], r[2]) for r in rows(vectors.search(index, q, probes=p))} for p in (None, 19))
    assert exact == {(r[0], r[2]) for r in rows(ranking.knn(e.select("vec_id", "embedding"), q))}
    assert len(exact & some) / len(exact) >= 0.9  # these vectors lie everywhere: most cells must be probed


def test_nothing(spark, built):
    v, index = built
    assert vectors.search(index, asked(v).limit(0)).count() == 0
    none = vectors.build(v.limit(0), new_folder(spark, "cells"))
    assert vectors.search(none, asked(v)).count() == 0
    one = vectors.build(v.limit(1), new_folder(spark, "cells"))
    assert {r[2] for r in rows(vectors.search(one, asked(v)))} == {0}
