"""Nearest vectors over cells: every vector lies in the folder of its nearest centroid, and a query reads only the cells that can hold one of its best.

Centroids are fitted on a bounded sample. A cell keeps how far its vectors lie from its centroid at most, as an angle, and the largest norm: no vector in it can
score more with a query than that cone allows. A search scores each query's most promising cells, then only those others whose bound reaches the k-th best so far, so that
results are those of a full scan; ``probes`` stops after so many cells instead, and may miss some.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.ranking import nearest, ranked
from lexmill.storage import settled

#: Bounds are compared with scores of six decimals, from vectors of single precision.
_SLACK = 1e-4


class Cells(NamedTuple):
    spark: SparkSession
    path: str
    kind: str  # of vec_id

    @property
    def vectors(self) -> DataFrame:
        """cell and the columns of the vectors."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def cells(self) -> DataFrame:
        """cell, center, radius (the largest angle to it), most (the largest norm), n: a row a cell, as many as centroids at most."""
        return self.spark.read.parquet(f"{self.path}/cells")


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _angles(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    norms = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip(x / norms @ centers.T, -1.0, 1.0))


def _nearest(centers: np.ndarray):
    @F.arrow_udf("struct<cell: int, angle: double, norm: double>")
    def nearest(embedding: pa.Array) -> pa.Array:
        if not len(embedding):
            return pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.float64())], ["cell", "angle", "norm"])
        x = _matrix(embedding)
        angles = _angles(x, centers)
        cell = angles.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(x)), cell]), pa.array(np.linalg.norm(x, axis=1))], ["cell", "angle", "norm"])

    return nearest


def build(vectors: DataFrame, path: str, cells: int = 64, sample_rows: int = 20_000, seed: int = 5) -> Cells:
    """Writes vectors(vec_id, embedding, ...) by cell to a new folder. Null embeddings are in no cell.

    Centroids come from at most ``sample_rows`` vectors, the first by a seeded hash of their ids; every vector is assigned. The centroids are at most ``cells``, so that they fit in
    every task.
    """
    spark = vectors.sparkSession
    known = vectors.where("embedding is not null")
    sample = known.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).where(F.exists("embedding", lambda x: x != 0))
    sample = settled(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).coalesce(1), "vector-sample")
    n = min(cells, sample.count())
    if n >= 2:
        centers = np.array(KMeans(k=n, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample).clusterCenters())
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    else:
        centers = np.eye(1, len((known.select("embedding").first() or [[0.0]])[0]))
    dealt = known.withColumn("_in", _nearest(centers)("embedding")).select(*vectors.columns, "_in.cell", "_in.angle", "_in.norm")
    dealt.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/vectors")
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    stats = spark.read.schema(dealt.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.max("norm").alias("most"), F.count("*").alias("n"))
    middle.join(stats, "cell").coalesce(1).write.parquet(f"{path}/cells")
    return Cells(spark, path, dict(vectors.dtypes)["vec_id"])


def _reach(rows: list):
    """A column function of a query's vector -> its cells with their bounds and similarities of centroids."""
    cell = np.array([r["cell"] for r in rows], dtype=np.int32)
    centers, radius, most = np.array([r["center"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["most"] for r in rows])

    @F.arrow_udf("array<struct<cell: int, bound: double, closeness: double>>")
    def reach(q: pa.Array) -> pa.Array:
        x = _matrix(q) if len(q) else np.empty((0, centers.shape[1]))
        angles = _angles(x, centers)
        bound = np.maximum(np.cos(np.maximum(angles - radius, 0.0)), 0.0) * most * np.linalg.norm(x, axis=1, keepdims=True)
        flat = pa.StructArray.from_arrays([pa.array(np.tile(cell, len(x))), pa.array(bound.ravel()), pa.array(np.cos(angles).ravel())], ["cell", "bound", "closeness"])
        return pa.ListArray.from_arrays(np.arange(0, len(cell) * len(x) + 1, len(cell), dtype=np.int32), flat)

    return reach


def search(index: Cells, queries: DataFrame, k: int = 10, where: str | None = None, probes: int | None = None, pilot: int = 4, salts: int = 8) -> DataFrame:
    """queries(query_id, q) -> query_id, vec_id, score, rank: the k vectors of the largest positive product, ties by vec_id.

    where: a condition on the vectors' columns, applied before anything is scored, so that k of those that meet it come back. probes: only so many cells a query, the
    closest first. A cell's vectors are spread over ``salts`` where the queries are too many to be broadcast.
    """
    rows = index.cells.collect()  # one row a centroid
    if not rows:
        nothing = ", ".join(f"{name} {kind}" for name, kind in (("query_id", dict(queries.dtypes)["query_id"]), ("vec_id", index.kind), ("score", "double"), ("rank", "long")))
        return index.spark.createDataFrame([], nothing)
    salts = max(salts, -(-max(r["n"] for r in rows) // 16_384))  # what a task holds of a cell doesn't grow
    q = queries.where("q is not null")
    order = "closeness" if probes else "bound"
    reach = q.select("query_id", "q", F.inline(_reach(rows)("q")))
    reach = settled(ranked(reach.where("bound > 0") if not probes else reach, order, ["cell"], ["query_id"], probes, name="place"), "reach")
    vectors = index.vectors.where(where) if where else index.vectors
    vectors = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))

    def score(pairs: DataFrame) -> DataFrame:
        p = pairs.select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        return nearest(vectors, p, ["cell", "salt"], ["vec_id"], k).select("query_id", "vec_id", "score")

    if probes:
        return ranked(score(reach), "score", ["vec_id"], ["query_id"], k)
    first = settled(score(reach.where(F.col("place") <= pilot)), "pilot")
    rest = reach.join(survivors(reach, first, k, pilot), ["query_id", "cell"], "left_semi")
    return ranked(first.unionByName(score(rest)), "score", ["vec_id"], ["query_id"], k)


def survivors(reach: DataFrame, hits: DataFrame, k: int, pilot: int) -> DataFrame:
    """(query_id, cell) behind each query's first cells whose bound reaches the k-th best score of these."""
    last = ranked(hits, "score", ["vec_id"], ["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rest = reach.where(F.col("place") > pilot).join(last, "query_id", "left")
    return rest.where(F.col("bound") + _SLACK >= F.coalesce("reached", F.lit(0.0))).select("query_id", "cell")
