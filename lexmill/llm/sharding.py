"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets by seeded hash, Fisher-Yates in each, write.

DataFrame functions only. Law ``rows``: row number p of the global random order goes to shard p mod n, slot p div n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, row_columns


def record_size():
    """UTF-8 bytes of the text (null: none) and 16 for the frame."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16


def _ordered(kind: str) -> bool:
    return "map<" not in kind and kind != "variant"


def _hash(docs: DataFrame, seed: int) -> Column:
    """Of all columns; those without a hash of their own count by their JSON."""
    plain = [F.col(quoted(c)) for c, kind in docs.dtypes if _ordered(kind)]
    other = [F.to_json(F.struct(F.col(quoted(c)).alias("x"))) for c, kind in docs.dtypes if not _ordered(kind)]
    return F.xxhash64(F.lit(seed), *plain, *other)


def _scattered(docs: DataFrame, row: Column, buckets: int, seed: int, hot_rows: int) -> DataFrame:
    """row, bucket, place: every row's bucket and its key in the bucket's order before the shuffle. Rows that equal each other in
    all columns more than ``hot_rows`` times fold to one with a count, and are dealt out by their number."""
    bucket = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(buckets)).cast("int").alias("bucket")
    rows = docs.select(row.alias("row"), _hash(docs, seed + 1).alias("h"), _hash(docs, seed + 2).alias("g"))
    hot = rows.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("h", "g")
    hot = materialize(hot, "hot")
    if hot.isEmpty():
        return rows.select("row", bucket("h"), F.struct("g", "h").alias("place"))
    cold = rows.join(hot, ["h", "g"], "left_anti").select("row", bucket("h"), F.struct("g", "h").alias("place"))
    folded = rows.join(hot, ["h", "g"]).groupBy("h", "g").agg(F.any_value("row").alias("row"), F.count("*").alias("n"))
    dealt = folded.select("row", "h", "g", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return cold.unionByName(dealt.select("row", bucket("h", "i"), F.struct(F.xxhash64("g", "i").alias("g"), "h").alias("place")))


def shuffled(
    docs: DataFrame, row: Column, size: Column, shards: int, seed: int = 20240229, bucket_bytes: int = 32 << 20, most_tasks: int = 20_000, hot_rows: int = 4096
) -> DataFrame:
    """docs(doc_id, text, ...) -> row, shard, slot: a uniformly random order of all rows, written to the shared folder and read again.

    Pass 1 scatters by a seeded hash of all columns into total bytes / bucket_bytes buckets; copies of one text have different
    ids and so spread over all of them, and rows that are equal altogether are spread by number. Pass 2 has one task a bucket: it
    brings the bucket's rows into the order of their hashes, shuffles them (``shuffle`` is Spark's Fisher-Yates; its random state
    comes from the seed and the bucket alone) and writes them. A row's place is its place in the bucket after the sum of the buckets
    before. So placement hangs on the rows, the seed and bucket_bytes, not on the input's layout or on what follows. Shards differ
    by at most one row and slots have no gaps. Null ids, null texts and repeated rows are rows like others; an empty table gives no rows.

    Beyond ``most_tasks`` buckets pass 1 writes its rows in as many chunks as needed, and pass 2 takes one chunk a job.
    """
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows, chunks = _scattered(docs, row, buckets, seed, hot_rows), math.ceil(buckets / most_tasks)
    if chunks > 1:
        rows = materialize(rows.withColumn("chunk", F.expr(f"bucket div {most_tasks}").cast("int")), "scattered", "chunk")
    record = F.struct("place", "row")
    if all(_ordered(kind) for _, kind in docs.dtypes):
        ordered = F.sort_array(F.collect_list(record))
    else:  # such rows have no order

        def by_place(a, b):
            return F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)

        ordered = F.array_sort(F.collect_list(record), by_place)
    written = None
    for k in range(chunks):
        own = rows.where(F.col("chunk") == k) if chunks > 1 else rows
        first = k * most_tasks
        own = own.select("place", "row", (F.col("bucket") - first).alias("task"))
        dealt = own.repartitionById(min(most_tasks, buckets - first), F.col("task")).groupBy("task").agg(ordered.alias("rows"))  # no further exchange
        dealt = dealt.select((F.col("task") + first).alias("bucket"), F.posexplode(F.shuffle("rows", seed + first)).alias("at", "record"))
        dealt = dealt.select("bucket", "at", "record.row")
        dealt = materialize(dealt, "buckets")
        written = written.unionByName(dealt) if written else dealt
    ahead = written.groupBy("bucket").agg(F.count("*").alias("n"))
    ahead = ahead.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("first"))  # one row a bucket
    placed = written.join(ahead, "bucket").select("row", (F.col("first") + F.col("at")).alias("p"))
    return placed.select("row", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"p div {shards}L").alias("slot"))


def shard_plan(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under ``rows``): one row per document.

    The buckets that it writes hold doc_id, size and checksum; ``write_shards`` writes whole rows.
    """
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    slim = docs.select("doc_id", "text")
    row = F.struct("doc_id", record_size().alias("size"), crc.alias("text_crc32"))
    out = shuffled(slim, row, record_size(), shards, **options)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """Writes the shuffled rows to path/shard=N/, each shard one Parquet file sorted by slot: docs' columns as they come, and nothing else.

    A table that has a column ``shard`` itself keeps it; its folders are called ``shard_``.
    """
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns))
    out = shuffled(docs, row, record_size(), shards, **options)
    name = "shard"
    while name in docs.columns:
        name += "_"
    ranked = out.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    ranked.select(*row_columns(docs), F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
