"""Snapshots: what is new, changed, gone; latest versions; expected and observed projections; retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, change: new, changed, skipped (same fingerprint) or tombstone."""
    o = old.select(key, F.col(fingerprint).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(key, F.col(fingerprint).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "tombstone").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def latest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, by: list[str], order: str) -> DataFrame:
    """old with new rows in place of those with the same key; of several new ones the last by ``order``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, by, [F.desc("_new"), F.desc(order)]).drop("_new")


def missing(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return known.join(seen, key, "left_anti")


def retention(rows: DataFrame, now: Column) -> DataFrame:
    """state: purged (purge_after reached), deleted (waiting) or kept."""
    state = F.when(F.col("purge_after") <= now, "purged").when(F.col("purge_after").isNotNull(), "deleted").otherwise("kept")
    return rows.withColumn("state", state)
