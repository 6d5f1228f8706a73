"""Mixing sources to target weights by entropy balancing.

Among all document rates with the wished tokens per source and no rate above the cap, the one nearest to "every document once"
in relative entropy is exponentially tilted: rate = min(cap, exp(lambda_source * size / mean size)). Newton's iteration on the convex dual
finds the lambdas. The dual falls apart by source, and a document's rate hangs on its source and size alone: Spark counts documents
into (source, size) cells, and the iterations of all sources run side by side in its tasks, each over its source's cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, row_columns, with_row


#: Parts of a (source, size) cell.
_SALTS = 256


def _key():
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df + name: the sum of a column (given by SQL) over the rows before, in some order without ties, for each name.

    Ranges are summed side by side; only their totals, one row a range, pass through one window.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part_").agg(*(F.sum(F.expr(x)).alias(f"all_{k}") for k, x in sums.items()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("part_", *(F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"ahead_{k}") for k in sums))
    inside = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(ahead, "part_")
    return joined.select(*df.columns, *((F.col(f"ahead_{k}") + F.coalesce(F.sum(F.expr(x)).over(inside), F.lit(0))).alias(k) for k, x in sums.items()))


def source_targets(sources: DataFrame, cap: float, cycle: tuple[int, ...]) -> DataFrame:
    """(key, source, total, docs) + target: weights repeat by code point of source, null last; targets share the sum of all totals by
    weight but stop at cap times their source's total, the excess going to the others by weight until none is above.

    Ordered by how much a source can take for its weight, all sources up to one are full and the others share what is left.
    """
    s = running(sources, [F.col("source").isNull(), F.col("source")], rank="1")
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    s = s.withColumn("weight", F.get(weights, (F.col("rank") % len(cycle)).cast("int"))).withColumn("most", F.col("total") * F.lit(cap)).drop("rank")
    s = running(s, [F.col("most") / F.col("weight"), F.col("key")], full="most", used="weight")
    everything, weights = s.agg(F.sum("total"), F.sum("weight")).first()
    s = s.withColumn("level", (F.lit(everything).cast("double") - F.col("full")) / (F.lit(weights).cast("double") - F.col("used")))
    level = s.agg(F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level")))).first()[0]
    share = F.col("most") if level is None else F.least("most", F.lit(level) * F.col("weight"))
    return s.select("key", "source", "total", "docs", share.alias("target"))


def balance(size: np.ndarray, n: np.ndarray, target: float, cap: float, tolerance: float = 1e-9, rounds: int = 200) -> tuple[float, float]:
    """(lambda, mean size) of one source: Newton on the dual; a step that leaves the bracket is a bisection."""
    mean = max(float(np.sum(size * n)) / max(int(n.sum()), 1), 1e-9)
    x = size / mean
    low, high, lam = -1e6, math.log(cap) * max(mean, 1.0) + 1e-9, 0.0
    for _ in range(rounds if target > 0 else 0):
        e = np.exp(np.minimum(lam * x, 700.0))
        mass = float(np.sum(n * size * np.minimum(cap, e)))
        slope = float(np.sum((n * size * x * e)[e < cap]))
        if abs(mass - target) < tolerance * target:
            break
        low, high = (lam, high) if mass < target else (low, lam)
        step = lam - (mass - target) / slope if slope > 0 else math.nan
        lam = step if low < step < high else (high * 2 - 1 if low < -1e5 else (low + high) / 2)
    return lam, mean


def whole_copies(size: np.ndarray, n: np.ndarray, target: float, cap: int, lump: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """(rate, copies of all n documents) of one source's cells, sizes falling: rates as the dual has them, and copies between 0 and cap * n near the target.

    Fractions of copies are carried on to the next size. Where sizes are so large or few that this leaves a mass of more than ``lump`` of what
    is still to be taken, the dual is solved again for the smaller sizes and the rest of the target, so that they make up for it together.
    """
    rate, copies = None, np.zeros(len(size), dtype=np.int64)
    mass, at, taken = size * n, 0, 0
    while at < len(size):
        rest = max(0.0, target - taken)
        lam, mean = balance(size[at:], n[at:], rest, float(cap))
        own = np.minimum(float(cap), np.exp(np.minimum(lam * size[at:] / mean, 700.0))) if rest > 0 else (size[at:] == 0).astype(float)
        rate = own if rate is None else rate
        due = np.floor(np.cumsum(n[at:] * own) + 0.5).astype(np.int64)
        copies[at:] = np.clip(np.diff(np.r_[0, due]), 0, n[at:] * cap)
        wanted, given = np.cumsum(mass[at:] * own), np.cumsum(size[at:] * copies[at:])
        far = np.flatnonzero(np.abs(wanted - given) > lump * max(rest, 1.0))
        if not len(far):
            break
        k = at + int(far[0])
        rest = target - float(np.sum(size[:k] * copies[:k]))
        least, most = rest - cap * float(mass[k + 1 :].sum()), rest  # what this size must leave to the smaller ones, and may take
        low, high = math.ceil(least / size[k]), math.floor(most / size[k])
        if low > high and low * size[k] - most > least - high * size[k]:  # one of both is missed: the nearer
            low = high
        copies[k] = np.clip(np.clip(copies[k], low, max(low, high)), 0, n[k] * cap)
        at = k + 1
        taken = int(np.sum(size[:at] * copies[:at]))
    return rate, copies


def _repaired(size: np.ndarray, n: np.ndarray, copies: np.ndarray, target: int, cap: int) -> np.ndarray:
    """Copies moved so that what misses the target is less than any copy that could still be given or taken: from the largest size that fits down, then swaps."""
    copies, some = copies.copy(), size > 0
    left = target - int(np.sum(size * copies))
    for k in np.flatnonzero(some):
        room = n[k] * cap - copies[k] if left > 0 else copies[k]
        take = min(int(room), abs(left) // int(size[k])) * (1 if left > 0 else -1)
        copies[k] += take
        left -= take * int(size[k])
    for _ in range(32):  # then up to two copies for up to two others, as long as that comes nearer
        gone, gone_of = _moves(size, np.where(some, copies, 0))
        more, more_of = _moves(size, np.where(some, n * cap - copies, 0))
        near = np.searchsorted(more, gone + left)
        near = np.stack([np.clip(near - 1, 0, len(more) - 1), np.clip(near, 0, len(more) - 1)])
        miss = np.abs(left - (more[near] - gone))
        best = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[best] >= abs(left):
            break
        np.add.at(copies, [k for k in gone_of[best[1]] if k >= 0], -1)
        np.add.at(copies, [k for k in more_of[near[best]] if k >= 0], 1)
        left -= int(more[near[best]] - gone[best[1]])
    return copies


def _moves(size: np.ndarray, room: np.ndarray, most: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Sums of none, one and two copies that there is room for, rising, and their cells (-1: none). Pairs are those of ``most`` cells, spread over all."""
    one = np.flatnonzero(room > 0)
    few = one[np.unique(np.linspace(0, len(one) - 1, most).astype(np.int64))] if len(one) else one
    i, j = (x.ravel() for x in np.meshgrid(few, few))
    ok = (i < j) | ((i == j) & (room[i] > 1))
    cells = np.vstack([[(-1, -1)], np.stack([one, np.full(len(one), -1)], axis=1), np.stack([i[ok], j[ok]], axis=1)]).astype(np.int64)
    sums = np.where(cells >= 0, size[cells], 0).sum(axis=1)
    order = np.argsort(sums, kind="stable")
    return sums[order], cells[order]


def _allot(cells: pd.DataFrame) -> pd.DataFrame:
    """Rates and whole copies for the (size, n) cells of one source. The group holds one row a distinct size, not the documents."""
    c = cells.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    size, n, cap, target = c["size"].to_numpy(np.int64), c["n"].to_numpy(np.int64), int(c["cap"].iloc[0]), float(c["target"].iloc[0])
    rate, copies = whole_copies(size, n, target, cap)
    copies = _repaired(size, n, copies, int(round(target)), cap)
    return pd.DataFrame({"key": c["key"], "size": size, "base": copies // n, "extra": copies % n, "rate": rate, "total": c["total"], "target": c["target"]})


def mixed(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...) -> row (docs' columns as a struct), size, source_size, target, rate, copies: one row per document.

    Sizes are words. A source's copies add up to its target but for less than its smallest sizes. Which documents of equal source
    and size get one copy more is decided by a seeded hash of doc_id and text; reruns agree. Null text: size 0. Null source: a source
    of its own. Repeated rows count as documents. Empty table: no rows.

    Hot sources and sizes: documents are counted by (source, size, salt) before anything else, and ranked within one of 256 salts only. Rows with
    one doc_id part by their texts; rows that are equal in both meet in one salt, but carry no text there.
    """
    sized = with_row(
        docs,
        F.col("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key().alias("key"),
        F.xxhash64("doc_id", "text", F.lit(seed + 1)).alias("order"),
    ).withColumn("salt", F.pmod("order", F.lit(_SALTS)))
    counts = materialize(sized.groupBy("key", "size", "salt").agg(F.count("*").alias("n")), "counts")
    cells = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs"))
    sources = sources.withColumn("source", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)))
    targets = materialize(source_targets(sources, float(cap), cycle), "targets")
    aimed = cells.join(targets, "key").select("key", "size", "n", "total", "target", F.lit(cap).alias("cap"))
    allotted = aimed.groupBy("key").applyInPandas(_allot, "key string, size long, base long, extra long, rate double, total long, target double")
    allotted = materialize(allotted, "allotted")
    run = Window.partitionBy("key", "size").orderBy("salt")
    whole = Window.partitionBy("key", "size")
    shares = counts.join(allotted, ["key", "size"]).withColumns({"sum": F.sum("n").over(run), "all": F.sum("n").over(whole)})
    shares = shares.withColumn("extra", F.expr("extra * sum div all - extra * (sum - n) div all"))
    shares = shares.select("key", "size", "salt", "base", "extra", F.col("total").alias("source_size"), "target", "rate")
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("order", "doc_id"))
    dealt = sized.join(shares, ["key", "size", "salt"])
    return dealt.select("row", "doc_id", "size", "source_size", "target", "rate", (F.col("base") + (rank <= F.col("extra")).cast("long")).alias("copies"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted), copies, rate: one row per document."""
    m = mixed(docs.select("doc_id", "text", "source"), **options)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it has copies. Columns as they come, whatever their names."""
    m = mixed(docs, **options).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*row_columns(docs))
