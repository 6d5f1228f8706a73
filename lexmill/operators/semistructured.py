"""JSON columns as variants: typed values by path, and objects merged key by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_at(json: Column, path: str, kind: str) -> Column:
    """The value at a path (``$.a.b[0]``) as a type; null where the text is no JSON, the path leads nowhere or the value is of another type."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def meets(json: Column, path: str, operator: str, values: list, kind: str) -> Column:
    """Whether the value at a path meets a condition: eq, in, gte, lte, contains (of texts, in any case). Never null."""
    v = value_at(json, path, kind)
    literals = [F.lit(x).cast(kind) for x in values]
    tests = {
        "eq": lambda: v == literals[0], "in": lambda: v.isin(*literals), "gte": lambda: v >= literals[0], "lte": lambda: v <= literals[0],
        "contains": lambda: F.contains(F.lower(v.cast("string")), F.lower(literals[0].cast("string"))),
    }
    return F.coalesce(tests[operator](), F.lit(False))


def merged(rows: DataFrame, by: list[str], order: list[str], json: str) -> DataFrame:
    """rows(by, order, json) -> by, key, value: all objects of a group merged in order, the last value of each top-level key as JSON text.

    A null value is a value. Texts that are no JSON objects count as empty ones. Values are pre-aggregated by (group, key), so that a large group never meets in one task.
    """
    v = rows.select(*by, F.struct(*order).alias("_at"), F.try_parse_json(json).alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    each = v.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    last = each.select(*by, "key", "_at", F.to_json("value").alias("value")).groupBy(*by, "key").agg(F.max(F.struct("_at", "value")).alias("x"))
    return last.select(*by, "key", "x.value")


def assembled(entries: DataFrame, by: list[str]) -> DataFrame:
    """entries(by, key, value) -> by, json: one object a group, keys in order."""
    name = F.regexp_extract(F.to_json(F.array("key")), r"^\[(.*)\]$", 1)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("key", F.concat(name, F.lit(":"), F.col("value")).alias("p")))), lambda x: x["p"])
    return entries.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("json"))
