"""Who may read what, what is published, and typed filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T


def typed_filter(fields: dict[str, Column], field: str, op: str, values: list[str]) -> Column:
    """eq, in, contains (any value, case-insensitive), gte, lte (dates, first value). An unknown field or operator matches nothing."""
    if field not in fields or not values:
        return F.lit(False)
    column = fields[field]
    lowered = [v.lower() for v in values]
    if op in ("eq", "in"):
        found = F.lower(column.cast("string")).isin(*lowered)
    elif op == "contains":
        found = F.lit(False)
        for v in lowered:
            found = found | F.contains(F.lower(column.cast("string")), F.lit(v))
    elif op in ("gte", "lte"):
        day, bound = F.try_to_date(F.left(column.cast("string"), F.lit(10)), "yyyy-MM-dd"), F.try_to_date(F.lit(values[0]), "yyyy-MM-dd")
        found = day >= bound if op == "gte" else day <= bound
    else:
        found = F.lit(False)
    return F.coalesce(found, F.lit(False))


def index_filter(fields: dict[str, list[str]], filters: dict[str, str | None]) -> Column:
    """All filters that have a value: document_type, language, source_kind, source_id and document_id equal one of the field's columns, date_from and date_to bound document_date as ISO text, title
    is a phrase of the title's tokens.

    Values are trimmed and in lower case, columns as they are; blank values are no filter. A filter on a field without columns matches nothing, nor does a null.
    """
    value = {k: str(v).strip().lower() for k, v in filters.items() if v is not None and str(v).strip()}
    found = F.lit(True)
    for name in ("document_type", "language", "source_kind", "source_id", "document_id"):
        if name in value:
            same = F.lit(False)
            for c in fields.get(name, []):
                same = same | F.coalesce(F.col(c).cast("string") == value[name], F.lit(False))
            found = found & same
    if "date_from" in value or "date_to" in value:
        inside = F.lit(False)
        for c in fields.get("document_date", []):
            day, one = F.col(c).cast("string"), F.lit(True)
            one = one & (day >= value["date_from"]) if "date_from" in value else one
            one = one & (day <= value["date_to"]) if "date_to" in value else one
            inside = inside | F.coalesce(one, F.lit(False))
        found = found & inside
    if "title" in value:
        padded = lambda c: F.concat(F.lit(" "), T.normalize(c), F.lit(" "))
        phrase = F.lit(False)
        for c in fields.get("title", []):
            phrase = phrase | F.coalesce(F.contains(padded(F.col(c)), padded(F.lit(value["title"]))), F.lit(False))
        found = found & phrase
    return found


def published(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """chunks(doc_id, version, ...) whose document is active and whose version is its current, published one."""
    ok = versions.where("lifecycle = 'active' and status = 'published'").select("doc_id", F.col("current_version").alias("version"))
    return chunks.join(ok, ["doc_id", "version"], "left_semi")


def permitted(asked: DataFrame, resources: DataFrame, grants: DataFrame, members: DataFrame, admins: DataFrame) -> DataFrame:
    """asked(principal_id, resource_id) -> the pairs that are allowed something: principal_id, resource_id, level ('read' or 'write').

    resources(resource_id, owner_id, base_id, base_owner_id, inherits), grants(kind, target_id, principal_kind, principal_id, level),
    members(principal_id, group_id), admins(principal_id). Allowed are admins, the owners of a resource and of its base, direct and
    group grants, and grants on the base where the resource inherits them; write includes read.

    Only what is asked is expanded: a pair meets grants by (target, principal) or (target, group), never by base or group alone.
    """
    a = asked.distinct().join(resources, "resource_id")
    level = F.when(F.col("level") == "write", 2).otherwise(1).alias("n")
    on = lambda kind, who: grants.where((F.col("kind") == kind) & (F.col("principal_kind") == who)).select(F.col("target_id").alias("t"), F.col("principal_id").alias("p"), level).groupBy("t", "p").agg(F.max("n").alias("n"))
    grouped = a.join(members, "principal_id")
    found = a.where((F.col("owner_id") == F.col("principal_id")) | (F.col("base_owner_id") == F.col("principal_id"))).select("principal_id", "resource_id", F.lit(2).alias("n"))
    found = found.unionByName(a.join(admins, "principal_id", "left_semi").select("principal_id", "resource_id", F.lit(2).alias("n")))
    for rows, target, kind in ((a, "resource_id", "resource"), (a.where("inherits"), "base_id", "base")):
        g = on(kind, "user")
        found = found.unionByName(rows.join(g, (F.col(target) == g.t) & (F.col("principal_id") == g.p)).select("principal_id", "resource_id", "n"))
    for rows, target, kind in ((grouped, "resource_id", "resource"), (grouped.where("inherits"), "base_id", "base")):
        g = on(kind, "group")
        found = found.unionByName(rows.join(g, (F.col(target) == g.t) & (F.col("group_id") == g.p)).select("principal_id", "resource_id", "n"))
    best = found.groupBy("principal_id", "resource_id").agg(F.max("n").alias("n"))
    return best.select("principal_id", "resource_id", F.when(F.col("n") == 2, "write").otherwise("read").alias("level"))


def partial_bases(allowed: DataFrame, resources: DataFrame) -> DataFrame:
    """allowed(principal_id, resource_id) -> principal_id, base_id, n: bases of which a principal sees at least a shell, for the resources inside."""
    return allowed.join(resources.select("resource_id", "base_id"), "resource_id").groupBy("principal_id", "base_id").agg(F.count("*").alias("n"))


def visible(evidence: DataFrame) -> DataFrame:
    """evidence(current_retrievable, ...): all but what is marked as no longer retrievable."""
    return evidence.where(F.coalesce("current_retrievable", F.lit(True)))
