"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found by pattern in every distinct text; the hash of each value is counted over distinct repositories (documents) and
owners (sources). A value of many owners or in many repositories is a copied example; a live-looking value of few is a credential, and wherever
such a value stands as a run of 20 or more key characters, with or without a keyword beside it, it is a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key

#: kind, pattern, group that holds the value, least length of the value. Fixed values; the first three are the base, in this order.
#: A run of 16 or 18 and more characters is matched as such where shorter runs could not change a later match.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
)
#: A text without a match of this has no candidate of any kind.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def candidates(texts: DataFrame) -> DataFrame:
    """texts(node, text), node unique -> node, rank (of the kind), kind, start, end (code points), value, of every match that counts.

    A text is split at its matches; starts are running sums of the lengths of the pieces and matches before.
    """
    found = [
        F.struct(
            F.lit(k).alias("rank"),
            F.lit(kind).alias("kind"),
            F.lit(least).alias("least"),
            F.split("text", pattern, -1).alias("gaps"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("values"),
        )
        for k, (kind, pattern, group, least) in enumerate(KINDS)
    ]
    per_kind = texts.select("node", F.explode(F.array(*found)).alias("f")).select("node", "f.*").where(F.size("matches") > 0)
    rows = per_kind.select(
        "node", "rank", "kind", "least",
        F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("matches")).alias("gap"), F.col("matches").alias("match"), F.col("values").alias("value"))).alias("at", "x"),
    )
    rows = rows.select("node", "rank", "kind", "least", "at", F.length("x.gap").alias("g"), F.length("x.match").alias("m"), F.col("x.value").alias("value"))
    end = F.sum(F.col("g") + F.col("m")).over(Window.partitionBy("node", "rank").orderBy("at"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("m")).where(F.length("value") >= F.col("least"))
    return rows.select("node", "rank", "kind", "start", "end", "value")


def live_looking(value: Column) -> Column:
    """Digits and letters, and at least eight different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def ownership(found: DataFrame, docs: DataFrame, copied_owners: int, copied_repositories: int) -> DataFrame:
    """found(node, value), docs(node, doc_id, source) -> hash, repositories, owners, verdict ('example', 'live' or 'weak').

    A repository is a document: a doc_id, or a text where that is null. Holders fold by (value, document, owner) before counting, so that neither a
    text nor a value that a third of all rows hold meets in one task. A null source is an owner of its own.
    """
    owner = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("owner")
    repository = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.hex("node"))).alias("repository")
    holders = docs.select("node", owner, repository).distinct()
    values = found.select("node", F.sha2("value", 256).alias("hash"), live_looking(F.col("value")).alias("live")).distinct()
    held = values.join(holders, "node").select("hash", "live", "owner", "repository")
    repositories = held.select("hash", "live", "repository").distinct().groupBy("hash", "live").agg(F.count("*").alias("repositories"))
    owners = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    verdict = F.when(copied, "example").when(F.col("live"), "live").otherwise("weak")
    return repositories.join(owners, "hash").select("hash", "repositories", "owners", verdict.alias("verdict"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def outside_base(found: DataFrame) -> DataFrame:
    """The base spans, and those others that no base span of their text overlaps: none before reaches into them, none behind starts inside."""
    before = Window.partitionBy("node").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("node").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)  # running, not anew for each row
    base = F.col("rank") < len(KINDS) - 1
    reach, next_ = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(behind)
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.col("end") <= F.coalesce(next_, F.col("end")))
    return found.withColumn("free", free).where(base | F.col("free")).drop("free")


def secrets(docs: DataFrame, copied_owners: int = 3, copied_repositories: int = 1000) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, repositories, owners: a row per document.

    spans holds the base spans and those of kind ``owned``: further runs of 20 and more key characters whose value is live-looking
    and is held by fewer than ``copied_owners`` owners and ``copied_repositories`` repositories of the corpus, outside every base span.
    n_live and n_example count the document's spans by verdict; repositories and owners are those of its most widely held value (0: no span).
    Null, empty or clean text: zeros, the digest of nothing and ``''``. Repeated rows get equal rows.
    """
    keyed = docs.select("doc_id", "text", "source", text_key().alias("node"))
    texts = keyed.where(F.col("text").rlike(_ANY)).groupBy("node").agg(F.any_value("text").alias("text"))
    found = materialize(candidates(texts), "candidates")
    kept = outside_base(found).where((F.col("rank") < 3) | live_looking(F.col("value")))
    held = keyed.select("node", "doc_id", "source").join(kept.select("node").distinct(), "node", "left_semi")
    owners = ownership(kept, held, copied_owners, copied_repositories)
    judged = kept.withColumn("hash", F.sha2("value", 256)).join(owners, "hash").where("rank < 3 or verdict = 'live'")
    span = F.struct("start", "rank", "kind", "end")
    per_text = judged.groupBy("node").agg(
        *(F.count_if(F.col("rank") == k).alias(f"n_{KINDS[k][0]}") for k in range(3)),
        F.collect_list(F.when(F.col("rank") < 3, span)).alias("base"),
        F.collect_list(span).alias("all"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.max("repositories").alias("repositories"),
        F.max("owners").alias("owners"),
    )
    per_text = per_text.select(
        "node", "n_assign", "n_access", "n_hex", F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"),
        "n_live", "n_example", "repositories", "owners",
    )
    zero = F.lit(0).cast("long")
    return keyed.select("doc_id", "node").join(per_text, "node", "left").select(
        "doc_id",
        *(F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")),
        F.coalesce("base_sha256", F.lit(_EMPTY)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "repositories", "owners")),
    )
