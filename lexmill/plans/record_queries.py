"""Queries on filters, access, joins, changes and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import access as A
from lexmill.operators import changes as C
from lexmill.operators.ranking import first_per
from lexmill.operators import semistructured as J
from lexmill.plans.catalog import query
from lexmill.plans.relations import CHUNKS, GOLD, META, chunks, gold, meta, norm, table, words
from lexmill.streaming import windows as S
from lexmill.streaming.retention import purges


@query(f"WITH {META} SELECT doc_id FROM meta WHERE lower(lang) IN ('en', 'fr') AND contains(lower(source), 'src1') AND document_date >= DATE '2021-01-01' AND document_date <= DATE '2022-03-01'")
def f_typed_filters(spark, sf_dir):
    fields = {"language": F.col("lang"), "source": F.col("source"), "document_date": F.col("document_date")}
    wanted = [("language", "in", ["EN", "fr"]), ("source", "contains", ["SRC1"]), ("document_date", "gte", ["2021-01-01"]), ("document_date", "lte", ["2022-03-01"])]
    out = meta(spark, sf_dir)
    for field, op, values in wanted:
        out = out.where(A.typed_filter(fields, field, op, values))
    return out.select("doc_id")


_PHRASE = "contains(' ' || " + norm("title") + " || ' ', ' ' || w.phrase || ' ')"


@query(
    f"WITH {META}, h AS (SELECT doc_id, array_to_string(list_slice({words('text')}, 1, 5), ' ') AS title FROM documents), "
    f"d AS (SELECT m.*, h.title FROM meta m JOIN h USING (doc_id)), w AS (SELECT {norm('title')} AS phrase FROM d WHERE doc_id = (SELECT min(doc_id) FROM d WHERE title <> '')) "
    "SELECT doc_id, 'type' AS filter FROM d WHERE 'published' IN (source, lifecycle, status) UNION ALL SELECT doc_id, 'kind' FROM d WHERE 'src3' IN (source, lifecycle) AND lang = 'en' "
    "UNION ALL SELECT doc_id, 'dates' FROM d WHERE CAST(document_date AS VARCHAR) >= '2021-01-01' AND CAST(document_date AS VARCHAR) <= '2021-06-30' "
    f"UNION ALL SELECT doc_id, 'title' FROM d, w WHERE {_PHRASE}"
)
def f_index_filter(spark, sf_dir):
    """Filters as the index takes them: alternatives of a field, a range of dates as text, a phrase of the title."""
    heads = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 5), " ").alias("title"))
    d = meta(spark, sf_dir).join(heads, "doc_id")
    fields = {"document_type": ["source", "lifecycle", "status"], "language": ["lang"], "source_kind": ["source", "lifecycle"], "document_date": ["document_date"], "title": ["title"]}
    some = d.where("title <> ''").agg(F.min_by("title", "doc_id")).first()[0]
    wanted = {"type": {"document_type": " Published "}, "kind": {"source_kind": "SRC3", "language": "EN", "source_id": None}, "dates": {"date_from": "2021-01-01", "date_to": "2021-06-30"}, "title": {"title": some}}
    out = [d.where(A.index_filter(fields, f)).select("doc_id", F.lit(name).alias("filter")) for name, f in wanted.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"WITH {CHUNKS}, {META} SELECT c.chunk_id FROM chunks c JOIN meta m ON c.doc_id = m.doc_id WHERE m.lifecycle = 'active' AND m.status = 'published' AND m.current_version = c.ordinal % 3")
def f_authority(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("version", F.col("ordinal") % 3)
    return A.published(c, meta(spark, sf_dir)).select("chunk_id")


_ACL = (
    "res AS (SELECT o_orderkey AS resource_id, o_custkey AS owner_id, o_orderkey % 7 AS base_id, (o_orderkey % 7) * 100 + 1 AS base_owner_id, o_orderkey % 2 = 0 AS inherits FROM orders), "
    "mem AS (SELECT c_custkey AS principal_id, CAST(c_nationkey AS BIGINT) AS group_id FROM customer), "
    "gr AS (SELECT 'resource' AS kind, o_orderkey AS target_id, 'group' AS who, o_orderkey % 25 AS principal_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderkey % 11 = 0 "
    "UNION ALL SELECT 'resource', o_orderkey, 'user', o_custkey + 1, 1 FROM orders WHERE o_orderkey % 13 = 0 "
    "UNION ALL SELECT 'base', CAST(n_nationkey % 7 AS BIGINT), 'group', CAST(n_nationkey AS BIGINT), 1 FROM nation WHERE n_nationkey % 5 = 0), "
    "asked AS (SELECT DISTINCT unnest([o_custkey, o_custkey + 1, o_custkey + 2, 1 + o_orderkey % 10]) AS principal_id, o_orderkey AS resource_id FROM orders), "
    "a AS (SELECT * FROM asked JOIN res USING (resource_id)), am AS (SELECT a.*, mem.group_id FROM a JOIN mem USING (principal_id)), "
    "f AS (SELECT principal_id, resource_id, 2 AS n FROM a WHERE owner_id = principal_id OR base_owner_id = principal_id OR principal_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 = 0) "
    "UNION ALL SELECT a.principal_id, a.resource_id, gr.n FROM a JOIN gr ON who = 'user' AND gr.principal_id = a.principal_id AND ((kind = 'resource' AND target_id = resource_id) OR (kind = 'base' AND inherits AND target_id = base_id)) "
    "UNION ALL SELECT am.principal_id, am.resource_id, gr.n FROM am JOIN gr ON who = 'group' AND gr.principal_id = am.group_id AND ((kind = 'resource' AND target_id = resource_id) OR (kind = 'base' AND inherits AND target_id = base_id))), "
    "ok AS (SELECT principal_id, resource_id, CASE max(n) WHEN 2 THEN 'write' ELSE 'read' END AS level FROM f GROUP BY principal_id, resource_id)"
)


def _acl(spark, sf_dir):
    """Customers are principals, nations their groups, orders the resources; each order is asked for by its owner, the next two and ten others."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    resources = o.select(k.alias("resource_id"), c.alias("owner_id"), (k % 7).alias("base_id"), ((k % 7) * 100 + 1).alias("base_owner_id"), (k % 2 == 0).alias("inherits"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("principal_id"), F.col("c_nationkey").cast("long").alias("group_id"))
    grant = lambda kind, target, who, pid, level: [F.lit(kind).alias("kind"), target.alias("target_id"), F.lit(who).alias("principal_kind"), pid.alias("principal_id"), level.alias("level")]
    n = F.col("n_nationkey").cast("long")
    grants = (
        o.where("o_orderkey % 11 = 0").select(*grant("resource", k, "group", k % 25, F.when(k % 2 == 0, "write").otherwise("read")))
        .unionByName(o.where("o_orderkey % 13 = 0").select(*grant("resource", k, "user", c + 1, F.lit("read"))))
        .unionByName(table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(*grant("base", n % 7, "group", n, F.lit("read"))))
    )
    asked = o.select(F.explode(F.array(c, c + 1, c + 2, 1 + k % 10)).alias("principal_id"), k.alias("resource_id"))
    admins = table(spark, sf_dir, "customer").where("c_custkey % 97 = 0").select(F.col("c_custkey").alias("principal_id"))
    return A.permitted(asked, resources, grants, members, admins), resources


@query(f"WITH {_ACL} SELECT principal_id, resource_id, level FROM ok")
def f_acl(spark, sf_dir):
    return _acl(spark, sf_dir)[0]


@query(f"WITH {_ACL} SELECT principal_id, base_id, count(*) AS n FROM ok JOIN res USING (resource_id) GROUP BY principal_id, base_id")
def f_acl_bases(spark, sf_dir):
    return A.partial_bases(*_acl(spark, sf_dir))


@query(
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents WHERE length(text) >= 450 AND NOT regexp_matches(source, 'src(3|7)$')) WHERE k <= 100"
)
def f_eval_corpus(spark, sf_dir):
    """A hash-ordered sample of 100 long documents outside two sources: the limit is the feature."""
    d = table(spark, sf_dir, "documents").where((F.length("text") >= 450) & ~F.col("source").rlike("src(3|7)$"))
    return d.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).orderBy("h").limit(100).select("doc_id")


@query(f"WITH {CHUNKS}, {META} SELECT c.chunk_id, m.document_date, CASE WHEN m.status = 'published' THEN m.current_version END AS version FROM chunks c JOIN meta m ON c.doc_id = m.doc_id AND m.lifecycle = 'active'")
def j_chunk_version(spark, sf_dir):
    m = meta(spark, sf_dir).where("lifecycle = 'active'")
    v = meta(spark, sf_dir).where("status = 'published'").select("doc_id", F.col("current_version").alias("version"))
    return chunks(spark, sf_dir).join(m, "doc_id").join(v, "doc_id", "left").select("chunk_id", "document_date", "version")


@query(
    f"WITH {CHUNKS}, b AS (SELECT doc_id, CAST(ordinal * 500 AS BIGINT) AS low, CAST(ordinal * 500 + 500 AS BIGINT) AS high FROM (SELECT doc_id, unnest(range(0, len(w) // 500 + 1)) AS ordinal FROM words)) "
    "SELECT c.chunk_id, b.low FROM chunks c JOIN b ON c.doc_id = b.doc_id AND c.ordinal * 220 >= b.low AND c.ordinal * 220 < b.high"
)
def j_position(spark, sf_dir):
    """Interval join: the block of 500 words that holds a chunk's first word."""
    b = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.size(T.words(F.col("text"))).alias("words"))
    b = b.select("id", F.explode(F.expr("sequence(0L, words div 500)")).alias("n"))
    b = b.select("id", (F.col("n") * 500).alias("low"), (F.col("n") * 500 + 500).alias("high"))
    at = F.col("ordinal") * 220
    return chunks(spark, sf_dir).join(b, (F.col("doc_id") == F.col("id")) & (at >= F.col("low")) & (at < F.col("high"))).select("chunk_id", "low")


@query(
    f"WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, chunk_id) AS k FROM chunks) "
    "SELECT a.chunk_id AS anchor_id, b.chunk_id, b.k - a.k AS distance FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 1 AND a.k + 1 WHERE a.ordinal % 4 = 1"
)
def j_context_window(spark, sf_dir):
    """Each anchor with the rows around it, by equi-join on the row numbers it wants."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "chunk_id"))
    n = chunks(spark, sf_dir).select("doc_id", "chunk_id", "ordinal", k.alias("k"))
    a = n.where("ordinal % 4 = 1").select("doc_id", F.col("chunk_id").alias("anchor_id"), F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("distance"), (F.col("k") + d).alias("k")) for d in (-1, 0, 1)))).alias("x"))
    return a.select("doc_id", "anchor_id", "x.*").join(n.select("doc_id", "k", "chunk_id"), ["doc_id", "k"]).select("anchor_id", "chunk_id", "distance")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 11 <> 0")
def j_tombstones(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").distinct()
    return C.missing(d.where("doc_id % 7 <> 0"), d.where("doc_id % 11 <> 0"), "doc_id")


@query(
    f"WITH {CHUNKS}, e AS (SELECT chunk_id, md5(content) AS h FROM chunks), o AS (SELECT chunk_id, CASE WHEN ordinal % 5 = 2 THEN 'stale' ELSE md5(content) END AS h FROM chunks WHERE doc_id % 6 <> 0 "
    "UNION ALL SELECT 'x' || chunk_id, md5(content) FROM chunks WHERE doc_id % 50 = 0) "
    "SELECT coalesce(e.chunk_id, o.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN e.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS action FROM e FULL OUTER JOIN o ON e.chunk_id = o.chunk_id WHERE e.h IS DISTINCT FROM o.h"
)
def j_projection_diff(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("h", F.md5("content"))
    seen = c.where("doc_id % 6 <> 0").select("chunk_id", F.when(F.col("ordinal") % 5 == 2, "stale").otherwise(F.col("h")).alias("h"))
    seen = seen.unionByName(c.where("doc_id % 50 = 0").select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), "h"))
    d = C.snapshot_diff(seen, c.select("chunk_id", "h"), "chunk_id", "h").where("change <> 'skipped'")
    return d.select("chunk_id", F.when(F.col("change") == "new", "insert").when(F.col("change") == "tombstone", "delete").otherwise("update").alias("action"))


@query(f"WITH {GOLD} SELECT query_id, doc_id FROM gold")
def j_quote_binding(spark, sf_dir):
    return gold(spark, sf_dir)


@query(
    "WITH p AS (SELECT DISTINCT source, text, doc_id FROM documents WHERE text IS NOT NULL), e AS (SELECT text, count(DISTINCT doc_id) AS n, min(doc_id) AS doc_id FROM p GROUP BY text) "
    "SELECT d.doc_id, e.doc_id AS bound, CASE WHEN e.n > 1 THEN 'ambiguous' ELSE 'exact' END AS state FROM documents d JOIN e ON d.text = e.text"
)
def j_title_binding(spark, sf_dir):
    """Each text bound to the first document that has it; ambiguous where several do."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("k"))
    e = d.groupBy("k").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("bound"))
    return d.join(e, "k").select("doc_id", "bound", F.when(F.col("n") > 1, "ambiguous").otherwise("exact").alias("state"))


@query(
    "WITH t AS (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "SELECT conv_id, turn, length(answer) AS answer_chars FROM t WHERE role = 'user' AND next_role = 'assistant'"
)
def w_pairs(spark, sf_dir):
    """Every user turn with the assistant's next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.length("answer").cast("long").alias("answer_chars"))


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) AS k FROM lineitem) "
    "SELECT o.o_orderkey, CAST(l.l_linenumber AS BIGINT) AS line FROM orders o LEFT JOIN l ON o.o_orderkey = l.l_orderkey AND l.k = 1"
)
def j_latest_version(spark, sf_dir):
    """Latest line of every order, null where it has none."""
    last = first_per(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], [F.desc("l_shipdate"), "l_linenumber"])
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(last, o.o_orderkey == last.l_orderkey, "left").select("o_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query(
    "SELECT o.o_orderkey, count(l.l_linenumber) AS items, count(CASE WHEN l.l_linestatus = 'F' THEN 1 END) AS done, count(CASE WHEN l.l_returnflag = 'R' THEN 1 END) AS failed "
    "FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey"
)
def j_batch_status(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("items"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select("o_orderkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "done", "failed")))


@query(
    "SELECT CASE WHEN n.doc_id IS NULL THEN o.doc_id ELSE n.doc_id END AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'tombstone' WHEN o.h = n.h THEN 'skipped' ELSE 'changed' END AS change "
    "FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0) o FULL OUTER JOIN (SELECT doc_id, md5(text || CASE WHEN doc_id % 13 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 11 <> 0) n ON o.doc_id = n.doc_id"
)
def x_cdc_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = d.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 13 == 0, "!").otherwise(""))).alias("h"))
    return C.snapshot_diff(old, new, "doc_id", "h")


@query(
    f"WITH {META} SELECT doc_id, CASE WHEN lifecycle = 'deleted' AND document_date + 30 <= DATE '2021-06-01' THEN 'purged' WHEN lifecycle = 'deleted' THEN 'deleted' ELSE 'kept' END AS state FROM meta"
)
def x_retention(spark, sf_dir):
    m = meta(spark, sf_dir).withColumn("purge_after", F.when(F.col("lifecycle") == "deleted", F.date_add("document_date", 30)))
    return C.retention(m, F.lit("2021-06-01").cast("date")).select("doc_id", "state")


@query(
    "WITH u AS (SELECT doc_id, n_chars, 0 AS is_new FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, n_chars + 1, 1 FROM documents WHERE doc_id % 3 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY is_new DESC) AS k FROM u) SELECT doc_id, n_chars FROM r WHERE k = 1"
)
def x_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return C.upsert(d.where("doc_id % 7 <> 0"), d.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1), ["doc_id"], "n_chars")


@query(
    "SELECT user_id AS source_id, max(ts) AS last_sync, date_diff('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS waited FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 12:00:00'"
)
def x_due_sources(spark, sf_dir):
    """Sources whose last sync is half a day and more back."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("last_sync"))
    e = e.where(F.col("last_sync") <= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    waited = F.timestamp_diff("MINUTE", F.date_trunc("minute", "last_sync"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return e.select("source_id", "last_sync", waited.cast("long").alias("waited"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_tumbling(spark, sf_dir):
    return S.windowed(_events(spark, sf_dir), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "SELECT date_trunc('hour', ts) - CAST(k AS INTEGER) * INTERVAL 1 HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events CROSS JOIN range(0, 3) AS r(k) GROUP BY 1, 2"
)
def x_sliding(spark, sf_dir):
    return S.windowed(_events(spark, sf_dir), "3 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) "
    "SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"
)
def x_session(spark, sf_dir):
    return S.sessions(_events(spark, sf_dir), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM (SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 23 = 0) GROUP BY event_type")
def x_dedup_watermark(spark, sf_dir):
    e = _events(spark, sf_dir)
    return S.first_events(e.unionByName(e.where("event_id % 23 = 0"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events) "
    "SELECT event_type, count(*) AS n, count(k) AS with_k, sum(CAST(k AS BIGINT)) AS k_sum, count(CASE WHEN k >= 50 THEN 1 END) AS large, round(avg(CASE WHEN k IN (7, 9, 70) THEN value END), 6) AS picked FROM p GROUP BY event_type"
)
def x_props_rollup(spark, sf_dir):
    """Typed values out of a JSON column, parsed once a row."""
    e = table(spark, sf_dir, "events")
    k = J.value_at(F.col("props"), "$.k", "int")
    x = e.select("event_type", "value", k.alias("k"), J.meets(F.col("props"), "$.k", "gte", [50], "int").alias("large"), J.meets(F.col("props"), "$.k", "in", [7, 9, 70], "int").alias("picked"))
    return x.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum(F.col("k").cast("long")).alias("k_sum"), F.count_if("large").alias("large"), F.round(F.avg(F.when(F.col("picked"), F.col("value"))), 6).alias("picked")
    )


@query(
    "WITH u AS (SELECT user_id, event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT user_id, event_id, event_type, CAST(event_id AS VARCHAR) FROM events) "
    "SELECT user_id, key, arg_max(value, event_id) AS value FROM u GROUP BY user_id, key"
)
def x_props_merge(spark, sf_dir):
    """Each user's state: the properties of all events and the last event of each type, merged in order."""
    e = table(spark, sf_dir, "events")
    both = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "'), F.col("event_type"), F.lit('": '), F.col("event_id"), F.lit("}"))
    return J.merged(e.select("user_id", "event_id", both.alias("props")), ["user_id"], ["event_id"], "props")


@query(
    "WITH e AS (SELECT user_id AS doc_id, ts AS moment, CASE event_type WHEN 'error' THEN 'deleted' ELSE 'restored' END AS kind FROM events WHERE event_type IN ('error', 'click')), "
    "x AS (SELECT *, sum(CASE WHEN kind = 'restored' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY moment, kind ROWS UNBOUNDED PRECEDING) AS s FROM e), "
    "g AS (SELECT doc_id, s, min(CASE WHEN kind = 'deleted' THEN moment END) AS d, min(CASE WHEN kind = 'restored' THEN moment END) AS r FROM x GROUP BY ALL), "
    "n AS (SELECT *, lead(r) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM g), t AS (SELECT max(ts) AS now FROM events) "
    "SELECT doc_id, min(d) AS deleted_at, min(d) + INTERVAL 2 DAY AS purged_at FROM n, t WHERE d + INTERVAL 2 DAY <= coalesce(next, now) GROUP BY doc_id"
)
def x_purges(spark, sf_dir):
    """Users as documents: an error deletes, a click within two days restores."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "restored")
    rows = e.select(F.col("user_id").alias("doc_id"), F.col("ts").alias("at"), kind.alias("kind")).where("kind is not null")
    return purges(rows, 2 * 86_400, F.lit(e.agg(F.max("ts")).first()[0]))
