"""Queries on the answer gate, citations and claims: over every benchmark query and its best chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import gate as G
from lexmill.operators.answers import claim_support
from lexmill.plans.catalog import query
from lexmill.plans.relations import CHUNKS, lexical, lexical_sql, norm, query_table, quoted, table, toks, words

_STOP = ", ".join(quoted(w) for w in T.STOPWORDS)


def _sig(x: str) -> str:
    return f"list_distinct(list_filter({toks(x)}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '\\p{{N}}+')))"


def _heads(x: str) -> str:
    return f"list_transform(list_filter({x}, lambda w: length(w) >= 5), lambda w: left(w, 5))"


def _meet(a: str, b: str) -> str:
    return f"(list_has_any({a}, {b}) OR list_has_any({_heads(a)}, {_heads(b)}))"


def _names(x: str) -> str:
    """Different capitalised names, in normal form, in order."""
    found = f"list_transform(regexp_extract_all({x}, '[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё-]{{2,}}'), lambda w: trim(w, '-'))"
    kept = f"list_filter({found}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND {norm('w')} <> '' AND {norm('w')} NOT IN ({_STOP}))"
    return f"list_transform({kept}, lambda w: {norm('w')})"


def _first(x: str, most: int) -> str:
    """The first few different values of a list column, in order."""
    return f"list_slice(list_filter({x}, lambda v, i: list_position({x}, v) = i), 1, {most})"


_NUMBERS = T.VALUES.replace("'", "''")
_FLAT = r"trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))"
_EVIDENCE = (
    f"{CHUNKS}, {lexical_sql(k=5)}, heads AS (SELECT doc_id, array_to_string(list_slice({words('text')}, 1, 5), ' ') AS title FROM documents), "
    f"ev AS (SELECT h.query_id, h.rank, h.doc_id, h.chunk_id, h.content, d.title, {norm('d.title')} AS nt, {toks('d.title || chr(32) || h.content')} AS body, "
    f"{_first(f'regexp_extract_all(h.content, {quoted(T.VALUES)})', 8)} AS vals FROM hits h JOIN heads d USING (doc_id))"
)
_SIGNALS = (
    f"{_EVIDENCE}, b AS (SELECT item_id AS query_id, text, {norm('text')} AS normal, {_names('text')} AS all_names, {_sig('text')} AS asked, "
    f"list_transform(regexp_extract_all(text, '[«\"]([^»\"]+)[»\"]', 1), lambda x: {norm('x')}) AS quotes, "
    f"list_transform({_first(f'regexp_extract_all(text, {quoted(T.VALUES)})', 8)}, lambda v: {norm('v')}) AS numbers, {_FLAT} AS flat FROM benchmark), "
    f"n AS (SELECT *, {_first('all_names', 10)} AS names, "
    + "list_filter(list_transform(string_split_regex(flat, '(?i)\\?|;|\\bvs\\b|\\bversus\\b'), lambda p: trim(p, ' ?!.')), lambda p: len("
    + _sig("p")
    + ") > 0) AS parts, ["
    + ", ".join(f"CASE WHEN starts_with(normal, {quoted(p)}) THEN trim(substr(normal, {len(p) + 1})) END" for p in G.PREFIXES)
    + "] AS tails FROM b), "
    "i AS (SELECT query_id, list(nt ORDER BY rank) AS nts, flatten(list(body ORDER BY rank)) AS bodies, list({'t': nt, 'b': body} ORDER BY rank) AS items, list(vals ORDER BY rank) FILTER (len(vals) > 0) AS vals, "
    "count(DISTINCT doc_id) AS diversity, count(*) AS n_evidence, min(rank) AS top FROM ev GROUP BY query_id), "
    "j AS (SELECT n.*, list_distinct(list_filter(coalesce(nts, []), lambda t: t <> '')) AS titles, coalesce(bodies, []) AS bodies, list_distinct(coalesce(bodies, [])) AS body, coalesce(items, []) AS items, coalesce(vals, []) AS vals, "
    "coalesce(diversity, 0) AS diversity, coalesce(n_evidence, 0) AS n_evidence, top, ' ' || array_to_string(coalesce(bodies, []), ' ') || ' ' AS all_text, "
    "CASE WHEN len(parts) <= 1 THEN [flat] ELSE list_slice(parts, 1, 6) END AS part, list_filter(list_concat(quotes, tails, names), lambda c: c IS NOT NULL AND c <> '') AS candidates FROM n LEFT JOIN i USING (query_id)), "
    f"k AS (SELECT *, list_distinct(flatten(list_transform(list_filter(titles, lambda t: {_meet('string_split(t, chr(32))', 'string_split(normal, chr(32))')}), lambda t: string_split(t, ' ')))) AS meant, list_has_any(titles, candidates) AS exact FROM j), "
    f"l AS (SELECT *, list_filter(asked, lambda t: NOT {_meet('[t]', 'meant')}) AS terms FROM k), "
    f"s AS (SELECT query_id, exact AS exact_title, len(names) > 0 AND len(list_filter(titles, lambda t: {_meet('names', 'string_split(t, chr(32))')})) > 0 AS entity_alignment, "
    "len(list_filter(titles, lambda t: list_contains(candidates, t) OR len(list_filter(candidates, lambda c: contains(t, c))) > 0)) > 1 AND NOT exact AS ambiguous, "
    "len(part) AS n_parts, len(list_filter(part, lambda p: len("
    + _sig("p")
    + f") > 0 AND len(list_filter(items, lambda i: ({norm('p')} <> '' AND (contains(i.t, {norm('p')}) OR contains({norm('p')}, i.t))) OR ((len({_names('p')}) = 0 OR {_meet(_names('p'), 'i.b')}) AND {_meet(_sig('p'), 'i.b')}))) > 0)) AS n_covered, "
    "len(numbers) AS n_values, len(list_filter(numbers, lambda v: contains(all_text, v))) AS n_values_covered, len(names) AS n_names, len(list_filter(names, lambda v: contains(all_text, v))) AS n_names_covered, "
    f"len(terms) AS n_terms, len(list_filter(terms, lambda t: {_meet('[t]', 'body')})) AS n_terms_covered, diversity, n_evidence, "
    "coalesce(round(greatest(0.0, 1 - (top - 1) / 50.0), 6), 0.0)::DOUBLE AS rank_confidence, "
    f"regexp_matches(lower(text), {quoted('|'.join(G.CONFLICTS))}) AND len(list_filter(vals, lambda v: NOT list_has_any(v, vals[1]))) > 0 AS conflict, "
    f"regexp_matches(normal, {quoted('^(' + '|'.join(G.DEFINITIONS) + ')')}) AS definition, regexp_matches(normal, {quoted('|'.join(G.FACTS))}) AS asks_fact FROM l)"
)
_REASON = (
    "CASE WHEN conflict THEN 'explicit_conflict_with_divergent_values' WHEN n_evidence = 0 THEN 'no_evidence' "
    "WHEN n_terms >= 2 AND n_terms - n_terms_covered >= 2 AND asks_fact AND n_terms_covered / n_terms < 0.5 THEN 'answer_bearing_terms_missing_partial' "
    "WHEN (exact_title OR (NOT definition AND entity_alignment AND rank_confidence >= 0.75)) AND n_covered >= n_parts AND n_values = n_values_covered AND n_names = n_names_covered AND diversity >= least(n_parts, 2) THEN 'required_parts_covered' "
    "WHEN definition AND ambiguous THEN 'ambiguous_entity' ELSE 'partial_context_coverage' END"
)


def _evidence(spark, sf_dir):
    heads = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 5), " ").alias("title"))
    return lexical(spark, sf_dir, 5).join(heads, "doc_id")


def _signals(spark, sf_dir):
    return G.signals(query_table(spark, sf_dir), _evidence(spark, sf_dir))


@query(
    f"WITH d AS (SELECT doc_id, {_names('text')} AS all_names FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string({_first('all_names', 10)}, ',') AS names FROM d"
)
def t_names(spark, sf_dir):
    """The first names of every document, in normal form."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(F.transform(T.names(F.col("text")), T.normalize), ",").alias("names"))


@query(f"WITH {_SIGNALS} SELECT query_id, exact_title, entity_alignment, ambiguous, definition FROM s")
def a_alignment(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", "exact_title", "entity_alignment", "ambiguous", "definition")


@query(f"WITH {_SIGNALS} SELECT query_id, n_terms, n_terms_covered, n_values, n_values_covered, n_names, n_names_covered, asks_fact FROM s")
def a_answer_terms(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", "n_terms", "n_terms_covered", "n_values", "n_values_covered", "n_names", "n_names_covered", "asks_fact")


@query(f"WITH {_SIGNALS} SELECT query_id, diversity, n_parts, n_covered, n_evidence FROM s")
def a_diversity(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", "diversity", "n_parts", "n_covered", "n_evidence")


@query(
    f"WITH {_SIGNALS}, r AS (SELECT *, {_REASON} AS reason FROM s) SELECT query_id, reason, CASE reason WHEN 'explicit_conflict_with_divergent_values' THEN 'conflicting' WHEN 'no_evidence' THEN 'unanswerable' WHEN 'required_parts_covered' THEN 'answerable' ELSE 'partial' END AS status, "
    "CAST(round(CASE reason WHEN 'explicit_conflict_with_divergent_values' THEN 0.7 WHEN 'no_evidence' THEN 0.95 WHEN 'answer_bearing_terms_missing_partial' THEN 0.55 WHEN 'required_parts_covered' THEN CASE WHEN exact_title THEN 0.9 ELSE 0.8 END "
    "ELSE greatest(0.35, least(0.75, n_covered / greatest(n_parts, 1))) END, 6) AS DOUBLE) AS confidence FROM r"
)
def a_decision(spark, sf_dir):
    return G.decision(_signals(spark, sf_dir))


# Answers: what a query's best chunks say, each with a mark; every third answer cites what it has no evidence for.
_ANSWERS = (
    f"{CHUNKS}, {lexical_sql(k=3)}, said AS (SELECT query_id AS answer_id, string_agg(left(content, 120) || ' [S' || (CASE WHEN query_id % 3 = 0 THEN rank + 2 ELSE rank END) || ']. ', '' ORDER BY rank) || 'Nothing cited here.' AS text FROM hits GROUP BY query_id), "
    "held AS (SELECT query_id AS answer_id, 'S' || rank AS evidence_id, content FROM hits), "
    "cut AS (SELECT answer_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS ss FROM said), "
    "sent AS (SELECT answer_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM cut), "
    "cl AS (SELECT answer_id, pos, list_distinct(regexp_extract_all(s, '\\[(S\\d+)\\]', 1)) AS ids, left(regexp_replace(regexp_replace(s, '\\[S\\d+\\]', '', 'g'), '^[ \\t–—-]+|[ \\t–—-]+$', '', 'g'), 4000) AS claim FROM sent), "
    "claims AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS claim_no, claim, ids FROM cl WHERE len(ids) > 0 AND claim <> '')"
)


def _answers(spark, sf_dir):
    h = lexical(spark, sf_dir, 3)
    mark = F.when(F.col("query_id") % 3 == 0, F.col("rank") + 2).otherwise(F.col("rank"))
    piece = F.concat(F.left("content", F.lit(120)), F.lit(" [S"), mark.cast("string"), F.lit("]. "))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("rank", piece.alias("piece")))), lambda x: x["piece"])
    answers = h.groupBy(F.col("query_id").alias("answer_id")).agg(F.concat(F.array_join(pieces, ""), F.lit("Nothing cited here.")).alias("text"))
    return answers, h.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("S"), F.col("rank").cast("string")).alias("evidence_id"), "content")


@query(f"WITH {_ANSWERS} SELECT answer_id, claim_no, claim, array_to_string(ids, ',') AS evidence FROM claims")
def a_cited_claims(spark, sf_dir):
    answers, _ = _answers(spark, sf_dir)
    return G.cited_claims(answers).select("answer_id", "claim_no", "claim", F.array_join("evidence_ids", ",").alias("evidence"))


def _policy_sql(mode: str) -> str:
    on = mode != "off"
    return (
        f"SELECT '{mode}' AS mode, answer_id, '{'completed' if on else 'disabled_by_policy'}' AS status, cited, {'unknown' if on else '0'} AS unknown, {'unsupported' if on else '0'} AS unsupported, {'phantom' if on else '0'} AS phantom, "
        f"{'ok' if on else 'TRUE'} AS citations_valid, {'ok' if mode == 'strict' else 'TRUE'} AS valid FROM judged"
    )


@query(
    f"WITH {_ANSWERS}, al AS (SELECT answer_id, list(evidence_id) AS allowed FROM held GROUP BY answer_id), "
    "pc AS (SELECT answer_id, count(*) FILTER (NOT list_has_any(ids, allowed)) AS unsupported, len(list_distinct(flatten(list(list_filter(ids, lambda x: NOT list_contains(allowed, x)))))) AS phantom FROM claims JOIN al USING (answer_id) GROUP BY answer_id), "
    "ct AS (SELECT answer_id, list_distinct(regexp_extract_all(text, '\\[(S\\d+)\\]', 1)) AS c, allowed FROM said JOIN al USING (answer_id)), "
    "judged AS (SELECT answer_id, len(c) AS cited, len(list_filter(c, lambda x: NOT list_contains(allowed, x))) AS unknown, coalesce(unsupported, 0) AS unsupported, coalesce(phantom, 0) AS phantom, "
    "len(c) > 0 AND len(list_filter(c, lambda x: NOT list_contains(allowed, x))) = 0 AND coalesce(unsupported, 0) = 0 AND coalesce(phantom, 0) = 0 AS ok FROM ct LEFT JOIN pc USING (answer_id)) "
    + " UNION ALL ".join(_policy_sql(m) for m in ("strict", "warn", "off"))
)
def a_citation_policy(spark, sf_dir):
    answers, held = _answers(spark, sf_dir)
    claims, out = G.cited_claims(answers), None
    for mode in ("strict", "warn", "off"):
        one = G.citation_verdicts(answers, claims, held, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


_VERDICTS = (
    f"{_ANSWERS}, ev AS (SELECT answer_id || '/' || claim_no AS claim_id, answer_id, claim, unnest(ids) AS evidence_id FROM claims), "
    f"bod AS (SELECT claim_id, string_agg({norm('content')}, ' ') AS body FROM ev JOIN held USING (answer_id, evidence_id) GROUP BY claim_id), "
    f"tm AS (SELECT answer_id || '/' || claim_no AS claim_id, answer_id, list_distinct(list_filter({toks('claim')}, lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '\\p{{N}}+'))) AS terms FROM claims), "
    "vd AS (SELECT claim_id, answer_id, CASE WHEN body IS NULL THEN 'unsupported' WHEN len(terms) = 0 OR len(list_filter(terms, lambda t: contains(body, t))) >= greatest(1, least(3, len(terms))) THEN 'supported' "
    "WHEN len(list_filter(terms, lambda t: contains(body, t))) > 0 THEN 'partially_supported' ELSE 'unsupported' END AS status FROM tm LEFT JOIN bod USING (claim_id))"
)


@query(f"WITH {_VERDICTS} SELECT answer_id, count(*) FILTER (status = 'unsupported') AS unsupported, 0 AS contradicted, CASE WHEN count(*) FILTER (status = 'unsupported') > 0 THEN 'blocked' ELSE 'completed' END AS status FROM vd GROUP BY answer_id")
def a_block_status(spark, sf_dir):
    """Claims from cited sentences, checked against the evidence that they cite; strict."""
    answers, held = _answers(spark, sf_dir)
    key = lambda *c: F.concat_ws("/", *(F.col(x).cast("string") for x in c))
    claims = G.cited_claims(answers).select("answer_id", key("answer_id", "claim_no").alias("claim_id"), F.col("claim").alias("text"), F.transform("evidence_ids", lambda e: F.concat_ws("/", F.col("answer_id").cast("string"), e)).alias("evidence_ids"))
    verdicts = claim_support(claims.drop("answer_id"), held.select(key("answer_id", "evidence_id").alias("evidence_id"), F.col("content").alias("text")))
    return G.block_status(claims.select("answer_id", "claim_id").join(verdicts, "claim_id"))


@query(
    "WITH r AS (SELECT o_orderkey AS id, o_orderkey % 17 = 0 AS abstained, o_orderkey % 13 = 0 AS blocked, o_orderkey % 11 <> 0 AS cv, o_custkey % 5 AS n_evidence, CASE o_orderstatus WHEN 'F' THEN 'answerable' WHEN 'P' THEN 'partial' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'conflicting' ELSE 'unanswerable' END END AS gate, "
    "o_orderkey % 7 = 0 AS insufficient, o_orderkey % 3 <> 0 AS validated FROM orders), "
    "c AS (SELECT id, CASE WHEN abstained THEN 'model_output_contract_abstained' WHEN blocked THEN 'claim_verification_blocked' WHEN NOT cv THEN 'citation_validation_failed' WHEN n_evidence = 0 THEN 'no_evidence_retrieved' WHEN gate = 'conflicting' THEN 'conflicting_evidence' "
    "WHEN gate = 'unanswerable' THEN 'answerability_unanswerable' WHEN gate = 'partial' OR insufficient THEN 'partial_evidence' WHEN NOT validated THEN 'retrieval_evidence_available' ELSE 'answered_with_valid_citations' END AS cause FROM r) "
    "SELECT id, cause, CASE WHEN cause LIKE 'model%' THEN 'generation' WHEN cause IN ('claim_verification_blocked', 'citation_validation_failed') THEN 'verification' WHEN cause = 'answered_with_valid_citations' THEN 'success' ELSE 'retrieval' END AS category FROM c"
)
def a_root_cause(spark, sf_dir):
    """Orders as answered requests."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    gate = F.when(s == "F", "answerable").when(s == "P", "partial").otherwise(F.when(c % 2 == 0, "conflicting").otherwise("unanswerable"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 17 == 0).alias("abstained"), (k % 13 == 0).alias("blocked"), (k % 11 != 0).alias("citations_valid"), (c % 5).alias("n_evidence"), gate.alias("gate"),
        (k % 7 == 0).alias("insufficient"), (k % 3 != 0).alias("validated"),
    )
    return G.root_cause(rows)
