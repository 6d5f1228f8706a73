"""The evidence-driven search against a loop in plain Python, one query at a time."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import steps as S

DOCS = {
    "d1": ["Alpha founded the Borealis institute in Kirkwall", "Borealis holds archive KB-12 with maps", "closing words of this one"],
    "d2": ["archive KB-12 lists Cassiopeia expeditions", "Cassiopeia sailed in 1931"],
    "d3": ["unrelated gardening advice for beginners", "Alpha again and gardening"],
    "d4": ["документальный фильм январе 2001 вышел", "серия жилых домов построена", "название начинается с тех же цифр"],
}
CHUNKS = [(f"{d}-{i}", d, i, text) for d, texts in DOCS.items() for i, text in enumerate(texts)]
QUERIES = [
    (1, "Which archive lists Borealis maps? Who sailed Cassiopeia"), (2, "gardening beginners"), (3, "zzz yyy"), (4, ""), (5, None), (6, "Сравни gardening vs Cassiopeia expeditions"),
    (7, "Название которой серии жилых домов начинается с тех же цифр, что фильм января 2001"), (8, "Kirkwall; nothingness"), (9, "gardening and words and sailed; incomprehensible"),
]


def tokens(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def norm(text):
    return " ".join(tokens(text))


def search_one(text, k=3):
    q = set(tokens(text))
    scored = sorted((-len(q & set(tokens(c[3]))), c[0]) for c in CHUNKS if q & set(tokens(c[3])))
    return [i for _, i in scored[:k]]


def once(values, most=None):
    out, seen = [], set()
    for v in values:
        if norm(v) and norm(v) not in seen:
            seen.add(norm(v))
            out.append(v)
    return out[:most]


def bridge(q):
    q = q.lower()
    month = next((form for stem, form in S.MONTHS if stem in q), None)
    year = re.search(S.YEAR, q)
    films, series, rest = [], [], []
    if "документаль" in q or "фильм" in q:
        if month and year:
            films = [f"документальный фильм {month} {year[0]}", f"фильм вышедший в {month} {year[0]}"]
        elif year:
            films = [f"документальный фильм {year[0]}"]
    if "сери" in q and any(x in q for x in ("жил", "дом", "здани")):
        series = list(S.SERIES)
    if "цифр" in q and "назван" in q:
        rest = [S.SAME_DIGITS]
    return films[:1] + series[:1] + films[1:] + series[1:] + rest


def planned(q, most):
    parts = [p.strip(" ?") for p in re.split(r"(?i)\?|;|\bvs\b|\bversus\b", q) if p.strip(" ?").strip()] or [q]
    if q not in parts:
        parts.insert(0, q)
    out = bridge(q)
    for p in parts:
        flat = " ".join(p.split())
        out += [flat, " ".join([t for t in tokens(flat) if len(t) >= 6][:6])]
        if any(m in flat.lower() for m in S.COMPARISON):
            out.append(flat.replace("сравни", "").replace("Сравни", "").strip())
    return once(out, most)


def required(q):
    flat = " ".join(q.split())
    sig = lambda p: [t for t in tokens(p) if len(t) >= 3 and t not in T.STOPWORDS and not t.isdigit()]
    parts = [p.strip(" ?!.") for p in re.split(r"(?i)\?|;|\bvs\b|\bversus\b", flat)]
    parts = [p for p in parts if sig(p)]
    return [flat] if len(parts) <= 1 else parts[:6]


def status(part, chunks):
    terms, best = set(tokens(part)), "missing"
    for c in chunks:
        common = terms & set(tokens(TEXT[c]))
        if terms and common == terms:
            return "covered"
        if any(len(w) >= 5 for w in common):
            best = "mentioned"
    return best


TEXT, DOC = {c[0]: c[3] for c in CHUNKS}, {c[0]: c[1] for c in CHUNKS}


def chosen(evidence, limit):
    """evidence: (chunk, step, place) -> chunks in their final order."""
    out, seen = [], set()
    for c, _, _ in sorted(evidence, key=lambda e: (e[2] is None, e[2] or 0, e[1], e[0])):
        if TEXT[c] not in seen and len(out) < limit:
            out.append(c)
            seen.add(TEXT[c])
    return out


def run_one(query, limits):
    q = query or ""
    asks, log, evidence = planned(q, limits.subqueries - 1), [], []
    roles, before, stalled, step = ["planned"] * len(asks), 0.0, 0, 0
    if not asks:
        return [], [], (0, 0.0, "budget_reached")
    while True:
        step += 1
        hits = search_one(asks[step - 1])
        have = {e[0] for e in evidence}
        new = [c for c in hits if c not in have]
        evidence += [(c, step, i + 1) for i, c in enumerate(new)]
        have |= set(new)
        beside = sorted({b for c in hits[:2] for b in (f"{DOC[c]}-{int(c[-1]) - 1}", f"{DOC[c]}-{int(c[-1]) + 1}") if b in TEXT} - have)
        evidence += [(c, step, None) for c in beside]
        parts = required(q)
        states = [status(p, [e[0] for e in evidence]) for p in parts]
        now = sum({"covered": 1.0, "mentioned": 0.5, "missing": 0.0}[s] for s in states) / len(states)
        missing = [p for p, s in zip(parts, states) if s != "covered"]
        log.append((step, asks[step - 1], roles[step - 1], len(hits), len(new), len(beside), round(now, 9)))
        low = q.lower()
        is_bridge = any(x in low for x in ("фильм", "документальн")) and any(x in low for x in ("сери", "жил")) and any(x in low for x in ("цифр", "назван"))
        enough = not missing and step >= (2 if is_bridge else 1) and bool(evidence)
        if not enough and evidence:
            said = " ".join(TEXT[c] for c in chosen(evidence, limits.evidence))
            found = once([" ".join(m.split()) for p in (S.CODE, S.NAME) for m in re.findall(p, said)], 4)
            add = [x for x in missing + found if norm(x) and norm(x) not in norm(q)]
            candidate = " ".join(" ".join([" ".join(q.split()), *add[:8]]).split())[:500]
            if add and norm(candidate) not in {norm(a) for a in asks} and len(asks) < limits.subqueries:
                asks.append(candidate)
                roles.append("repair")
        last = len(asks) <= step
        stalled = stalled + 1 if now <= before else 0
        before = now
        documents = len({DOC[e[0]] for e in evidence})
        stop = (
            "evidence_sufficient" if enough else "no_new_evidence" if not new and not beside and last else "coverage_stalled" if stalled >= limits.stalls and last
            else "budget_reached" if len(evidence) >= limits.chunks or documents >= limits.documents or last or step == limits.steps else None
        )
        if stop:
            return log, evidence, (step, round(now, 9), stop)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(c, int(d[1:]), i, t) for c, d, i, t in CHUNKS], "chunk_id string, doc_id long, ordinal int, content string").cache()


def searcher(corpus):
    def search(asked):
        q = asked.select("query_id", T.distinct_tokens(F.col("text")).alias("q"))
        x = q.join(corpus, F.arrays_overlap("q", T.distinct_tokens(F.col("content"))))
        x = x.withColumn("score", F.size(F.array_intersect("q", T.distinct_tokens(F.col("content")))))
        return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where("rank <= 3")

    def neighbours(hits):
        at = hits.join(corpus.select("chunk_id", "doc_id", "ordinal"), "chunk_id").select("query_id", "doc_id", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal"))
        return at.join(corpus, ["doc_id", "ordinal"])

    return search, neighbours


@pytest.mark.parametrize("limits", [S.Limits(), S.Limits(steps=3, subqueries=4, chunks=6, documents=3, evidence=2, stalls=1)])
def test_steps_against_a_loop(spark, corpus, limits):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    log, evidence, state = S.search_steps(queries, *searcher(corpus), limits)
    got_log, got_evidence = {}, {}
    for r in sorted(log.collect(), key=lambda r: r["step"]):
        got_log.setdefault(r["query_id"], []).append((r["step"], r["query"], r["role"], r["found"], r["new"], r["neighbours"], round(r["coverage"], 9)))
    for r in evidence.collect():
        got_evidence.setdefault(r["query_id"], set()).add((r["chunk_id"], r["step"], r["place"]))
    got_state = {r["query_id"]: (r["steps"], round(r["coverage"], 9), r["stop"]) for r in state.collect()}
    for i, text in QUERIES:
        want_log, want_evidence, want_state = run_one(text, limits)
        assert got_log.get(i, []) == want_log, text
        assert got_evidence.get(i, set()) == set(want_evidence), text
        assert got_state[i] == want_state, text
    assert len({s for _, _, s in got_state.values()}) >= 3
    assert limits != S.Limits() or any(x[2] == "repair" for log in got_log.values() for x in log)


def test_no_queries(spark, corpus):
    log, evidence, state = S.search_steps(spark.createDataFrame([], "query_id long, text string"), *searcher(corpus))
    assert log.count() == evidence.count() == state.count() == 0


@pytest.mark.parametrize("ambiguous", [False, True])
def test_final_evidence(spark, ambiguous):
    rows = [
        ("q", "a1", "A", "u1", 1, 1), ("q", "a2", "A", "u2", 1, 2), ("q", "a3", "A", "u3", 1, 3), ("q", "b1", "B", "u1", 2, 1), ("q", "b2", "B", "u4", 2, 2), ("q", "n1", "A", "u5", 1, None),
        ("q", "c1", None, "u6", 3, 1), ("q", "n2", "D", "u6", 2, None), ("r", "x", "X", "u", 1, 1),
    ]
    e = spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, unit string, step int, place int")
    got = {}
    for r in sorted(S.final_evidence(e, 5, ambiguous).collect(), key=lambda r: r["position"]):
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    order = sorted((r for r in rows if r[0] == "q"), key=lambda r: (r[5] is None, r[5] or 0, r[4], r[1]))
    if ambiguous:
        first, rest, seen = [], [], set()
        for r in order:
            (first if r[2] not in seen and len(first) < 5 else rest).append(r)
            seen |= {r[2]} if r in first else set()
        order = first + rest
    want, units, docs = [], set(), []
    for r in order:
        if r[3] in units or (ambiguous and docs.count(r[2]) >= 2) or len(want) >= 5:
            continue
        want.append(r[1])
        units.add(r[3])
        docs.append(r[2])
    assert got == {"q": want, "r": ["x"]}
