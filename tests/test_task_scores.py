"""Every metric of a task in one row, against plain Python."""

import math
import random

from lexmill.operators import evaluation


def test_task_scores(spark):
    rng = random.Random(3)
    found, gold, hard, tasks = [], [], [], list(range(14))
    for q in tasks:
        chunks = [f"c{i}" for i in rng.sample(range(40), rng.choice([0, 5, 25]))]
        before = rng.sample(range(1, 41), len(chunks))
        found += [(q, r, before[r - 1], round(rng.random(), 3), f"p{int(c[1:]) % 9}", c) for r, c in enumerate(chunks, 1)]
        for i in rng.sample(range(40), rng.choice([0, 1, 4])):
            gold.append((q, f"p{i % 9}", f"c{i}"))
        hard += [(q, f"p{i}") for i in rng.sample(range(9), 3)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {
        r["query_id"]: r.asDict()
        for r in evaluation.task_scores(
            df(found, "query_id long, rank int, before int, score double, page_id string, chunk_id string"), df(gold, "query_id long, page_id string, chunk_id string"),
            df(hard, "query_id long, page_id string"), df([(t,) for t in tasks], "query_id long"),
        ).collect()
    }
    assert set(got) == set(tasks)
    for q in tasks:
        rows = sorted(x[1:] for x in found if x[0] == q and x[1] <= 20)
        pages, chunks = [r[3] for r in rows], [r[4] for r in rows]
        gp, gc, hp = {g[1] for g in gold if g[0] == q}, {g[2] for g in gold if g[0] == q}, {h[1] for h in hard if h[0] == q}
        once = list(dict.fromkeys(pages))
        recall = lambda ids, g, k: len(set(ids[:k]) & g) / len(g) if g else 0.0
        first = lambda ids, g: next((i for i, x in enumerate(ids, 1) if x in g), None)
        mrr = lambda ids, g: 1 / first(ids[:10], g) if first(ids[:10], g) else 0.0
        dcg = lambda ids, g: sum(1 / math.log2(i + 1) for i, x in enumerate(ids[:10], 1) if x in g)
        ndcg = lambda ids, g: dcg(ids, g) / sum(1 / math.log2(i + 1) for i in range(1, min(len(g), 10) + 1)) if g else 0.0
        want = {f"page_recall_{k}": recall(pages, gp, k) for k in (1, 5, 10, 20)} | {f"chunk_recall_{k}": recall(chunks, gc, k) for k in (5, 10, 20)}
        want |= {f"document_recall_{k}": recall(once, gp, k) for k in (1, 5, 10)} | {"mrr": mrr(chunks, gc), "ndcg": ndcg(chunks, gc), "document_mrr": mrr(once, gp), "document_ndcg": ndcg(once, gp)}
        hits = [r for r in rows if r[4] in gc]
        want["gained"] = min((r[1] for r in hits), default=21) - min((r[0] for r in hits), default=21) if hits else None
        golds = [r for r in rows if r[3] in gp]
        g_rank, g_score = min((r[0] for r in golds), default=None), max((r[2] for r in golds), default=None)
        bad = [r for r in rows if r[3] in hp and r[3] not in gp]
        danger = {r[3] for r in bad if r[0] <= 3 or (g_rank and r[0] < g_rank) or r[2] >= 0.5 or (g_score is not None and r[2] >= 0.6 * g_score)}
        want["false_positives"] = len({r[3] for r in bad}) / len(set(pages)) if pages else 0.0
        want["dangerous"] = len(danger) / len(set(pages)) if pages else 0.0
        h_rank = min((r[0] for r in rows if r[3] in hp), default=None)
        want["lead"] = (h_rank or 21) - (g_rank or 21) if h_rank or g_rank else None
        for name, value in want.items():
            assert (got[q][name] is None) == (value is None) and (value is None or abs(got[q][name] - value) < 2e-6), (q, name, got[q][name], value)
