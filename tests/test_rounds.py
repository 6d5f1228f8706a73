"""Greedy filters in rounds, order statistics by ranges and as-of joins against sequential models."""

import math
import random

import pytest

from lexmill.operators import chunking, evaluation, selection


@pytest.mark.parametrize("seed, nodes, edges", [(1, 40, 60), (2, 30, 200), (3, 60, 59), (4, 5, 0)])
def test_not_first_is_the_walk_in_order(spark, seed, nodes, edges):
    rng = random.Random(seed)
    pairs = {(g, *sorted(rng.sample(range(nodes), 2))) for g in "xy" for _ in range(edges)}
    if seed == 3:  # a chain needs as many rounds as it is long
        pairs = {("x", i, i + 1) for i in range(12)}
    got = {(r["g"], r["node"]) for r in selection.not_first(spark.createDataFrame(list(pairs), "g string, a long, b long"), "g").collect()}
    want = set()
    for g in "xy":
        kept = set()
        for v in range(nodes):
            if any((g, u, v) in pairs for u in kept):
                want.add((g, v))
            else:
                kept.add(v)
    assert got == want


def test_order_statistics(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *map(float, range(30))])) for _ in range(700)] + [("one", 5.0), ("none", None), ("ties", 2.0), ("ties", 2.0), ("ties", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["floor95"], r["least"]) for r in evaluation.order_statistics(df, ["g"], "v", p50=evaluation.P50, p95=evaluation.P95, floor95=evaluation.FLOOR95, least="1").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            n = len(v)
            want[g] = (n, v[math.ceil(0.5 * n) - 1], v[math.ceil(0.95 * n) - 1], v[int((n - 1) * 0.95)], v[0])
    assert got == want
    assert evaluation.order_statistics(df.limit(0), ["g"], "v", p50=evaluation.P50).collect() == []
    plan = evaluation.order_statistics(df, ["g"], "v", p50=evaluation.P50)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan


def test_located(spark):
    """The reference pointer walks over the blocks; some have no words, and chunks start behind the last block."""
    rng = random.Random(7)
    blocks = {d: [(i, rng.choice([0, 0, 1, 3, 10, 40]), f"p{d}/{i // 3}", f"loc{i}") for i in range(rng.randint(0, 14))] for d in range(12)}
    starts = [(d, s, f"{d}:{s}") for d in range(12) for s in range(0, 150, rng.choice([5, 7]))] + [(99, 0, "99:0")]
    b = spark.createDataFrame([(d, *x) for d, xs in blocks.items() for x in xs], "doc long, block long, words long, path string, locator string")
    got = {r["name"]: (r["block"], r["path"], r["locator"]) for r in chunking.located(spark.createDataFrame(starts, "doc long, start long, name string"), b, "doc").collect()}
    want = {}
    for d, s, name in starts:
        at, found, path = 0, (None, None, None), None
        for i, n, p, loc in blocks.get(d, []):
            path = p
            if at <= s < at + max(n, 1):
                found = (i, p, loc)
                break
            at += n
        want[name] = found if found[0] is not None else (None, path, None)
    assert got == want and any(x[0] is None and x[1] for x in got.values())


def test_lcs_of_random_and_long_pairs():
    rng = random.Random(8)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randrange(30))] for _ in range(2))
        assert evaluation.lcs_length(a, b) == table(a, b)
    a, b = ([f"w{rng.randrange(50)}" for _ in range(900)] for _ in range(2))
    assert evaluation.lcs_length(a, b) == table(a, b)
    assert evaluation.lcs_length(["x"] * 5000, ["x"] * 4000 + ["y"]) == 4000
