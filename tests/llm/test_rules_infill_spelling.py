"""Quality forest, fill-in-middle and spelling variants against models written apart from them; odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import ODD, SCHEMA, clashing, unharmed

from lexmill.llm import anomalies, infill, spelling

DOCS, LABELS = "/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.001/labels.parquet"
LABEL = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- 11: quality forest


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def verdicts(rows):
    return [(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"]) for r in rows]


def test_quality_counts_and_base_rules(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd é \U0001f600x # a|b \n \t\x0b".split(" ")) for _ in range(rng.randrange(120))) for _ in range(80)]
    texts += ["", None, "a b", "a b c", "a b c a b c", "x\n\nx\n x\nx", "   ", "long" * 50_000 + " end", "one two three " * 40_000]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    rows = anomalies.quality(docs, spark.createDataFrame([], LABEL)).collect()
    assert len(rows) == len(texts)
    for doc_id, counts, failed, kept in verdicts(rows):
        assert counts == base(texts[doc_id]), texts[doc_id]
        assert failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert kept == (not failed)  # no labels: the base rules alone


def test_tree_matches_recursion():
    rng = np.random.default_rng(2)
    x = rng.random((64, 8)).astype(np.float32)
    feature, split, path = anomalies.grow(x, 6, 9)

    def walk(row, node=1, level=0):
        if feature[node] < 0:
            return float(path[node])
        return walk(row, 2 * node + (row[feature[node]] >= split[node]), level + 1)

    probe = rng.random((300, 8)).astype(np.float32)
    want = 2.0 ** -(np.array([walk(r) for r in probe]) / 5.0)
    assert np.allclose(anomalies.anomaly(probe, [(feature, split, path)], 6, 5.0), want)
    far = np.ones((1, 8), np.float32)
    near = x[:1] * 0 + x.mean(axis=0)
    forest = [anomalies.grow(x * 0.2, 8, k) for k in range(60)]
    assert anomalies.anomaly(far, forest, 8, 5.0)[0] > anomalies.anomaly(near * 0.2, forest, 8, 5.0)[0]


def test_quality_of_rows_it_has_not_seen(spark):
    """Forest and threshold learn from the labels of even documents; the others' labels are held against the verdicts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in anomalies.quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    failed = {r["doc_id"]: r["base_failed"] for r in anomalies.quality(docs, labels.limit(0)).collect()}
    unseen = [r for r in labels.where("doc_id % 2 = 1").collect() if not failed[r["doc_id"]]]
    good, bad = ([kept[r["doc_id"]] for r in unseen if r["quality"] == q] for q in (1, 0))
    assert len(good) > 80 and len(bad) > 5
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def test_threshold(spark):
    def cut(rows, lost):
        return anomalies.calibrated(spark.createDataFrame(rows, "score double, quality int"), lost)

    rows = [(0.9, 0)] * 8 + [(0.7, 0)] * 2 + [(0.8, 1)] + [(0.3, 1)] * 98 + [(0.2, 0)]
    assert 0.3 < cut(rows, 0.05) <= 0.7
    assert 0.8 < cut(rows, 0.005) <= 0.9
    assert cut([(0.3, 1)], 0.5) == cut([(0.3, 0)], 0.5) == cut([(0.3, 0), (0.9, 1)], 1.0) == float("inf")


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(None, 0, 0), (3, None, 1), (4, 1, 0), (4, 0, 0), (99, 1, 1)], LABEL)
    rows = anomalies.quality(docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert not any(r["kept"] for r in rows)  # too short or repeated
    assert anomalies.quality(docs.limit(0), labels).collect() == []
    wide = clashing(spark.read.parquet(DOCS).limit(40).union(docs))
    left = unharmed(anomalies.keep_good(wide, spark.read.parquet(LABELS)))
    assert set(left[0].asDict()) == set(wide.columns)
    want = {r["doc_id"] for r in anomalies.quality(wide, spark.read.parquet(LABELS)).collect() if r["kept"]}
    assert {r["doc_id"] for r in left} == want and len(want) > 10


def test_quality_does_not_hang_on_the_layout(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    a, b = (sorted(map(tuple, anomalies.quality(d, labels).collect())) for d in (docs, docs.repartition(7, "n_chars")))
    assert a == b


# ---------------------------------------------------------------- 12: fill in the middle


def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted(x % (n + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_infill_model(spark):
    rng = random.Random(8)
    pieces = ["a", "é", "\U0001f600", " ", "  ", "\n", "\t", "\x0b", "<", "S>", "<P", "P>", " ", "\x00", "\x1f", "word"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)] + [" ", "", None, "<M>", "x " * 100_000, "y" * 200_000]
    rows = [(i if i % 50 else None, t, None, None, None) for i, t in enumerate(texts)] + ODD
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(tuple(r) for r in infill.infill_digests(docs).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        n, form, prefix, middle, output = fim(doc_id, text)
        want[(doc_id, n, form, prefix, middle, sha(output), sha(text or ""))] += 1
    assert got == want
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    texts = {(r["doc_id"], r["text"]) for r in infill.infill(docs).collect()}
    assert texts == {(i, None if t is None else fim(i, t)[4]) for i, t, *_ in rows}


def test_infill_options_names_and_empty(spark):
    docs = spark.read.parquet(DOCS)
    marks = ("[a.b", "^c$", "d|e]")
    cut = infill.arranged(docs, seed=7, rate=100, suffix_first=0, sentinels=marks)
    rows = cut.select("row.text", "form", "output", infill.restored(cut["output"], cut["form"], marks).alias("back")).collect()
    assert {r["form"] for r in rows} == {"psm"} and all(r["back"] == r["text"] and r["output"].startswith("[a.b") for r in rows)
    assert infill.infill_digests(docs.limit(0)).collect() == []
    wide = clashing(docs)
    assert len(unharmed(infill.infill(wide))) == docs.count()
    plan = infill.infill_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 13: spelling variants


def vocabulary(rows, noise=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(words):
    out, order = {}, sorted(words)
    near = {w: [v for v in order if one_apart(w, v)] for w in order}
    form = {}
    for w in order:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in order:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("letters, seed", [("abc", 1), ("aÀé", 2), ("xyzÿ×", 3)])
def test_spelling_brute_force(spark, letters, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(260)]
    words += ["".join(rng.sample("abcdefgh", 8)) for _ in range(40)]  # anagrams of each other
    rows = []
    for i in range(60):
        rows.append((i % 40 if i % 7 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=400))))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = found(spelling.variants(docs))
    assert got == spelled(vocabulary(rows))
    assert any(f for f, *_ in got.values()) and max(n for _, _, _, n, _ in got.values()) > 1


def test_spelling_chain_of_forms(spark):
    """Each word is near the next only, whose count is six times its own: roots are several steps away."""
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(None, " ".join([w] * 5 * 6**k)) for k, w in enumerate(chain)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = found(spelling.variants(docs, noise=0))
    assert got == spelled(vocabulary(rows, noise=0))
    assert {root for _, root, *_ in got.values()} == {chain[-1]}


def test_spelling_odd_rows(spark):
    long = "q" * 5000
    texts = [*(t for _, t, *_ in ODD), None, "", *[f"{long} {long}a a{long} Straße STRASSE straßen"] * 6, "éé ÉÉÉÉÉÉ " * 9, "abcdef-abcdef1abcdef_abcdef abcdef"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    got = found(spelling.variants(docs))
    assert got == spelled(vocabulary(rows))
    assert got[long][3] == 2
    assert spelling.variants(docs.limit(0)).collect() == []


def test_spelling_pairs_come_once(spark):
    """Two words meet under one key at most, however often their letters repeat."""
    words = ["aaaaaa", "aaaaaaa", "aabaaa", "aaabaa", "baaaaa", "aaaaab", "aabbaa", "ababab", "bababa", "aaaaba"]
    v = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(v).collect()]
    assert sorted(pairs) == [(a, b) for a in sorted(words) for b in sorted(words) if a < b and one_apart(a, b)]
