"""Substring and line dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from lexmill.llm import lines, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIXTURE = "/root/testdata/sf0.001/documents.parquet"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def brute_substrings(rows, window):
    """doc -> (words, removed, digest), for distinct ids."""
    firsts, docs = {}, sorted((r for r in rows), key=lambda r: r[0])
    for i, text in docs:
        words = (text or "").encode().split()
        for at in range(len(words) - window + 1):
            firsts.setdefault(tuple(words[at : at + window]), (i, at))
    out = {}
    for i, text in docs:
        words = (text or "").encode().split()
        gone = set()
        for at in range(len(words) - window + 1):
            if firsts[tuple(words[at : at + window])] < (i, at):
                gone.update(range(at, at + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def substrings_of(df, **options):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_digests(df, **options).collect()}


def random_rows(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dé", "e f", "g"]
    passage = [rng.choice(words) for _ in range(45)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            cut = rng.randint(0, 20)
            text[10:10] = passage[cut : cut + rng.randint(15, 25)]
        if i % 7 == 0:
            text += ["x"] * rng.randint(18, 50)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize("levels", [(), ((2, 2),), substrings.LEVELS, ((3, 4), (6, 3), (12, 3))])
def test_substrings_random(spark, levels):
    rows = random_rows(len(levels))
    found = substrings_of(table(spark, rows), levels=levels)
    assert found == brute_substrings(rows, 20)
    assert sum(r[1] for r in found.values()) > 200


def test_substrings_fixture(spark):
    df = spark.read.parquet(FIXTURE)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert substrings_of(df) == brute_substrings(rows, 20)


def test_substrings_odd_rows(spark):
    long = " ".join(f"w{k % 97}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "n " * 25), (4, "n " * 25), (5, "one two"), (5, "three four")]
    df = substrings.dedup_digests(table(spark, rows))
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in df.collect())
    assert found == [
        (False, 0, 25, 24), (True, 1, 0, 0), (True, 2, 0, 0), (True, 3, 30_000, 30_000 - 97), (True, 3, 30_000, 30_000 - 97), (True, 4, 25, 25), (True, 5, 2, 0), (True, 5, 2, 0),
    ]
    assert substrings.dedup_digests(table(spark, [])).count() == 0


def test_substrings_repeated_ids_with_high_checksums(spark):
    def high(*words):
        return next(t for t in (" ".join([*words, f"{words[0]}{k}"]) for k in range(99)) if zlib.crc32(t.encode()) >= 1 << 31)

    shared = [[f"p{j}w{k}" for k in range(30)] for j in range(4)]
    texts = [
        (None, high("null", *shared[0])), (None, high("other", *shared[1])), (2, high("two", *shared[0])), (2, high("also", *shared[1], *shared[2])),
        (3, high("three", *shared[2])), (4, high("four", *shared[3])), (4, high("four", *shared[3])), (5, high("five", *shared[3])), (5, high("again", *shared[2])),
    ]
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup_digests(table(spark, texts)).collect())
    # equal rows of one id are no earlier than each other; rows of one id share no passage else
    assert found == [(0, 32, 0), (0, 32, 0), (2, 32, 30), (2, 62, 30), (3, 32, 30), (4, 32, 0), (4, 32, 0), (5, 32, 30), (5, 32, 30)]


def test_symbols_of_a_window_stand_wherever_it_stands():
    """The words [low, high) of a symbol alone bring it about, whatever surrounds them."""
    rng = random.Random(11)
    seen = 0
    for _ in range(60):
        core = [rng.choice("abcd" if rng.random() < 0.5 else "abcdefghijklmnop") for _ in range(30)]
        core[10:10] = [rng.choice("ab")] * rng.randint(0, 9)
        found = []
        for _ in range(2):
            before, behind = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
            h, doc = substrings.words_of_docs([" ".join([*before, *core, *behind]).encode()])
            s = substrings.Symbols(h, doc)
            held = []
            for least, rounds in substrings.LEVELS:
                s.grow(least, rounds)
                inside = (s.low >= len(before)) & (s.high <= len(before) + len(core))
                held.append({(int(n), int(a) - len(before), int(b) - len(before)) for n, a, b in zip(s.name[inside], s.start[inside], s.end[inside])})
            found.append(held)
        assert found[0] == found[1]
        seen += sum(len(x) for x in found[0])
    assert seen > 300


def test_symbols_rule_out_most_windows():
    """With the naming switched off every window is left; with it only few but the repeated ones are."""
    rng = random.Random(3)
    passage = [f"p{rng.randrange(500)}" for _ in range(60)]
    texts = [[f"w{rng.randrange(500)}" for _ in range(400)] for _ in range(40)]
    for t in texts[::4]:
        t[100:100] = passage
    rows = [" ".join(t).encode() for t in texts]
    off, on = substrings.Windows(rows, 20), substrings.Windows(rows, 20)
    doc, key, a, b, _ = on.level(*substrings.LEVELS[0])
    holders = {}
    for d, k in zip(doc.tolist(), key.tolist()):
        holders.setdefault(k, set()).add(d)
    shared = [(d, k) for d, k in zip(doc.tolist(), key.tolist()) if len(holders[k]) > 1]
    on.rule_out(doc, key, a, b, tuple(substrings.np.array(x, dtype=t) for x, t in zip(zip(*shared), (int, "u8"))))
    windows = {}
    for t_at, t in enumerate(texts):
        for at in range(len(t) - 19):
            windows.setdefault(tuple(t[at : at + 20]), set()).add(t_at)
    repeated = sum(len(x) for x in windows.values() if len(x) > 1)
    assert off.alive.sum() == sum(len(t) - 19 for t in texts)
    assert repeated <= on.alive.sum() < 0.25 * off.alive.sum()


def test_substrings_many_equal_rows(spark):
    """Rows of one doc_id and one text fold to one: what they emit doesn't grow with their number."""
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    rows = [(7, text)] * 3000 + [(None, text)] * 500 + [(8, "x " + text + " y"), (9, "alone " * 3), (7, "other text of this id"), (7, None)]
    found = substrings.dedup_digests(table(spark, rows)).collect()
    per_id = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in found)
    assert per_id == {(7, 400, 400): 3000, (None, 400, 0): 500, (8, 402, 400): 1, (9, 3, 0): 1, (7, 5, 0): 1, (7, 0, 0): 1}
    d = substrings.keyed(table(spark, rows))
    assert substrings.folded(d).count() == 6


def test_substrings_words_that_simple_hashes_confuse(spark):
    order = [0]
    while len(order) < 1024:
        order += [1 - x for x in order]
    a, b = "".join("ab"[x] for x in order), "".join("ba"[x] for x in order)
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join([*words, a])), (2, " ".join([*words, b]))]
    assert substrings_of(table(spark, rows)) == brute_substrings(rows, 20)
    assert substrings_of(table(spark, rows))[2][:2] == (41, 40)


def test_different_passages_of_one_name_are_an_error(spark, monkeypatch):
    later = spark.createDataFrame([(2, 0, k, 1, 0, k) for k in range(5)], "id long, tie long, at int, fid long, ftie long, fat int")
    texts = [(1, 0, " ".join(f"w{k}" for k in range(60))), (2, 0, " ".join(f"w{k}" for k in range(60)))]

    def packed(rows):
        return spark.createDataFrame([(i, t, substrings.zstandard.compress(x.encode(), 1)) for i, t, x in rows], "id long, tie long, data binary")

    substrings._verify(packed(texts), later, 20)
    texts[1] = (2, 0, texts[1][2].replace("w10 ", "v10 "))
    with pytest.raises(ValueError):
        substrings._verify(packed(texts), later, 20)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows, least_words=5, most=1):
    seen, out = [], {}
    for i, text in sorted(rows):
        split = (text or "").split("\n")
        gone = []
        for at, line in enumerate(split):
            words = tuple(line.encode().split())
            if not words:
                continue
            if any(words == w or (len(words) >= least_words and len(w) >= least_words and abs(len(words) - len(w)) <= most and edits(words, w) <= most) for w in seen):
                gone.append(at)
            seen.append(words)
        out[i] = (len(split), gone)
    return out


def lines_of(df, **options):
    return {r["doc_id"]: (r["n_lines"], list(r["removed"])) for r in lines.line_decisions(df, **options).collect()}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_lines_random(spark, most):
    rng = random.Random(5)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(25)]

    def line():
        words = list(rng.choice(pool))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(words) + 1)
            words[k : k + rng.randint(0, 1)] = [rng.choice("abcdefghxyz")] * rng.randint(0, 1)
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    found, want = lines_of(table(spark, rows), edits=most), brute_lines(rows, most=most)
    assert found == want
    assert 5 < sum(len(x[1]) for x in found.values()) < 200


def test_within_edits_brute_force():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        for most in range(4):
            assert lines.within_edits(a, b, most) == (edits(a, b) <= most)


def test_lines_whose_words_simple_hashes_confuse(spark):
    order = [0]
    while len(order) < 1024:
        order += [1 - x for x in order]
    a, b = "".join("ab"[x] for x in order), "".join("ba"[x] for x in order)
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\nx {a}")]
    assert lines_of(table(spark, rows)) == {1: (2, []), 2: (2, [0])}


def test_lines_of_two_words_in_confusing_order(spark):
    """Sums of powers modulo 2 ** 64 are equal for such sequences of words and their complements."""
    order = [0]
    while len(order) < 1024:
        order += [1 - x for x in order]
    a, b = [" ".join("uv"[x ^ y] for x in order) for y in (0, 1)]
    other = a.split()[:512] + [f"o{k}" for k in range(513)]
    rows = [(1, f"{a} z1"), (2, f"{b} z2"), (3, f"{b} z3"), (9, " ".join(other))]
    assert lines_of(table(spark, rows)) == {1: (1, []), 2: (1, []), 3: (1, [0]), 9: (1, [])}


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_whose_variants_share_names(spark, edits):
    """Names of a few bits: wrong partners come before right ones, and the exact names find them again."""
    rng = random.Random(edits)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 7))] for _ in range(25)]
    rows = []
    for i in range(80):
        line = list(rng.choice(base))
        if i % 2:
            line[rng.randrange(len(line))] = rng.choice("abcdefgh")
        rows.append((i, " ".join(line)))
    want = {r["doc_id"]: r["removed"] for r in lines.line_decisions(table(spark, rows), edits).collect()}
    few = {r["doc_id"]: r["removed"] for r in lines.line_decisions(table(spark, rows), edits, bits=5).collect()}
    assert few == want and any(want.values())


def test_lines_fixture(spark):
    df = spark.read.parquet(FIXTURE).where("doc_id < 80")  # brute force compares all pairs of lines
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert lines_of(df) == brute_lines(rows)


def test_lines_text_and_odd_rows(spark):
    rows = [(2, "one two three four five\nshort\n\n"), (1, "one two three four  six\nshort\r"), (None, "x"), (3, None), (4, ""), (4, "x\nother"), (4, "x\nother")]
    df = table(spark, rows).withColumnRenamed("source", "tie").withColumnRenamed("lang", "removed")
    found = sorted(((r["doc_id"] or 0), r["text"] or "") for r in lines.dedup_lines(df).collect())
    assert found == [(0, "x"), (1, "one two three four  six\nshort\r"), (2, "\n"), (3, ""), (4, ""), (4, "other"), (4, "other")]
    assert lines.dedup_lines(df).columns == df.columns
    assert lines.line_decisions(df.limit(0)).count() == 0
    assert lines_of(df.where("doc_id = 3")) == {3: (1, [])}
