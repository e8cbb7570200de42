"""The fuzzy self-join against all pairs."""

import random

import numpy as np

from tmloom.functions.similarity import lcs_length, ratio
from tmloom.operators import fuzzy
from tmloom.operators.fuzzy import similar_texts


def test_against_all_pairs(spark):
    random.seed(8)
    words = ["report", "budget", "garden", "bridge", "Überprüfung", "costs", "rose", "by", "percent"]
    rows = []
    for i in range(120):
        if i % 3 and rows:
            t = list(random.choice(rows)[2])
            for _ in range(random.randint(0, 6)):
                k = random.randrange(len(t))
                t[k:k + random.randint(0, 1)] = random.choice("abcé ")
            text = "".join(t)
        else:
            text = " ".join(random.choice(words) for _ in range(random.randint(1, 9)))
        rows.append((f"i{i:03d}", random.choice("pq"), text))
    rows += [("n1", "p", None), ("n2", None, "report budget"), ("n3", "p", "abc")]
    first = {}
    for i, p, t in rows:
        if t is not None and p is not None and len(t) >= 5:
            first[p, t] = min(i, first.get((p, t), i))
    want = set()
    for (p, t), i in first.items():
        near = sorted((-ratio(t, u), j) for (q, u), j in first.items() if q == p and u != t and ratio(t, u) >= 90)
        want |= {(p, i, j, int(-r)) for r, j in near[:5]}
    got = {tuple(r) for r in similar_texts(spark.createDataFrame(rows, "id string, scope string, text string")).collect()}
    assert got == want


def test_pairs_at_the_bound_and_without_a_long_run(spark):
    """Ratios of exactly 90, and short texts that have no run of four letters in common."""
    pairs = [("Further is training planned for Veorwy.", "Further training is planned for Veorwy..."), ("abcde", "abcXde"), ("abcdefghi", "abcXdefYghi"), ("abcdefghij", "abcefgXhij"), ("a" * 9 + "bc" * 41, "bc" * 41 + "d")]
    rows = [(f"{k}{s}", f"p{k}", t) for k, p in enumerate(pairs) for s, t in zip("ab", p)]
    rng = random.Random(3)
    rows += [(f"r{i:03d}", "r", "".join(rng.choice("ab") for _ in range(rng.randint(5, 14)))) for i in range(300)]
    for least in (90.0, 84.0):
        first = {}
        for i, p, t in rows:
            first[p, t] = min(i, first.get((p, t), i))
        want = {(p, i, j, int(ratio(t, x))) for (p, t), i in first.items() for (q, x), j in first.items() if p == q and t != x and ratio(t, x) >= least}
        assert least != 90.0 or {"p0", "p1", "p2", "p3"} <= {w[0] for w in want}
        got = {tuple(r) for r in similar_texts(spark.createDataFrame(rows, "id string, scope string, text string"), least, keep=1000).collect()}
        assert got == want


def test_one_mould_leaves_no_candidates_on_disk(spark, monkeypatch):
    """Texts of one mould in several blocks: the same as all pairs, and only the texts themselves are written."""
    rng = random.Random(4)
    texts = sorted({f"Travel to {rng.choice(['Lotos', 'Tamvezor', 'Ölren'])} took {rng.randint(1, 9999)} hours{rng.choice(['', ', despite the late start', ', as agreed'])}." for _ in range(150)})
    first = {t: f"i{k:03d}" for k, t in enumerate(texts)}
    want = set()
    for t, i in first.items():
        near = sorted((-ratio(t, x), j) for x, j in first.items() if x != t and ratio(t, x) >= 90)
        want |= {("p", i, j, int(-r)) for r, j in near[:5]}
    monkeypatch.setattr(fuzzy, "BLOCK_ROWS", 40, raising=False)
    written, write = [], fuzzy.materialise
    monkeypatch.setattr(fuzzy, "materialise", lambda df, label: written.append(label) or write(df, label))
    got = {tuple(r) for r in similar_texts(spark.createDataFrame([(i, "p", t) for t, i in first.items()], "id string, scope string, text string")).collect()}
    assert got == want and written == ["texts"]


def test_common_letters_of_many_pairs():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcß ") for _ in range(n)) for n in (1, 5, 63, 64, 65, 127, 128, 129, 200, 1100)]
    a, b = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    assert fuzzy.common(texts, a, b).tolist() == [lcs_length(texts[i], texts[j]) for i, j in zip(a, b)]
