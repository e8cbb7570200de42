"""Sentence alignment: planted translations with merges, omissions and reordering."""

import random

import numpy as np

from tmloom.llm import alignment as A

SCHEMA = "file_id string, chunk_index int, source_segment string, target_segment string, extra string"
TERM = {"report": "Bericht", "kitchen": "Küche", "pump": "Pumpe", "budget": "Haushalt", "invoice": "Rechnung", "cycle": "Zyklus", "garden": "Garten", "school": "Schule", "road": "Straße", "bridge": "Brücke"}
PLACE = ["Lovo", "Tamra", "Quibri", "Nelfen", "Orja", "Vratos", "Mikaf", "Sulgat", "Renzor", "Pemul", "Chiho", "Dargat"]
PLACE = [a + b for a in PLACE for b in ("", "ville", "dorf", "pur", "sud", "stadt")]


def sentence(rng):
    a, b = rng.sample(sorted(TERM), 2)
    p, n = rng.choice(PLACE), rng.randint(2, 99) * 1000 + rng.randint(1, 999)
    return rng.choice([
        (f"The {a} in {p} costs {n:,} EUR.", f"Der {TERM[a]} in {p} kostet {n:,}".replace(",", ".") + " EUR."),
        (f"Without the {a} the {b} of {p} cannot be completed.", f"Ohne den {TERM[a]} kann der {TERM[b]} von {p} nicht abgeschlossen werden."),
        (f"Heavy rain in {p} damaged the {a}.", f"Starker Regen in {p} beschädigte den {TERM[a]}."),
        (f"On 5 March 20{n % 80 + 10} {p} opened the {b}.", f"Am 5. März 20{n % 80 + 10} eröffnete {p} den {TERM[b]}.")])


def corpus(files, length, seed=4):
    rng = random.Random(seed)
    rows, want = [], set()
    for f in range(files):
        pairs = [sentence(rng) for _ in range(length)]
        src, tgt, i = [], [], 0
        while i < len(pairs):
            kind = rng.random()
            s, t = pairs[i]
            if kind < 0.06:
                src.append(s)  # left out on the other side
            elif kind < 0.14 and i + 1 < len(pairs):
                s2, t2 = pairs[i + 1]
                src += [s, s2]
                tgt.append(t[:-1] + ", und " + t2)
                want |= {(f"f{f}", len(src) - 2, len(tgt) - 1), (f"f{f}", len(src) - 1, len(tgt) - 1)}
                i += 1
            else:
                src.append(s)
                tgt.append(t)
                want.add((f"f{f}", len(src) - 1, len(tgt) - 1))
            i += 1
        for k in range(0, len(tgt) - 1, 9):  # swap neighbours
            tgt[k], tgt[k + 1] = tgt[k + 1], tgt[k]
            want = {(a, b, (k + 1 if c == k else k if c == k + 1 else c) if a == f"f{f}" else c) for a, b, c in want}
        for k in range(max(len(src), len(tgt))):
            rows.append((f"f{f}" if k % 5 else f" F{f} ", k, src[k] if k < len(src) else None, tgt[k] if k < len(tgt) else None, "x"))
    return rows, want


def scores(spark, rows, want):
    got = {(r.file, r.i, r.j) for r in A.align(spark.createDataFrame(rows, SCHEMA)).collect()}
    return len(got & want) / max(1, len(got)), len(got & want) / len(want)


def test_planted(spark):
    rows, want = corpus(20, 40)
    precision, recall = scores(spark, rows + rows[:50], want)
    assert precision > 0.95 and recall > 0.9


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 32)
    rows, want = corpus(3, 300)
    precision, recall = scores(spark, rows, want)
    assert precision > 0.9 and recall > 0.9


def test_words(spark):
    t = ["Am 13.05.2017 kosteten 213.000 EUR", "On 13 May 2017 213,000 EUR", "13/05/2017: 213 000", ""]
    got = [r.w for r in spark.createDataFrame([(x,) for x in t], "t string").select(A.sentence_words(A.F.col("t")).alias("w")).collect()]
    assert {"13", "m5", "2017", "213"} <= set(got[0]) and {"13", "2017", "213"} <= set(got[1]) and got[3] == []


def test_defined_cases(spark):
    rows = [(None, 0, "a b", "c d", None), ("f", None, "a b", "c d", None), ("f", 0, None, "c d", None), ("g", 0, " ", "...", None), ("h", 0, "only source", None, None)]
    assert A.align(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert A.align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fill(spark):
    rows, want = corpus(6, 30, seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.filled_segments(df, A.align(df)).collect()
    assert {r.alignment_type for r in got} >= {"1:1", "2:1"} and all(0 <= r.alignment_score <= 100 for r in got)


def test_moved_chapters_and_block_edges(spark, monkeypatch):
    """The second half of the translation comes first; the links are those of the file taken at once."""
    rows, want = corpus(1, 200)
    tgt = [r[3] for r in rows if r[3] is not None]
    half = len(tgt) // 2
    moved = tgt[half:] + tgt[:half]
    rows = [(f, k, s, moved[k] if k < len(tgt) else None, x) for f, k, s, _, x in rows]
    want = {(f, i, (j - half) % len(tgt)) for f, i, j in want}
    found = []
    for block in (512, 32, 7):
        monkeypatch.setattr(A, "BLOCK", block)
        found.append({tuple(r) for r in A.align(spark.createDataFrame(rows, SCHEMA)).collect()})
    links = {r[:3] for r in found[1]}
    assert found[0] == found[1] == found[2]
    assert len(links & want) / len(links) > 0.95 and len(links & want) / len(want) > 0.9


def test_merges_of_four():
    """Of four sentences merged into one, the far ones join through those between, whichever chose the target."""
    parts = [[f"s{i}x{k}" for k in range(4)] for i in range(4)]
    parts[0] += [f"more{k}" for k in range(20)]  # the first is the mutual one
    merged = [w for p in parts for w in p]
    other = [[f"o{i}x{k}" for k in range(4)] for i in range(12)]
    number: dict[str, int] = {}
    codes = lambda sents: [np.array([number.setdefault(w, 4 * len(number) + 4) for w in ws]) for ws in sents]
    src, tgt, none = codes(parts + other), codes([merged, *other]), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    doc = A.Pairs(np.arange(len(src)), src, np.arange(len(tgt)), tgt, none)
    assert {(a, b) for a, b, _ in doc.links() if b == 0} == {(k, 0) for k in range(4)}
    turned = A.Pairs(np.arange(len(tgt)), tgt, np.arange(len(src)), src, none)
    assert {(a, b) for a, b, _ in turned.links() if a == 0} == {(0, k) for k in range(4)}


def test_languages_are_found(spark):
    """Files in two languages: each language is one group, whatever words they share."""
    de, fr, it = "der die und ist wird den ein von EUR".split(), "le la les et est une pour des EUR".split(), "il gli con per una sono EUR del che".split()
    rng = random.Random(5)
    rows = []
    for f in range(60):
        own = (de, fr, it)[f % 3]
        for k in range(6):
            rows.append((f"f{f}", k, "the one", " ".join(rng.sample(own, 5)) + f" name{f}x{k}", None))
    got = A.with_language(A.sentences(spark.createDataFrame(rows, SCHEMA))).select("file", "lang").distinct().collect()
    by = {r.file: r.lang for r in got}
    assert len(got) == 60 and [len({by[f"f{f}"] for f in range(60) if f % 3 == n}) for n in range(3)] == [1, 1, 1] and len(set(by.values())) == 3


def test_a_chapter_moved_far(spark, monkeypatch):
    """The target side of a long document turned by half of its length; with so many sentences the places must be many too."""
    monkeypatch.setitem(globals(), "PLACE", [f"{a}{b}" for a in PLACE for b in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "wo", "xa", "ze")])
    rows, want = corpus(1, 3000)
    n = max(r[1] for r in rows) + 1
    tgt = [r[3] for r in rows]
    last = max(k for k, t in enumerate(tgt) if t is not None) + 1
    turn = last // 2
    moved = [(f, k, s, tgt[(k + turn) % last] if k < last else None, x) for k, (f, _, s, _, x) in enumerate(rows)]
    want = {(f, i, (j - turn) % last) for f, i, j in want}
    precision, recall = scores(spark, moved, want)
    assert precision >= 0.95 and recall >= 0.9
