"""Evaluation leaks: against a search for word runs, radius, defined cases."""

import random

import numpy as np

from tmloom.llm import eval_leaks as E

WORDS = [f"w{i}" for i in range(400)]


def brute(docs, items):
    out = set()
    for i, t in items:
        w = E.words(t)
        k = min(E.PASSAGE_WORDS, len(w))
        grams = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, text in docs:
            x = E.words(text)
            if any(tuple(x[j:j + k]) in grams for j in range(len(x) - k + 1)):
                out.add((d, i))
    return out


def make(seed):
    random.seed(seed)
    text = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
    items = [(i, text(random.choice([1, 3, 8, 11, 12, 13, 40]))) for i in range(30)] + [(99, ""), (98, None), (97, "  .. ")]
    docs = [(i, text(random.choice([0, 5, 60]))) for i in range(60)] + [(900, None), (901, "")]
    for d in range(100, 140):
        _, t = random.choice(items[:30])
        w = t.split()
        n = random.choice([len(w), 11, 12, 13])
        s = random.randrange(max(1, len(w) - n + 1))
        docs.append((d, text(20) + " – „" + " / ".join(w[s:s + n]).upper() + "“; " + text(10)))
    return docs, items


def test_against_brute(spark):
    docs, items = make(5)
    docs += docs[:3]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items + items[:2], "item_id long, item_text string")
    got = E.eval_leaks(d, i)
    rows = [(r.doc_id, r.item_id) for r in got.filter("verbatim").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = make(6)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    monkeypatch.setattr(E, "ITEM_BLOCK_CHARS", 500)
    assert {(r.doc_id, r.item_id) for r in E.eval_leaks(d, i).filter("verbatim").collect()} == brute(docs, items)


def test_stretches(monkeypatch):
    docs, items = make(7)
    index = E.build_index([x for x in items if x[1]])
    whole = E.leaks_of_batch([d for d, _ in docs], [t for _, t in docs], index)
    monkeypatch.setattr(E, "STRETCH_WORDS", 17)
    cut = E.leaks_of_batch([d for d, _ in docs], [t for _, t in docs], index)
    key = lambda p: sorted(zip(p.doc_id, p.item_id, p.windows, p.verbatim))
    assert key(whole) == key(cut)


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    ix = E.ItemIndex(12)
    ix.fp = list(rng.integers(0, 2**63, 300, dtype=np.uint64))
    ix.item, ix.sh, ix.wt = [0] * 300, [[0]] * 300, [[0]] * 300
    ix.close()
    q = ix.fp.copy()
    for k in range(len(q)):
        for b in rng.choice(64, k % 6, replace=False):
            q[k] ^= np.uint64(1) << np.uint64(b)
    a, i = ix.lookup(q)
    near = {(x, y) for x in range(300) for y in range(300) if int(q[x] ^ ix.fp[y]).bit_count() <= E.RADIUS}
    assert set(zip(a.tolist(), i.tolist())) == near


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, item_text string")
    assert E.eval_leaks(d, i).count() == 0


def test_similar_windows_against_brute(spark):
    """Passages with edited words: every pair of windows that is similar enough, however far its fingerprints are apart."""
    def windows(text):
        w = E.words(text)
        return w, [w[j:j + k] for k in [min(E.PASSAGE_WORDS, len(w))] for j in range(len(w) - k + 1)] if w else []

    def bag(w, size):
        return {tuple(w[j:j + size]): sum(map(E.word_weight, w[j:j + size])) for j in range(len(w) - size + 1)}

    rng = random.Random(11)
    short = ["of", "a", "to", "in", "it", "we", "by", "on"]
    # windows that begin with short words keep most of their weight when one of these changes
    text = lambda n: " ".join(rng.choice(short if k % 12 < 3 else WORDS[100:]) for k in range(n))
    items = [(i, text(rng.choice([3, 7, 12, 12, 20]))) for i in range(40)] + [(40, "a b a b a b a b a b a b")]
    docs = []
    for d in range(160):
        w = rng.choice(items)[1].split()
        for k in rng.choice([[0], [-1], [0, -1], [1], [len(w) // 2], []]):
            w[k] = rng.choice(short)
        docs.append((d, text(rng.choice([0, 9])) + " " + " ".join(w) + " " + text(rng.choice([0, 9]))))
    want = {}
    for i, t in items:
        _, passages = windows(t)
        size = min(E.SHINGLE_WORDS, len(passages[0]))
        for d, u in docs:
            x = E.words(u)
            for p in passages:
                a = bag(p, size)
                for j in range(len(x) - len(p) + 1):
                    b = bag(x[j:j + len(p)], size)
                    inter = sum(v for s, v in a.items() if s in b)
                    if inter / (sum(a.values()) + sum(b.values()) - inter) >= E.SIMILARITY:
                        want[d, i] = want.get((d, i), 0) + 1
    got = E.eval_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    rows = {(r.doc_id, r.item_id): (r.windows, r.verbatim) for r in got.collect()}
    assert {k: n for k, (n, _) in rows.items()} == want
    assert sum(not v for _, v in rows.values()) > 10


def test_edited_passages_with_single_words(spark):
    """Passages of twelve words with one word changed, anywhere: at least nine of ten are found by single words."""
    rng = random.Random(21)
    items = [(i, " ".join(rng.sample(WORDS, 30))) for i in range(60)]
    docs = []
    for d in range(240):
        w = items[d % 60][1].split()
        s = rng.randrange(19)
        w = w[s:s + 12]
        w[rng.randrange(12)] = "changed"
        docs.append((d, " ".join(rng.choice(WORDS) for _ in range(30)) + " " + " ".join(w) + " tail"))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in E.eval_leaks(d, i, shingle_words=1).collect()}
    want = {(k, k % 60) for k in range(240)}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 5
