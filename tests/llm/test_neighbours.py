"""Nearest neighbours: recall against brute force, copies, blocks, defined cases."""

import numpy as np

from tmloom.llm import neighbours as V
from tmloom.session import materialise

SCHEMA = "id string, embedding array<float>, vec string"


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 12, dim))
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim)) * 0.35
    return (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


def brute(ids, x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for r in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda c: (-round(s[r, c], 9), ids[c]))[:k]
        out |= {(ids[r], ids[c]) for c in order if s[r, c] >= least}
    return out


def search(spark, ids, x, k=3, least=None):
    df = spark.createDataFrame([(i, [float(v) for v in row], None) for i, row in zip(ids, x)], SCHEMA)
    return V.nearest(materialise(V.usable(df, "id", "embedding", x.shape[1]), "test"), k, least)


def recall(spark, n, least):
    x = clustered(n)
    ids = [f"v{i:05d}" for i in range(n)]
    got = {(r.id, r.other_id) for r in search(spark, ids, x, 3, least).collect()}
    want = brute(ids, x, 3, least)
    return len(got & want) / len(want)


def test_recall(spark):
    assert recall(spark, 3000, 0.85) >= 0.97
    assert recall(spark, 600, -1.0) >= 0.9


def test_blocks_hold_the_same(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 20)
    assert recall(spark, 800, 0.85) >= 0.97


def test_copies(spark):
    x = np.array([[1, 0, 0, 0]] * 40 + [[1, 0.1, 0, 0]] * 2 + [[0, 1, 0, 0], [0, 1, 0.05, 0]], np.float32)
    ids = [f"v{i:02d}" for i in range(len(x))]
    got = {(r.id, r.other_id) for r in search(spark, ids, x, 3).collect()}
    assert got == brute(ids, x, 3, -2)
    pairs = V.similar_pairs(search(spark, ids, x, 3, 0.85)).collect()
    assert all(r.low_id < r.high_id for r in pairs) and len(pairs) == len(set(pairs))


def test_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0], None), ("a", [1.0, 0.0], None), ("b", [nan, 1.0], None), ("c", [inf, 1.0], None), ("d", [0.0, 0.0], None), ("e", None, None), ("f", [None, 1.0], None),
            ("g", [1.0], None), (None, [1.0, 1.0], None), ("h", [2.0, 0.1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = V.nearest(materialise(V.usable(df, "id", "embedding", 2), "test"), 3).collect()
    assert sorted((r.id, r.other_id) for r in got) == [("a", "h"), ("h", "a")]
    empty = spark.createDataFrame([], SCHEMA)
    assert V.nearest(materialise(V.usable(empty, "id", "embedding", 2), "test"), 3).count() == 0


def test_recall_with_many_cells(spark, monkeypatch):
    """Cells named by two codebooks, as many for each vector as large tables have: the neighbours are still found."""
    monkeypatch.setattr(V, "PER_CELL", 1)
    monkeypatch.setattr(V, "FIRST_WORDS", 32)
    rng, n = np.random.default_rng(2), 6000
    centre = rng.normal(size=(n // 4, 64))
    x = (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, 64)) * 0.41).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(n)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(ids[r], ids[c]) for r, row in enumerate(np.argpartition(-s, 3, axis=1)[:, :3]) for c in row if s[r, c] >= 0.85}
    got = {(r.id, r.other_id) for r in search(spark, ids, x, 3, 0.85).collect()}
    assert len(want) > 10_000 and len(got & want) >= 0.995 * len(want)
