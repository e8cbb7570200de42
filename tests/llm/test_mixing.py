"""Mixing: shares, repeats, raking, defined cases."""

import numpy as np
import pytest

from tmloom.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(n=600):
    out = []
    for i in range(n):
        s = "big" if i % 10 < 6 else "Mid-Size " if i % 10 < 9 else "small"
        out.append((i, f"Report number {i} about the {['budget', 'garden', 'bridge'][i % 3]} " * (1 + i % 4), ["en", "DE", None][i % 3], s, None))
    return out


def test_shares(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.3, 2), ("SMALL", 0.2, 4), ("absent", 0.1, 3), ("big", 0.9, 9)], TARGETS)
    d = spark.createDataFrame(docs() + [(9001, None, "en", "big", None), (9002, "x", "en", None, None), (9003, "x", "en", "other", None), (9004, "", "en", "big", None)], DOCS)
    copies, report = M.mix(d, t)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "mid_size", "small", "absent"}
    for s, share in (("big", 0.5), ("mid_size", 0.3), ("small", 0.2)):
        assert r[s].actual_share == pytest.approx(share, abs=0.01)
        assert r[s].copies <= r[s].documents * r[s].max_repeats
    assert r["absent"].used_tokens == 0
    got = copies.collect()
    assert max(x.copies for x in got if x.source == "small") <= 4 and min(x.copies for x in got) >= 1
    assert sum(x.tokens * x.copies for x in got) == sum(x.used_tokens for x in r.values())


def test_short_source_gives_all_its_passes():
    want = M.source_totals(np.array([100.0, 1000.0, 10.0, 0.0]), np.array([0.4, 0.4, 0.2, 0.3]), np.array([1, 1, 3, 5]), 500)
    assert want[2] == 30 and want[0] == 100 and want[1] == pytest.approx(370) and want[3] == 0
    exact = M.source_totals(np.array([100.0, 1000.0, 10.0]), np.array([0.4, 0.4, 0.2]), np.array([1, 1, 3]), None)
    assert exact / exact.sum() == pytest.approx([0.4, 0.4, 0.2]) and exact[2] == 30


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    src, lang, topic = (x.ravel() for x in np.meshgrid(range(3), range(2), range(2), indexing="ij"))
    tokens = rng.uniform(50, 100, 12)
    want = np.array([60.0, 90.0, 120.0])
    w = M.rake(tokens, src, lang, topic, want, np.array([5, 5, 5]), lang_share=np.array([0.5, 0.5]))
    assert np.bincount(src, w * tokens) == pytest.approx(want)
    assert np.bincount(lang, w * tokens) == pytest.approx([135, 135], rel=1e-3)
    assert (w <= 5).all() and (w >= 0).all()


def test_empty(spark):
    t = spark.createDataFrame([("big", 0.5, 1)], TARGETS)
    copies, report = M.mix(spark.createDataFrame([], DOCS), t)
    assert copies.count() == 0 and [x.used_tokens for x in report.collect()] == [0]


def test_shares_and_marginals_of_the_tables(spark, sf):
    """On the tables: no source over its passes, its share met up to a document's size, all three axes reported."""
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    copies, report, marginals = M.mix_with_marginals(read("documents"), read("mix_targets"))
    r = report.collect()
    used = sum(x.used_tokens for x in r)
    longest = copies.agg({"tokens": "max"}).first()[0]
    live = sum(x.target_share for x in r if x.available_tokens)
    assert used > 0
    for x in r:
        assert x.copies <= x.documents * x.max_repeats
        if x.available_tokens:
            assert abs(x.used_tokens - x.target_share / live * used) <= 2 * longest + 0.01 * used, x
    m = marginals.collect()
    assert {x.axis for x in m} == {"source", "language", "topic"}
    for axis in ("source", "language", "topic"):
        own = [x for x in m if x.axis == axis]
        assert sum(x.wanted_share for x in own) == pytest.approx(1, abs=1e-3) and sum(x.actual_share for x in own) == pytest.approx(1, abs=1e-3)
        assert sum(x.used_tokens for x in own) == used


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "SOURCES", 1)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    with pytest.raises(ValueError):
        M.mix(spark.createDataFrame([], DOCS), t)


def test_topics_are_fitted_on_all_documents(spark, monkeypatch):
    """All rows go into the model, which is the same however they lie."""
    rows = [(i, ([f"The parliament debated the agricultural subsidy number {i}", f"Photosynthesis in chloroplasts, experiment {i}"][i % 2]), "en", "big", None) for i in range(2100)]
    table = lambda r, n: spark.createDataFrame(r, DOCS).repartition(n)
    topics = lambda r, n: {x.doc_id: x.topic for x in M.weighed(table(r, n), ["big"]).collect()}
    got = topics(rows, 1)
    assert got == topics(rows[::-1], 5)
    assert not {got[i] for i in range(0, 2100, 2)} & {got[i] for i in range(1, 2100, 2)}
    asked, fit = [], M.fit_topics
    monkeypatch.setattr(M, "fit_topics", lambda f, *a: asked.append(len(f) if isinstance(f, np.ndarray) else f.count()) or fit(f, *a))
    M.weighed(table(rows, 2), ["big"])
    assert asked == [2100]
