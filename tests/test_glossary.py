"""Glossary queries and operators against plain recounts."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tmloom.functions import text as T
from tmloom.functions.similarity import ratio
from tmloom.operators import glossary
from tmloom.plans import retrieval
from tmloom.plans.base import segments


def test_new_terms_against_all_automatic_entries(spark, sf):
    """A term that another segment of the project has is not new, whatever its first letter."""
    first = F.lower(T.strip(F.split_part("source", F.lit(" "), F.lit(1))))
    rows = [tuple(r) for r in segments(spark, sf).filter("source is not null and project_id is not null").select("id", "project_id", first).collect()]
    manual = {(r.scope, r.k) for r in retrieval._terms(spark, sf).select("scope", F.lower(T.strip(F.col("term"))).alias("k")).collect()}
    owners = defaultdict(set)
    for i, p, t in rows:
        owners[p, t].add(i)
    want = sorted(r for r in rows if r[1:] not in manual and owners[r[1:]] == {r[0]})
    assert sorted(tuple(r) for r in retrieval.glossary_new_terms(spark, sf).collect()) == want


def test_fuzzy_hits_against_all_runs(spark):
    """Edits near both ends, other lengths and terms of many words: all runs of as many words that are alike."""
    terms = [("t1", "p", "international programme"), ("t2", "p", "abcdefghijklmn"), ("t3", "p", "abcdefghijklmnopqr"), ("t4", "p", "office for the protection of monuments"),
             ("t5", "p", "bridge"), ("t6", "p", "water pump"), ("t7", "q", "water pump"), ("t8", "p", ""), ("t9", "p", "abc"), ("ta", "p", "abcdefghi")]
    rng, words = random.Random(5), "international programme bridge water pump office for the protection of monuments abcdefghijklmn abcdefghi".split()
    texts = ["An Xnternational programmX began.", "see xyzabcdefghijklmn there", "abcXdefgYhijkZlmnoWpqr", "The office for the protection of monument opened", "the office for the protektion of monuments",
             "office for the protection of monuments", "bridgge of wather pump", "ab cdefghijklmn", "abcXdefYghi", None]
    for _ in range(60):
        t = list(" ".join(rng.choice(words) for _ in range(8)))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz s")
        texts.append("".join(t))
    segs = [(f"s{k:02d}", "pq"[k % 7 == 6], t) for k, t in enumerate(texts)] + [("n", None, "bridge")]
    s, t = spark.createDataFrame(segs, "id string, scope string, source string"), spark.createDataFrame(terms, "term_id string, scope string, term string")
    hits = glossary.phrase_hits(s, t)
    sure = {(r.id, r.term_id) for r in hits.collect()}
    assert ("s05", "t4") in sure
    want = {}
    for i, p, x in segs:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        for j, q, term in terms:
            v = re.findall(r"[^\W_]+", term.lower())
            for at in range(len(w) - len(v) + 1):
                run = " ".join(w[at:at + len(v)])
                if p == q and (i, j) not in sure and (i, j) not in want and len(term) >= 4 and len(run) >= 4 and ratio(run, " ".join(v)) >= 90:
                    want[i, j] = (at, round(ratio(run, " ".join(v)), 2))
    assert {("s00", "t1"), ("s01", "t2"), ("s02", "t3"), ("s04", "t4"), ("s08", "ta")} <= set(want)
    assert {(r.id, r.term_id): (r.at, r.ratio) for r in glossary.fuzzy_hits(s, t, hits).collect()} == want


def test_runs_are_not_written(spark, monkeypatch):
    """Sentences of a scope in several blocks: every hit of both kinds, and only the sentences themselves are written."""
    monkeypatch.setattr(glossary, "BLOCK_ROWS", 7, raising=False)
    written, write = [], glossary.materialise
    monkeypatch.setattr(glossary, "materialise", lambda df, label: written.append(label) or write(df, label))
    s = spark.createDataFrame([(f"s{k:02d}", "p", f"Number {k} of the {'international programmes' if k % 2 else 'international programmme'}") for k in range(40)], "id string, scope string, source string")
    t = spark.createDataFrame([("t", "p", "international programme")], "term_id string, scope string, term string")
    hits = glossary.phrase_hits(s, t)
    assert {(r.id, r.at) for r in hits.collect()} == {(f"s{k:02d}", 4) for k in range(1, 40, 2)}
    assert {(r.id, r.at, r.ratio) for r in glossary.fuzzy_hits(s, t, hits).collect()} == {(f"s{k:02d}", 4, 97.87) for k in range(0, 40, 2)}
    assert not {"runs", "grams", "prefixes"} & set(written)
