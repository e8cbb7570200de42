"""Glossary terms in text: phrase matches, and a fuzzy second chance.

Sentences meet the terms of their scope in tasks, in blocks: a term is looked up among
the word sequences of a sentence, or by pieces of it, so no term is tested against every
sentence, and no word sequence is written.

Defined cases: terms without words never match; letter case and tags are ignored;
of several hits of a term in a sentence the first counts; a null scope matches none.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tmloom.functions import text as T
from tmloom.operators import fuzzy
from tmloom.session import materialise

WORD = r"[\p{L}\p{N}]+"
#: letters of a term for the fuzzy second chance
SHORTEST = 4
#: sentences of a scope in a task, which holds all terms of the scope
BLOCK_ROWS = 8192
#: pairs of terms and runs that are compared at once
PAIRS = 500_000


# fixed values: endings that go, first to last, in words of four letters or more (pattern, what stays)
ENDINGS = ((r"([a-z]{2})ies$", r"\1y"), (r"(ss|sh|ch|x|z)es$", r"\1"), (r"([^su])s$", r"\1"), (r"([a-z]{2})'$", r"\1"))
IRREGULAR = {"children": "child", "men": "man", "women": "woman", "people": "person", "indices": "index", "criteria": "criterion", "data": "datum", "annexes": "annex"}


def lemma(word: Column) -> Column:
    """The offline stand-in for a language's lemma: lower case, irregular plurals by a list, else the ending of the plural off."""
    low = F.lower(word)
    cut = low
    for pattern, stays in ENDINGS:
        cut = F.regexp_replace(cut, pattern, stays.replace("\\", "$"))
    known = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return F.coalesce(known[low], F.when(F.length(low) >= 4, cut).otherwise(low))


def lemma_sql(word: str) -> str:
    """``lemma`` in SQL."""
    cut = f"lower({word})"
    for pattern, stays in ENDINGS:
        cut = f"regexp_replace({cut}, '" + pattern.replace("'", "''") + f"', '{stays}')"
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return f"(CASE lower({word}) {whens} ELSE CASE WHEN length({word}) >= 4 THEN {cut} ELSE lower({word}) END END)"


def lemma_words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(T.strip_tags(c), F.lit(WORD), F.lit(0)), lemma)


def _met(sentences: DataFrame, phrases: DataFrame, find: Callable[[list[str], list[str]], Iterator[tuple]]) -> DataFrame:
    """``id, scope, phrase, at, ratio`` of the hits that ``find`` has of the phrases in the texts of a scope.

    ``sentences`` has ``id, scope, text`` and is read twice; ``phrases`` has ``scope, phrase``. Large scopes go in blocks, with
    the phrases to each; small ones together. Runs of words are made within the tasks and never written.
    """
    bins = max(1, math.ceil(sentences.count() / BLOCK_ROWS))
    sizes = sentences.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(phrases.select("scope").distinct(), "scope").select(
        "scope", "blocks", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("scope"), F.lit(bins)).cast("string")).otherwise(F.concat(F.lit("s"), F.col("scope").cast("string"))).alias("bin"))
    placed = (sentences.join(sizes, "scope").select("bin", F.pmod(F.xxhash64("id", "text"), "blocks").cast("int").alias("block"), "scope", "id", "text", F.lit(False).alias("term"))
              .unionByName(phrases.join(sizes, "scope").select("bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "scope", F.lit(None).cast(sentences.schema["id"].dataType).alias("id"),
                                                               F.col("phrase").alias("text"), F.lit(True).alias("term"))))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": pdf["id"].iloc[:0], "scope": pdf["scope"].iloc[:0], "phrase": pdf["text"].iloc[:0], "at": np.zeros(0, np.int32), "ratio": np.zeros(0)})]
        for scope, own in pdf.groupby("scope", sort=False):
            term = own["term"].to_numpy(bool)
            terms, texts, ids = own["text"][term].tolist(), own["text"][~term].tolist(), own["id"].to_numpy()[~term]
            if terms and texts:
                for row, t, at, ratio in find(terms, texts):
                    out.append(pd.DataFrame({"id": ids[row], "scope": scope, "phrase": np.array(terms, object)[t], "at": np.asarray(at, np.int32), "ratio": ratio}))
        return pd.concat(out)

    kind = {c: sentences.schema[c].dataType.simpleString() for c in ("id", "scope")}
    return placed.groupBy("bin", "block").applyInPandas(search, f"id {kind['id']}, scope {kind['scope']}, phrase string, at int, ratio double")


def _words_at(text: str) -> tuple[list[int], list[int]]:
    """Where the words begin and end."""
    ends = [i for i, c in enumerate(text) if c == " "]
    return [0, *(i + 1 for i in ends)], [*ends, len(text)]


def _exact(terms: list[str], texts: list[str]) -> Iterator[tuple]:
    """Row, term, first word and 100 for each term that is a run of words of the text."""
    place, lengths = {t: k for k, t in enumerate(terms)}, sorted({t.count(" ") + 1 for t in terms})
    rows, which, at = [], [], []
    for row, text in enumerate(texts):
        begin, end = _words_at(text)
        for n in lengths:
            for w in range(len(begin) - n + 1):
                k = place.get(text[begin[w]:end[w + n - 1]])
                if k is not None:
                    rows.append(row)
                    which.append(k)
                    at.append(w)
    if rows:
        yield np.array(rows), np.array(which), np.array(at), np.full(len(rows), 100.0)


def _like(least: float) -> Callable[[list[str], list[str]], Iterator[tuple]]:
    """The same for runs of as many words that are ``least`` percent like the term.

    A term that can differ by D insertions and deletions is cut into D + 1 pieces: one of them stands in the run, moved by D
    letters at most.
    """
    def find(terms: list[str], texts: list[str]) -> Iterator[tuple]:
        index: dict[int, dict[str, list]] = {}
        everywhere, words, most = [], [t.count(" ") + 1 for t in terms], []
        for k, t in enumerate(terms):
            m = len(t)
            edits = math.floor((100 - least) * (m + math.floor(m * (200 - least) / least + fuzzy.SLACK)) / 100 + fuzzy.SLACK)
            most.append(edits)
            if edits + 1 > m:
                everywhere.append(k)
                continue
            cuts = [m * i // (edits + 1) for i in range(edits + 2)]
            for o, e in zip(cuts, cuts[1:]):
                index.setdefault(e - o, {}).setdefault(t[o:e], []).append((k, o))
        found, runs = [], {}

        def compared() -> Iterator[tuple]:
            if not found:
                return
            row, k, at, run = np.array(found).T
            pairs, back = np.unique(k * len(runs) + run, return_inverse=True)
            a, b = pairs // len(runs), pairs % len(runs) + len(terms)
            both = [*terms, *runs]
            n = np.array([len(t) for t in both])
            counts = fuzzy.counts_of(*fuzzy.places_of(both))
            ratio = np.zeros(len(a))
            for c in range(0, len(a), 100_000):
                x, y = a[c:c + 100_000], b[c:c + 100_000]
                near = np.flatnonzero(np.abs(counts[x] - counts[y]).sum(1) <= (100 - least) / 100 * (n[x] + n[y]) + fuzzy.SLACK)
                ratio[c + near] = 200.0 * fuzzy.common(both, x[near], y[near]) / (n[x[near]] + n[y[near]])
            ok = ratio[back] >= least
            if ok.any():
                yield row[ok], k[ok], at[ok], ratio[back][ok]

        for row, text in enumerate(texts):
            begin, end = _words_at(text)
            pairs = {(k, w) for k in everywhere for w in range(len(begin))}
            for size, pieces in index.items():
                for p in range(len(text) - size + 1):
                    for k, o in pieces.get(text[p:p + size], ()):
                        for w in range(bisect_left(begin, p - o - most[k]), bisect_right(begin, p - o + most[k])):
                            pairs.add((k, w))
            for k, w in pairs:
                if w + words[k] <= len(begin):
                    run = text[begin[w]:end[w + words[k] - 1]]
                    if len(run) >= SHORTEST and abs(len(run) - len(terms[k])) <= most[k]:
                        found.append((row, k, w, runs.setdefault(run, len(runs))))
            if len(found) >= PAIRS:
                yield from compared()
                found.clear()
                runs.clear()
        yield from compared()

    return find


def matcher(terms: DataFrame) -> DataFrame:
    """``term_id, scope, phrase, n_words``: the terms as they are matched; those without words are left out."""
    return terms.select("term_id", "scope", lemma_words(F.col("term")).alias("w")).filter(F.size("w") > 0).select("term_id", "scope", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n_words"))


def phrase_hits(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, term_id, at``: terms of the scope in the segment, and the word they begin at.

    ``segments`` has ``id, scope, source``; ``terms`` has ``term_id, scope, term``.
    """
    t = matcher(terms).select("term_id", "scope", "phrase")
    w = materialise(segments.filter("source is not null and scope is not null").select("id", "scope", F.array_join(lemma_words(F.col("source")), " ").alias("text")), "lemmas")
    return _met(w, t.select("scope", "phrase").distinct(), _exact).join(t, ["scope", "phrase"]).groupBy("id", "term_id").agg(F.min("at").alias("at"))


def fuzzy_hits(segments: DataFrame, terms: DataFrame, hits: DataFrame, least: float = 90.0) -> DataFrame:
    """``id, term_id, at, ratio``: of terms without a phrase hit, the first like-sounding run of as many words.

    Runs and terms meet in a piece of the term, of which there is one more than ``least`` allows edits.
    """
    plain = lambda c: F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)
    t = terms.select("term_id", "scope", F.array_join(plain(F.col("term")), " ").alias("phrase")).filter(F.length("phrase") >= SHORTEST)
    w = materialise(segments.filter("source is not null and scope is not null").select("id", "scope", F.array_join(plain(T.strip_tags(F.col("source"))), " ").alias("text")), "words")
    cand = _met(w, t.select("scope", "phrase").distinct(), _like(least)).join(t, ["scope", "phrase"]).join(hits.select("id", "term_id"), ["id", "term_id"], "left_anti")
    return cand.groupBy("id", "term_id").agg(F.min(F.struct("at", "ratio")).alias("f")).select("id", "term_id", F.col("f.at").alias("at"), F.round("f.ratio", 2).alias("ratio"))


def upserted(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """``term_id, scope, term, lemmas``: the entries with those in ``changed`` new or replaced; the matched words are made anew."""
    rows = entries.join(changed.select("term_id").distinct(), "term_id", "left_anti").unionByName(changed.select(*entries.columns))
    return rows.select("term_id", "scope", "term", lemma_words(F.col("term")).alias("lemmas"))


def acceptable(source: Column, target: Column) -> Column:
    """Whether an extracted pair is a term: both sides there, longer than two letters, not the same, not both an abbreviation."""
    s, t = T.strip(source), T.strip(target)
    short = (s == F.upper(s)) & (t == F.upper(t)) & (F.length(s) <= 6)
    return (s != "") & (t != "") & (F.lower(s) != F.lower(t)) & ~short & (F.length(s) > 2)


def new_terms(extracted: DataFrame, manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Extracted terms that no manual entry and no other segment's automatic entry has."""
    key = F.lower(T.strip(F.col("term")))
    out = extracted.withColumn("__k", key)
    out = out.join(manual.select("scope", key.alias("__k")).distinct(), ["scope", "__k"], "left_anti")
    other = automatic.select("scope", key.alias("__k"), F.col("segment_id").alias("__s"))
    owners = other.groupBy("scope", "__k").agg(F.min("__s").alias("__a"), F.max("__s").alias("__b"))
    taken = (F.col("__a") != F.col("segment_id")) | (F.col("__b") != F.col("segment_id"))
    return out.join(owners, ["scope", "__k"], "left").filter(F.col("__a").isNull() | ~taken).drop("__k", "__a", "__b")
