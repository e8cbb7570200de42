"""Fuzzy joins of texts by insertion-deletion similarity.

The self-join compares all texts of a scope in blocks and writes no candidates: a task
holds two blocks, bounds by the length, the runs and the counts of letters leave few of
their pairs, and for these the longest common subsequence is computed, for all at once.
Only the best of each text leave the task. The work grows with the square of a scope.

The join of texts with others (``similar_pairs``) takes candidates from a prefix filter:
a text of length L that is at least r percent like another differs from it in at most D
insertions and deletions, and each of these touches at most q of its q-letter runs, so of
its runs ordered from rare to frequent the first q*D + 1 hold one that the other text has,
if the two have any in common. That they have is certain for pairs of some total length
on; shorter pairs meet by shorter runs (``bands``). Only pairs that share such a run meet;
a length band and the engine's bounded edit distance thin them out before the exact
similarity is computed.

Equal texts are collapsed first. Defined cases: null and short texts take no part;
a text never matches itself or an equal one; ties order by text id.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tmloom.functions.similarity import indel_ratio, lcs_length
from tmloom.session import materialise

GRAM = 4
MIN_LENGTH = 5
#: bounds are rounded down from a little above, so that none comes out one too low; the exact similarity decides
SLACK = 1e-6
#: texts in a block of the self-join, of which a task holds two; texts compared at once
BLOCK_ROWS = 4096
TILE = 512
#: letters of the runs that are counted in the self-join, and the number of their hash values
RUN = 3
BUCKETS = 512
#: longer texts are compared one by one
LONG = 1024


def most_edits(total: Column, least: float) -> Column:
    """At most so many insertions and deletions separate two texts of that total length."""
    return F.floor((100 - least) * total / 100 + SLACK).cast("int")


def longest(n: Column, least: float) -> Column:
    """A partner of a text of ``n`` letters is at most so long."""
    return F.floor(n * (200 - least) / least + SLACK).cast("int")


def bands(least: float, shortest: int) -> list[tuple[int, int, int | None]]:
    """``(q, low, high)``: pairs with ``low <= total length < high`` share a run of ``q`` letters for certain.

    Of two texts with the total length S and d edits between them, at least
    S / 2 - (q - 1) - (q - 1/2) * d runs of q letters are untouched; d has the parity of S.
    """
    def shares(total: int, q: int) -> bool:
        d = math.floor((100 - least) * total / 100 + SLACK)
        d -= (total - d) % 2
        return d < 0 or total / 2 - (q - 1) - (q - 0.5) * d >= 1

    out, high = [], None
    for q in range(GRAM, 0, -1):
        slope = 0.5 - (q - 0.5) * (100 - least) / 100
        if q > 1 and slope <= 0:
            continue
        low = 2 * shortest
        if q > 1:
            end = max(low, math.ceil((q + SLACK * q) / slope) + 1)  # from here on it holds without asking
            low = max((s + 1 for s in range(low, end) if not shares(s, q)), default=low)
        if high is None or low < high:
            out.append((q, low, high))
            high = low
        if low == 2 * shortest:
            break
    return out


def in_band(n: Column, least: float, low: int, high: int | None) -> Column:
    """Whether a text of ``n`` letters can have a partner with which it is in the band."""
    ok = n + longest(n, least) >= low
    return ok if high is None else ok & (n + F.ceil(n * least / (200 - least) - SLACK) < high)


def grams(c: Column, q: int = GRAM) -> Column:
    """The distinct runs of ``q`` letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: c.substr(i, F.lit(q))))


def prefix_length(n: Column, least: float, q: int) -> Column:
    """Of so many runs of a text of ``n`` letters a partner has one, if it has any."""
    return most_edits(n + longest(n, least), least) * q + 1


def places_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the texts as numbers, one after the other, and where each text begins (and the last ends)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def counts_of(letters: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The hashed counts of letters of each text."""
    n = len(start) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(start)) * 64 + letters % 64, minlength=n * 64).reshape(n, 64).astype(np.int32)


def _marks(letters: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed runs of ``RUN`` letters that each text has (a row of zeros and ones), and its hashed counts of letters."""
    n, row = len(start) - 1, np.repeat(np.arange(len(start) - 1), np.diff(start))
    runs = np.zeros((n, BUCKETS), np.float32)
    k = len(letters) - RUN + 1
    h = sum(letters[i:i + k].astype(np.uint64) * np.uint64((2654435761, 40503, 2246822519)[i]) for i in range(RUN))
    inside = row[:k] == row[RUN - 1:]
    runs[row[:k][inside], (h[inside] >> np.uint64(7)) % BUCKETS] = 1
    return runs, counts_of(letters, start)


def common(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, bit-parallel over all pairs at once."""
    n = np.array([len(t) for t in texts])
    out = np.zeros(len(a), np.int64)
    wide = np.maximum(n[a], n[b]) > LONG
    for k in np.flatnonzero(wide):
        out[k] = lcs_length(texts[a[k]], texts[b[k]])
    todo = np.flatnonzero(~wide)
    todo = todo[np.lexsort((a[todo], n[b[todo]]))]
    for s in range(0, len(todo), 20_000):
        at = todo[s:s + 20_000]
        own, x = np.unique(a[at], return_inverse=True)
        others, y = np.unique(b[at], return_inverse=True)
        letters, start = places_of([texts[i] for i in (*own, *others)])
        kinds, code = np.unique(letters, return_inverse=True)
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        place = np.arange(len(letters)) - start[row]
        mine = row < len(own)
        words = int(n[own].max() - 1) // 64 + 1
        masks = np.zeros((words, len(own) * (len(kinds) + 1)), np.uint64)  # the last kind stands behind the end of a text
        np.bitwise_or.at(masks, (place[mine] // 64, row[mine] * (len(kinds) + 1) + code[mine]), np.uint64(1) << (place[mine] % 64).astype(np.uint64))
        codes = np.full((int(n[others].max()), len(others)), len(kinds))
        codes[place[~mine], row[~mine] - len(own)] = code[~mine]
        v = np.full((words, len(at)), ~np.uint64(0))
        base = x * (len(kinds) + 1)
        for letter in codes:
            where, carry = base + letter[y], None
            for w in range(words):
                m = masks[w][where]
                total = v[w] + (v[w] & m)
                over = total < v[w]
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                v[w] = total | (v[w] & ~m)
        out[at] = np.bitwise_count(~v).sum(0)
    return out


def _alike(texts: list[str], left: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts of ``left`` and ``right`` (or of ``left`` alone) that are ``least`` percent alike, and how much.

    Each deletion from a text touches at most ``RUN`` of its runs and each insertion one less; the others stand in its
    partner. Letters that are not in both are edits themselves. Pairs that both bounds leave are compared in full.
    """
    n = np.array([len(t) for t in texts])
    left = left[np.argsort(n[left], kind="stable")]
    right_ = left if right is None else right[np.argsort(n[right], kind="stable")]
    runs, counts = _marks(*places_of(texts))
    kinds = runs.sum(1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for s in range(0, len(left), TILE):
        mine = left[s:s + TILE]
        low = np.searchsorted(n[right_], n[mine[0]] * least / (200 - least) - SLACK, side="left")
        high = np.searchsorted(n[right_], n[mine[-1]] * (200 - least) / least + SLACK, side="right")
        low = max(low, s) if right is None else low
        for t in range(low, high, 4 * TILE):
            theirs = right_[t:min(t + 4 * TILE, high)]
            x, y = n[mine][:, None].astype(np.float32), n[theirs][None, :].astype(np.float32)
            edits = np.floor((100 - least) / 100 * (x + y) * (1 + 1e-6) + 1e-3)  # in single precision: rather one too many
            both = runs[mine] @ runs[theirs].T
            # of the edits (e + x - y) / 2 are deletions from the first; RUN of its runs for each, and RUN - 1 for each of the others
            ok = (both >= kinds[mine][:, None] - ((RUN - 0.5) * edits + (x - y) / 2)) & (both >= kinds[theirs][None, :] - ((RUN - 0.5) * edits - (x - y) / 2)) & (np.abs(x - y) <= edits)
            if right is None:
                ok &= np.arange(s, s + len(mine))[:, None] < np.arange(t, t + len(theirs))[None, :]
            i, j = np.nonzero(ok)
            for c in range(0, len(i), 100_000):
                a, b, e = mine[i[c:c + 100_000]], theirs[j[c:c + 100_000]], edits[i[c:c + 100_000], j[c:c + 100_000]]
                near = np.abs(counts[a] - counts[b]).sum(1) <= e
                a, b = a[near], b[near]
                if len(a):
                    ratio = 200.0 * common(texts, a, b) / (n[a] + n[b])
                    keep = ratio >= least
                    found.append((a[keep], b[keep], ratio[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def similar_pairs(texts: DataFrame, others: DataFrame, least: float, shortest: int) -> DataFrame:
    """``scope, text, other, ratio``: the distinct pairs of a text and another text of its scope that are alike.

    ``texts`` has ``scope, text`` and ``others`` has ``scope, other``, of ``shortest`` letters at least; equal ones count too.
    """
    n, m = F.length("text"), F.length("other")
    a, b, pairs = texts.select("scope", "text").distinct(), others.select("scope", "other").distinct(), []
    for q, low, high in bands(least, shortest):
        runs = b.filter(in_band(m, least, low, high)).select("scope", "other", F.explode(grams(F.col("other"), q)).alias("g"))
        freq = runs.groupBy("scope", "g").agg(F.count("*").alias("df"))
        own = a.filter(in_band(n, least, low, high)).select("scope", "text", F.explode(grams(F.col("text"), q)).alias("g"))
        ranked = own.join(freq, ["scope", "g"], "left").groupBy("scope", "text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("gs"))
        prefix = ranked.select("scope", "text", F.explode(F.slice("gs", F.lit(1), prefix_length(n, least, q))).alias("s")).filter("s.df > 0").select("scope", "text", F.col("s.g").alias("g"))
        here = n + m >= low if high is None else (n + m >= low) & (n + m < high)
        pairs.append(prefix.join(runs, ["scope", "g"]).filter(here & (F.abs(n - m) <= most_edits(n + m, least))).select("scope", "text", "other").distinct())
    bound = most_edits(n + m, least)
    return (reduce(DataFrame.unionByName, pairs).withColumn("bound", bound).filter(F.expr("levenshtein(text, other, bound) >= 0")).drop("bound")
            .withColumn("ratio", indel_ratio("text", "other")).filter(F.col("ratio") >= least))


def similar_texts(texts: DataFrame, least: float = 90.0, keep: int = 5) -> DataFrame:
    """``scope, id, other_id, score``: per text the ``keep`` most similar other texts of its scope.

    ``texts`` has ``id, scope, text``; equal texts of a scope are one text under their smallest id.
    """
    u = materialise(texts.filter(F.col("text").isNotNull() & F.col("scope").isNotNull() & (F.length("text") >= MIN_LENGTH)).groupBy("scope", "text").agg(F.min("id").alias("id")), "texts")
    # large scopes in blocks, each of which meets each; small ones together, some to a task
    bins = max(1, math.ceil(u.count() / BLOCK_ROWS))
    sizes = u.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = (u.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64("text"), "blocks").cast("int"))
              .withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("scope"), F.lit(bins)).cast("string")).otherwise(F.concat(F.lit("s"), F.col("scope").cast("string"))))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("bin", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "scope", "id", "text"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pdf[["scope", "id"]].iloc[:0].assign(other_id=pdf["id"].iloc[:0], ratio=np.zeros(0))]
        for _, own in pdf.groupby("scope", sort=False):
            if len(own) < 2:
                continue
            block, i, j = own["block"].to_numpy(), own["i"].iloc[0], own["j"].iloc[0]
            a, b, ratio = _alike(own["text"].tolist(), np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j), least)
            if len(a):
                ids = own["id"].to_numpy()
                both = pd.DataFrame({"scope": own["scope"].iloc[0], "id": ids[np.concatenate([a, b])], "other_id": ids[np.concatenate([b, a])], "ratio": np.concatenate([ratio, ratio])})
                # more than ``keep`` of one text in a block can't be among its best
                out.append(both.sort_values(["ratio", "other_id"], ascending=[False, True]).groupby("id", sort=False).head(keep))
        return pd.concat(out)

    kind = {c: u.schema[c].dataType.simpleString() for c in ("scope", "id")}
    both = placed.groupBy("bin", "i", "j").applyInPandas(search, f"scope {kind['scope']}, id {kind['id']}, other_id {kind['id']}, ratio double")
    w = Window.partitionBy("scope", "id").orderBy(F.desc("ratio"), "other_id")
    return both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).select("scope", "id", "other_id", F.floor("ratio").cast("int").alias("score"))
