"""Sentence alignment of bilingual documents.

Method: sentences become bags of words weighted by their rarity in the document.
A translation table is learned from the documents themselves: sentences that share
rare names and numbers and choose each other give first pairs, the association of
words over the pairs gives a table, and the table gives better pairs. Source
sentences are translated into weighted target bags and looked up in an inverted
index of the target words, target sentences likewise in the other direction; pairs
that choose each other in both directions are links. A sentence left over joins the
link of its neighbour if that covers it (merged and split sentences).

A document is aligned as a whole, however far its sentences were moved: the inverted
index gives the pairs of the whole document that have a word in common, ``BLOCK`` source
sentences at a time, and only pairs with a score that matters are kept. A task holds
the words of one document; the table is joined to them and never sent whole. There is a
table for each language of the target side; which languages there are is found in the
documents (``with_language``).

Defined cases: null and blank sentences and rows without a document or place are no
sentences; a sentence delivered several times is one; of two texts at one place the
lesser counts; a sentence without words gets no link; equal scores prefer the lower
place; documents with one side only, and empty input, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tmloom.functions.keys import norm_key
from tmloom.session import materialise

#: at most so many source sentences, and about so many scores and their parts, are computed at a time
BLOCK = 512
CELLS = 4_000_000
#: documents are handed to Python about so many sentences at a time
TURN = 4096
ROUNDS = 3
MIN_ASSOCIATION = 0.2
LINK = 0.42
GROW = 0.55
SEED_LINK = 0.2
#: pairs of sentences left over near the place their neighbours' links point to: to learn from, and to keep
NEAR_SEED = 0.15
NEAR = 0.3
REACH = 3
#: what is left of a score if both sentences have numbers and share none
CLASH = 0.5
#: so many words tell languages apart, and groups of them so much alike are one language
COMMON = 200
GROUP_LIKENESS = 0.25

def sentence_words(text: Column) -> Column:
    """The distinct words of a sentence in a form both languages share.

    Day-month-year dates are taken apart, separators of thousands dropped and
    round thousands cut, so that numbers meet across notations.
    """
    t = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    t = F.regexp_replace(t, r"\b0?(\d{1,2})[./]0?(\d{1,2})[./](\d{4})\b", " $1 m$2 $3 ")
    t = F.regexp_replace(t, r"(?<=\d)[.,'\x{2019}\x{202F}\x{A0}\x{2009}](?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, r"\b(\d{1,3})(?:000)+\b", "$1")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def sentences(chunks: DataFrame, file_id: str = "file_id", place: str = "chunk_index",
              source: str = "source_segment", target: str = "target_segment") -> DataFrame:
    """``file, side, idx, words``: one row per sentence; ``side`` is s or t."""
    long = chunks.select(norm_key(file_id).alias("file"), F.col(place).cast("long").alias("idx"), F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col(source).alias("text")), F.struct(F.lit("t").alias("side"), F.col(target).alias("text")))).alias("x"))
    return (long.filter("file is not null and idx is not null and trim(x.text) <> ''")
            .groupBy("file", "idx", F.col("x.side").alias("side")).agg(F.min("x.text").alias("text"))
            .select("file", "side", "idx", sentence_words(F.col("text")).alias("words")).filter(F.size("words") > 0))


def word_groups(files: dict[str, int], both: dict[tuple[str, str], int], least: float = GROUP_LIKENESS) -> dict[str, int]:
    """Words by language: those that stand in the same files, by average linkage of the cosines of their sets of files."""
    words = sorted(files, key=lambda w: (-files[w], w))
    at = {w: k for k, w in enumerate(words)}
    like = np.zeros((len(words), len(words)))
    for (a, b), n in both.items():
        like[at[a], at[b]] = like[at[b], at[a]] = n / np.sqrt(files[a] * files[b])
    np.fill_diagonal(like, -1)
    size, group = np.ones(len(words)), [[k] for k in range(len(words))]
    while len(words) and like.max() >= least:
        a, b = sorted(divmod(int(like.argmax()), len(words)))
        like[a] = (size[a] * like[a] + size[b] * like[b]) / (size[a] + size[b])
        like[:, a] = like[a]
        like[[a, b], [a, b]] = -1
        like[b], like[:, b] = -1, -1
        size[a] += size[b]
        group[a], group[b] = group[a] + group[b], []
    return {words[k]: n for n, g in enumerate(g for g in group if len(g) > 1) for k in g}


def with_language(sents: DataFrame) -> DataFrame:
    """``file, lang, side, idx, words``: ``lang`` is the language of the target side of the file, as a number.

    Languages are not given: of the words that stand on the target side and seldom on the
    source side of the same files, the ``COMMON`` in most files fall into groups that stand
    in the same files, and a file belongs to the group of which it has the greatest part.
    A file that has none of them is of a language without a number.
    """
    held = (sents.select("file", "side", F.explode("words").alias("word")).filter(~F.col("word").rlike("[0-9]"))
            .groupBy("file", "word").agg(F.bool_or(F.col("side") == "t").alias("t"), F.bool_or(F.col("side") == "s").alias("s")).filter("t"))
    seen = held.groupBy("word").agg(F.count("*").alias("n"), F.count_if("s").alias("s")).filter(F.col("s") * 10 <= F.col("n"))
    top = {r.word: r.n for r in seen.orderBy(F.desc("n"), "word").limit(COMMON).collect()}
    own = held.filter(F.col("word").isin(list(top))).groupBy("file").agg(F.array_sort(F.collect_list("word")).alias("w"))  # at most COMMON words
    pair = own.select(F.explode("w").alias("a"), "w").select("a", F.explode("w").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    groups = word_groups(top, {(r.a, r.b): r.n for r in pair.collect()})  # at most half of COMMON squared rows
    words: dict[int, list[str]] = {}
    for w, g in groups.items():
        words.setdefault(g, []).append(w)
    if not words:
        return sents.select("file", F.lit("").alias("lang"), "side", "idx", "words")
    part = lambda ws: F.size(F.array_intersect("w", F.array(*[F.lit(w) for w in ws]))) / F.lit(len(ws))
    best = F.array_max(F.array(*[F.struct(part(ws).alias("s"), F.lit(-g).alias("g")) for g, ws in words.items()]))
    about = own.select("file", best.alias("b")).filter("b.s > 0").select("file", (-F.col("b.g")).cast("string").alias("lang"))
    return sents.join(about, "file", "left").select("file", F.coalesce("lang", F.lit("")).alias("lang"), "side", "idx", "words")


def coded(sents: DataFrame) -> DataFrame:
    """``sents`` with numbers for words: 62 bits of a hash, and one bit each for a digit in the word and for more than one letter.

    Tables of numbers are joined, sorted and handed to Python in a fraction of the time that words take.
    """
    code = lambda w: F.xxhash64(w).bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(F.when(w.rlike(r"\p{Nd}"), 1).otherwise(0) + F.when(F.length(w) > 1, 2).otherwise(0))
    return sents.withColumn("words", F.transform("words", code))


def places(codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each of ``asked`` stands in the sorted ``codes``, -1 if nowhere."""
    at = np.searchsorted(codes, asked)
    return np.where(codes[np.minimum(at, codes.size - 1)] == asked, at, -1) if codes.size else np.full(asked.size, -1)


def spread(start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posting lists of the keys, one after the other: which key it is, and the place in the postings."""
    n = start[keys + 1] - start[keys]
    a = np.repeat(np.arange(keys.size), n)
    return a, np.arange(a.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[keys], n)


def starts(sorted_keys: np.ndarray, size: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(size + 1))


def greatest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the greatest value of each."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, np.int64)
    return key[first], np.maximum.reduceat(value, first) if key.size else value


class Side:
    """The sentences of one side of a file: their words, the inverted index of these, and the weight of each word.

    A word weighs more the fewer sentences have it; one in more than half of them nothing.
    """

    def __init__(self, sentences: list[np.ndarray]):
        self.n = len(sentences)
        self.codes, self.word = np.unique(np.concatenate(sentences), return_inverse=True)
        self.sent = np.repeat(np.arange(self.n), [len(ws) for ws in sentences])
        self.first = starts(self.sent, self.n)
        order = np.argsort(self.word, kind="stable")
        self.posting, self.start = self.sent[order], starts(self.word[order], self.codes.size)
        df = np.diff(self.start)
        self.weight = np.where(df <= max(2, self.n / 2), np.log1p(self.n / np.maximum(df, 1)), 0)
        self.total = np.maximum(np.bincount(self.sent, self.weight[self.word], self.n), 1e-9)
        self.digit = (self.codes & 1) == 1
        self.numbers = np.bincount(self.sent, self.digit[self.word], self.n) > 0


class Pairs:
    """The sentences of both sides of a file and the scores of the pairs that may matter.

    ``fwd`` is the share of the weight of target sentence ``b`` that the translation
    of source sentence ``a`` covers, ``bwd`` the reverse, ``g`` their harmonic mean.
    Pairs without a word in common are never met; those met are kept where a score
    reaches the least that anything asks of it.
    """

    def __init__(self, i: np.ndarray, src: list[np.ndarray], j: np.ndarray, tgt: list[np.ndarray], table: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.i, self.j = i, j
        s, t = self.s, self.t = Side(src), Side(tgt)
        self.same = places(t.codes, s.codes)
        ns, nt = s.codes.size, t.codes.size
        own = np.flatnonzero(self.same >= 0)
        word, other = places(s.codes, table[0]), places(t.codes, table[1])
        held = (word >= 0) & (other >= 0)
        key, value = greatest(np.concatenate([own * nt + self.same[own], word[held] * nt + other[held]]), np.concatenate([np.ones(own.size), table[2][held]]))
        v, w = key // nt, key % nt
        # the target words that the words of each source sentence stand for, in the order of the sentences
        at, place = spread(starts(v, ns), s.word)
        bag, self.bag_value = greatest(s.sent[at] * nt + w[place], value[place])
        self.bag_word, self.bag_start = bag % nt, starts(bag // nt, s.n)
        # the target sentences that hold a translation of each source word
        order = np.argsort(w, kind="stable")
        at, place = spread(starts(w[order], nt), t.word)
        back, self.back_value = greatest(v[order][place] * t.n + t.sent[at], value[order][place])
        self.back_sent, self.back_start = back % t.n, starts(back // t.n, ns)
        parts, lo = [], 0
        cost = t.n + np.bincount(np.repeat(np.arange(s.n), np.diff(self.bag_start)), np.diff(t.start)[self.bag_word], s.n) + np.bincount(s.sent, np.diff(self.back_start)[s.word], s.n)
        cost = np.cumsum(cost)
        while lo < s.n:
            hi = min(s.n, lo + BLOCK, max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CELLS))))
            parts.append(self._scores(lo, hi))
            lo = hi
        self.a, self.b, self.fwd, self.bwd, self.g = (np.concatenate(x) for x in zip(*parts))
        self.key = self.a * t.n + self.b

    def _scores(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """The pairs to keep of the source sentences from ``lo`` to ``hi`` with all target sentences."""
        s, t = self.s, self.t
        cells = (hi - lo) * t.n
        at, place = spread(self.bag_start, np.arange(lo, hi))
        word, value = self.bag_word[place], self.bag_value[place]
        k, p = spread(t.start, word)
        fwd = np.bincount(at[k] * t.n + t.posting[p], (value * t.weight[word])[k], cells)
        at, place = spread(s.first, np.arange(lo, hi))
        word = s.word[place]
        k, p = spread(self.back_start, word)
        bwd = np.bincount(at[k] * t.n + self.back_sent[p], s.weight[word][k] * self.back_value[p], cells)
        both = np.flatnonzero((fwd > 0) | (bwd > 0))
        a, b = both // t.n + lo, both % t.n
        # numbers in common
        digit = s.digit[word]
        at, word = at[digit], word[digit]
        at, word = at[self.same[word] >= 0], self.same[word][self.same[word] >= 0]
        k, p = spread(t.start, word)
        shared = np.zeros(cells, bool)
        shared[at[k] * t.n + t.posting[p]] = True
        calm = np.where(s.numbers[a] & t.numbers[b] & ~shared[both], CLASH, 1)
        # equal scores are equal whatever the order they are summed in
        fwd, bwd = np.round(calm * fwd[both] / t.total[b], 6), np.round(calm * bwd[both] / s.total[a], 6)
        g = np.round(2 * fwd * bwd / np.maximum(fwd + bwd, 1e-9), 6)
        keep = (g >= min(SEED_LINK, LINK, NEAR_SEED, NEAR)) | (fwd >= GROW) | (bwd >= GROW)
        return a[keep], b[keep], fwd[keep], bwd[keep], g[keep]

    def _choose(self, keep: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs at the places ``keep`` that choose each other; equal scores prefer the lower place."""
        a, b, g = self.a[keep], self.b[keep], self.g[keep]
        best = np.zeros(keep.size, np.int8)
        for mine, other in ((a, b), (b, a)):
            order = np.lexsort((other, -g, mine))
            first = np.r_[True, mine[order][1:] != mine[order][:-1]] if keep.size else np.zeros(0, bool)
            best[order[first]] += 1
        return list(zip(a[best == 2].tolist(), b[best == 2].tolist()))

    def mutual(self, least: float) -> list[tuple[int, int]]:
        """Pairs that choose each other."""
        return self._choose(np.flatnonzero(self.g >= least))

    def near(self, pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
        """Pairs of sentences without a link that choose each other where the links around them point."""
        if not pairs:
            return []
        src, own = np.array(sorted(pairs)).T
        keep = np.flatnonzero((self.g >= least) & ~np.isin(self.a, src) & ~np.isin(self.b, own))
        p = np.searchsorted(src, self.a[keep])
        before, after = own[np.maximum(p - 1, 0)], own[np.minimum(p, own.size - 1)]
        return self._choose(keep[(self.b[keep] >= np.minimum(before, after) - REACH) & (self.b[keep] <= np.maximum(before, after) + REACH)])

    def score(self, kind: np.ndarray, a: int, b: int) -> float:
        k = int(np.searchsorted(self.key, a * self.t.n + b))
        return float(kind[k]) if k < self.key.size and self.key[k] == a * self.t.n + b else 0.0

    def links(self) -> list[tuple[int, int, float]]:
        """Mutual pairs, pairs left over near them, and sentences that the partner of a neighbour covers."""
        pairs = self.mutual(LINK)
        pairs += self.near(pairs, NEAR)
        out = [(a, b, self.score(self.g, a, b)) for a, b in pairs]
        for cover, own, place, turn in ((self.bwd, dict(pairs), self.i, 1), (self.fwd, {b: a for a, b in pairs}, self.j, -1)):
            at = {int(p): k for k, p in enumerate(place)}
            fresh = list(own)
            while fresh:  # what joined in one round may take its neighbours along in the next
                beside = {at[n] for k in fresh for n in (int(place[k]) - 1, int(place[k]) + 1) if n in at and at[n] not in own}
                joined = {}
                for k in sorted(beside):
                    near = {own[at[n]] for n in (int(place[k]) - 1, int(place[k]) + 1) if n in at and at[n] in own}
                    best = max((self.score(cover, *(k, o)[::turn]), -o) for o in near)
                    if best[0] >= GROW:
                        joined[k] = -best[1]
                        out.append((*(k, -best[1])[::turn], best[0]))
                own.update(joined)
                fresh = list(joined)
        return out


LINK_SCHEMA = "file string, i long, j long, g double"
COUNT_SCHEMA = "lang string, word long, other long, n double"
#: the partner of a word in the counts of the word alone
ALONE = 0


def _documents(sents: pd.DataFrame, table: pd.DataFrame | None) -> Iterator[tuple[str, str, Pairs]]:
    """File, language and pairs of each document among the rows that has both sides."""
    sents = sents.sort_values(["file", "side", "idx"])
    file, lang, idx = sents["file"].to_numpy(), sents["lang"].to_numpy(), sents["idx"].to_numpy(np.int64)
    source, words = sents["side"].to_numpy() == "s", sents["words"].tolist()
    held, of = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(0, object)
    if table is not None:
        table = table.sort_values("file", kind="stable")
        held, of = tuple(table[c].to_numpy(t) for c, t in (("word", np.int64), ("other", np.int64), ("q", np.float64))), table["file"].to_numpy()
    edge = np.flatnonzero(np.r_[True, file[1:] != file[:-1], True]) if len(file) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        mid = lo + int(source[lo:hi].sum())  # s sorts before t
        if lo < mid < hi:
            a, b = np.searchsorted(of, file[lo]), np.searchsorted(of, file[lo], "right")
            yield file[lo], lang[lo], Pairs(idx[lo:mid], words[lo:mid], idx[mid:hi], words[mid:hi], tuple(c[a:b] for c in held))


def _counts(sents: pd.DataFrame, table: pd.DataFrame | None, least: float) -> pd.DataFrame:
    """How often words stand in linked sentences, by language: together, and (with the partner ``ALONE``) by themselves."""
    parts = [_counts_of(lang, doc, doc.mutual(least), table is not None) for _, lang, doc in _documents(sents, table)]
    return pd.concat(parts) if parts else pd.DataFrame({"lang": np.zeros(0, object), "word": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "n": np.zeros(0)})


def _counts_of(lang: str, file: Pairs, pairs: list[tuple[int, int]], near: bool) -> pd.DataFrame:
    if near:
        pairs = pairs + file.near(pairs, NEAR_SEED)
    if not pairs:
        return pd.DataFrame({"lang": np.zeros(0, object), "word": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "n": np.zeros(0)})
    s, t = file.s, file.t
    k, p = spread(s.first, np.array([a for a, _ in pairs]))
    n, o = spread(t.first, np.array([b for _, b in pairs])[k])
    both, together = np.unique(s.word[p][n] * t.codes.size + t.word[o], return_counts=True)
    r, c = both // t.codes.size, both % t.codes.size
    # numbers of more than one digit only ever stand for themselves
    fixed = lambda codes: (codes & 3) == 3
    learned = (s.codes[r] != t.codes[c]) & ~fixed(s.codes[r]) & ~fixed(t.codes[c])
    r, c, together = r[learned], c[learned], together[learned]
    a, n_a = np.unique(s.word[p], return_counts=True)
    b, n_b = np.unique(t.word[spread(t.first, np.array([b for _, b in pairs]))[1]], return_counts=True)
    return pd.DataFrame({"lang": lang, "word": np.concatenate([s.codes[r], s.codes[a], np.full(b.size, ALONE)]),
                         "other": np.concatenate([t.codes[c], np.full(a.size, ALONE), t.codes[b]]), "n": np.concatenate([together, n_a, n_b]).astype(float)})


def _links(sents: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    rows = [(name, int(file.i[a]), int(file.j[b]), g) for name, _, file in _documents(sents, table) for a, b, g in file.links()]
    return pd.DataFrame(rows, columns=["file", "i", "j", "g"])


def _table(counts: DataFrame) -> DataFrame:
    """``lang, word, other, q``: Dice association of source and target words over linked sentences."""
    n = counts.groupBy("lang", "word", "other").agg(F.sum("n").alias("n")).filter("n >= 2")
    n = materialise(n, "counts")
    alone = lambda empty, c, out: n.filter(F.col(empty) == ALONE).select("lang", c, F.col("n").alias(out))
    return (n.filter((F.col("word") != ALONE) & (F.col("other") != ALONE)).join(alone("other", "word", "ns"), ["lang", "word"]).join(alone("word", "other", "nt"), ["lang", "other"])
            .select("lang", "word", "other", (2 * F.col("n") / (F.col("ns") + F.col("nt"))).alias("q")).filter(F.col("q") >= MIN_ASSOCIATION))


def align(chunks: DataFrame, **columns: str) -> DataFrame:
    """``file, i, j, g``: the links between source and target sentences, with their score."""
    sents = materialise(coded(with_language(materialise(sentences(chunks, **columns), "words"))), "sentences")
    vocab = materialise(sents.filter("side = 's'").select("file", "lang", F.explode("words").alias("word")).distinct(), "vocabulary")
    # some small documents share a task's turn; a document is never cut
    turns = max(1, sents.count() // TURN)
    turn = F.pmod(F.xxhash64("file"), F.lit(turns)).cast("int").alias("turn")
    by = sents.groupBy(turn)
    counts = by.applyInPandas(lambda s: _counts(s, None, SEED_LINK), COUNT_SCHEMA)
    for last in (False,) * (ROUNDS - 1) + (True,):
        known = vocab.join(_table(counts), ["lang", "word"]).select("file", "word", "other", "q").groupBy(turn)
        if last:
            links = by.cogroup(known).applyInPandas(_links, LINK_SCHEMA)
        else:
            counts = by.cogroup(known).applyInPandas(lambda s, t: _counts(s, t, LINK), COUNT_SCHEMA)
    return materialise(links, "links")


def filled_segments(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """``file_id, source_index, target_index, source_segment, target_segment, alignment_score, alignment_type``.

    The score is 0 to 100; the type is the number of source and of target sentences
    that hang together, such as 1:1 or 2:1.
    """
    sent = chunks.select(norm_key("file_id").alias("file"), F.col("chunk_index").cast("long").alias("idx"), "source_segment", "target_segment").filter(
        "file is not null and idx is not null")
    src = sent.groupBy("file", F.col("idx").alias("i")).agg(F.min("source_segment").alias("source_segment"))
    tgt = sent.groupBy("file", F.col("idx").alias("j")).agg(F.min("target_segment").alias("target_segment"))
    n_t = links.groupBy("file", "i").agg(F.count("*").alias("n_t"))
    n_s = links.groupBy("file", "j").agg(F.count("*").alias("n_s"))
    return (links.join(n_t, ["file", "i"]).join(n_s, ["file", "j"]).join(src, ["file", "i"]).join(tgt, ["file", "j"])
            .select(F.col("file").alias("file_id"), F.col("i").alias("source_index"), F.col("j").alias("target_index"), "source_segment", "target_segment",
                    F.round(F.col("g") * 100).cast("int").alias("alignment_score"), F.concat_ws(":", "n_s", "n_t").alias("alignment_type")))
