"""Evaluation passages inside training documents.

Method: a window as long as the passages slides over the words of every document
and over every item; the SimHash of its weighted word shingles is its fingerprint.
The fingerprints of the items stand in one table per block of bits; any two
fingerprints within the radius agree in at least one block, so looking up every
block of a document window finds all item windows within the radius. A window has
few shingles, so one other word can move its fingerprint further than the radius;
windows so similar share shingles, though: of those of an item window, ordered from
rare to frequent, a similar one has at least one among the first that weigh more than
may be missing. These stand in a second index. Candidates of both are verified by the
exact weighted Jaccard similarity of their shingles.

A passage is ``PASSAGE_WORDS`` consecutive words of an item, or the whole item if
it is shorter. Documents are read in Arrow batches and are not shuffled; the items
are the stated query set and come to the driver in blocks of bounded size
(``ITEM_BLOCK_CHARS``), one after the other: the index of a block is built once, sent
to the executors, and given up before the next block comes, if there are several.

Five-word shingles at a similarity of 0.8 leave room for little but a short word at the
edge of a passage. ``eval_leaks`` takes other sizes: with single words
(``shingle_words=1``) a passage with one or two words changed anywhere is found too.

Defined cases: null and empty texts and items without words give no rows; a
document shorter than the passage can only hold a short item; letter case, and
everything that is neither letter nor digit, is ignored; repeated document or item
rows give one row; texts of any length are read whole, in overlapping stretches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tmloom.session import materialise

PASSAGE_WORDS = 12
SHINGLE_WORDS = 5
RADIUS = 3
BLOCKS = RADIUS + 1
BLOCK_BITS = 64 // BLOCKS
SIMILARITY = 0.8
ITEM_BLOCK_CHARS = 1_000_000
STRETCH_WORDS = 60_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, windows int, similarity double, verbatim boolean"


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, case folded."""
    return _WORD.findall(text.casefold()) if text else []


def word_weight(word: str) -> int:
    """Long words say more about a passage than short ones."""
    return 1 if len(word) <= 3 else 2


def shingles(hashes: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the ``size`` words from each position on."""
    n = hashes.size - size + 1
    h, w = np.zeros(n, np.uint64), np.zeros(n, np.int32)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = (h ^ hashes[j:j + n]) * _MIX
            h ^= h >> np.uint64(29)
            w += weights[j:j + n]
    return h, w


def fingerprints(h: np.ndarray, w: np.ndarray, per_window: int) -> np.ndarray:
    """SimHash of each window of ``per_window`` neighbouring shingles.

    Votes of a window are differences of running sums; these may wrap around in a
    narrow type as long as the votes of one window fit it.
    """
    most = per_window * int(w.max(initial=1))
    kind = np.int8 if most < 128 else np.int16 if most < 32768 else np.int32
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    narrow = w.astype(kind)[:, None]
    total = np.zeros((len(h) + 1, 64), kind)
    np.cumsum(bits.astype(kind, copy=False) * (2 * narrow) - narrow, axis=0, dtype=kind, out=total[1:])
    return np.packbits((total[per_window:] - total[:-per_window]) > 0, axis=1).view(">u8").astype(np.uint64).ravel()


class ItemIndex:
    """The windows of one length of all items, with a lookup table per block of bits."""

    def __init__(self, length: int, shingle_words: int = SHINGLE_WORDS, least: float = SIMILARITY):
        self.length, self.size, self.least = length, min(shingle_words, length), least
        self.per_window = length - self.size + 1
        self.fp, self.item, self.sh, self.wt = [], [], [], []
        self.texts: list[list[str]] = []
        self.at: list[tuple[int, int]] = []

    def add(self, item_id: int, ws: list[str], h: np.ndarray, w: np.ndarray) -> None:
        sh, wt = shingles(h, w, self.size)
        for k, fp in enumerate(fingerprints(sh, wt, self.per_window)):
            self.fp.append(fp)
            self.item.append(item_id)
            self.sh.append(sh[k:k + self.per_window])
            self.wt.append(wt[k:k + self.per_window])
            self.at.append((len(self.texts), k))
        self.texts.append(ws)

    def words_of(self, k: int) -> list[str]:
        """The words of a window."""
        text, at = self.at[k]
        return self.texts[text][at:at + self.length]

    def close(self) -> None:
        self.fp, self.item = np.array(self.fp, np.uint64), np.array(self.item, np.int64)
        self.sh, self.wt = np.array(self.sh), np.array(self.wt)
        self.tables = []
        for b in range(BLOCKS):
            v = self.block(self.fp, b)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << BLOCK_BITS) + 1))))
        # the rarest shingles of each window, as many as weigh more than a similar window can be without
        kinds, inverse, n = np.unique(self.sh, return_inverse=True, return_counts=True)
        rare = np.argsort(n[inverse.reshape(self.sh.shape)], axis=1, kind="stable")
        kind = np.take_along_axis(inverse.reshape(self.sh.shape), rare, 1)
        wt = np.take_along_axis(np.where(self.first_of_kind(self.sh), self.wt, 0), rare, 1)
        asked = (wt > 0) & (np.cumsum(wt, 1) - wt <= (1 - self.least) * wt.sum(1, keepdims=True) + 1e-9)
        window, kind = np.nonzero(asked)[0], kind[asked]
        order = np.argsort(kind, kind="stable")
        found, n = np.unique(kind, return_counts=True)
        self.rare, self.rare_start, self.rare_window = kinds[found], np.concatenate([[0], np.cumsum(n)]), window[order]

    @staticmethod
    def block(fp: np.ndarray, b: int) -> np.ndarray:
        return ((fp >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def lookup(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) pairs of fingerprints within the radius."""
        left, right = [], []
        for b, (order, start) in enumerate(self.tables):
            v = self.block(fp, b)
            n = start[v + 1] - start[v]
            hit = np.flatnonzero(n)
            n = n[hit]
            a = np.repeat(hit, n)
            offset = np.arange(a.size) - np.repeat(np.cumsum(n) - n, n)
            i = order[np.repeat(start[v[hit]], n) + offset]
            near = np.bitwise_count(fp[a] ^ self.fp[i]) <= RADIUS
            left.append(a[near])
            right.append(i[near])
        pair = np.unique(np.concatenate(left) * np.int64(self.fp.size) + np.concatenate(right))
        return pair // self.fp.size, pair % self.fp.size

    def sharing(self, sh: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) pairs that share one of the rarest shingles of the item window.

        ``sh`` are the shingles of a stretch, ``whole`` the starts of its windows.
        """
        k = np.searchsorted(self.rare, sh)
        at = np.flatnonzero(self.rare[np.minimum(k, self.rare.size - 1)] == sh)
        lo, n = self.rare_start[k[at]], self.rare_start[k[at] + 1] - self.rare_start[k[at]]
        i = self.rare_window[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        window = (np.repeat(at, n)[:, None] - np.arange(self.per_window)).ravel()
        i = np.repeat(i, self.per_window)
        inside = np.isin(window, whole)
        pair = np.unique(window[inside] * np.int64(self.fp.size) + i[inside])
        return pair // self.fp.size, pair % self.fp.size

    @staticmethod
    def first_of_kind(x: np.ndarray) -> np.ndarray:
        return np.stack([~(x[:, :k] == x[:, k:k + 1]).any(1) for k in range(x.shape[1])], 1)

    def similarity(self, sh: np.ndarray, wt: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of the shingle sets of pairs of windows."""
        other, ow = self.sh[i], self.wt[i]
        mine, theirs = self.first_of_kind(sh), self.first_of_kind(other)
        common = (((sh[:, :, None] == other[:, None, :]) & theirs[:, None, :]).any(2) & mine)
        inter = (wt * common).sum(1)
        return inter / ((wt * mine).sum(1) + (ow * theirs).sum(1) - inter)


def build_index(items: list[tuple[int, str]], shingle_words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> list[ItemIndex]:
    by_length: dict[int, ItemIndex] = {}
    for item_id, text in sorted(set(items)):
        ws = words(text)
        if ws:
            length = min(PASSAGE_WORDS, len(ws))
            h = np.array([xxhash.xxh64_intdigest(x) for x in ws], np.uint64)
            by_length.setdefault(length, ItemIndex(length, shingle_words, least)).add(item_id, ws, h, np.array([word_weight(x) for x in ws], np.int32))
    for ix in by_length.values():
        ix.close()
    return list(by_length.values())


def leaks_of_batch(ids: list[int], texts: list[str | None], index: list[ItemIndex]) -> pd.DataFrame:
    """Rows of ``SCHEMA`` for the documents of one batch."""
    all_words: list[str] = []
    ends = []
    for text in texts:
        all_words.extend(words(text))
        ends.append(len(all_words))
    code: dict[str, int] = {}
    ids_of = np.fromiter((code.setdefault(x, len(code)) for x in all_words), np.int64, len(all_words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in code), np.uint64, len(code))[ids_of] if code else np.zeros(0, np.uint64)
    weights = np.fromiter((word_weight(x) for x in code), np.int32, len(code))[ids_of] if code else np.zeros(0, np.int32)
    ends_a = np.array(ends, np.int64)
    best: dict[tuple[int, int], list] = {}
    for ix in index:
        for lo in range(0, len(all_words), STRETCH_WORDS):
            hi = min(len(all_words), lo + STRETCH_WORDS + ix.length - 1)
            if hi - lo < ix.length:
                continue
            sh, wt = shingles(hashes[lo:hi], weights[lo:hi], ix.size)
            doc = np.searchsorted(ends_a, np.arange(lo, hi - ix.length + 1), "right")
            whole = np.flatnonzero(ends_a[doc] >= np.arange(lo, hi - ix.length + 1) + ix.length)  # no window across documents
            fp = fingerprints(sh, wt, ix.per_window)[whole]
            a, i = ix.lookup(fp)
            near, of = ix.sharing(sh, whole)
            pair = np.unique(np.concatenate([whole[a] * np.int64(ix.fp.size) + i, near * np.int64(ix.fp.size) + of]))
            if not pair.size:
                continue
            at, i = pair // ix.fp.size, pair % ix.fp.size
            cols = at[:, None] + np.arange(ix.per_window)
            sim = ix.similarity(sh[cols], wt[cols], i)
            for p, k, s in zip(at.tolist(), i.tolist(), sim.tolist()):
                if s >= ix.least:
                    row = best.setdefault((ids[doc[p]], int(ix.item[k])), [0, 0.0, False])
                    row[0] += 1
                    row[1] = max(row[1], s)
                    row[2] = row[2] or (s == 1.0 and all_words[lo + p:lo + p + ix.length] == ix.words_of(k))
    return pd.DataFrame([(d, i, *r) for (d, i), r in best.items()], columns=["doc_id", "item_id", "windows", "similarity", "verbatim"])


def item_blocks(items: DataFrame, item_id: str, text: str) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about ``ITEM_BLOCK_CHARS`` characters the query set has, and the blocks, each collected when it is asked for."""
    src = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    size = src.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / ITEM_BLOCK_CHARS))
    return n, ([(r.i, r.t) for r in (src if n == 1 else src.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)).collect()] for b in range(n))


def eval_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "item_text", shingle_words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, windows, similarity, verbatim``: documents with windows like one of an item.

    ``windows`` counts the similar pairs of windows, ``similarity`` is the best,
    ``verbatim`` tells whether a whole passage stands in the document word for word.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    out = None
    n, blocks = item_blocks(items, item_id, item_text)
    for block in blocks:
        shared = spark.sparkContext.broadcast(build_index(block, shingle_words, least))  # bounded by ITEM_BLOCK_CHARS

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield leaks_of_batch(pdf["doc_id"].tolist(), pdf["text"].tolist(), shared.value)

        part = docs.mapInPandas(run, SCHEMA)
        if n > 1:
            part = materialise(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"), F.max("verbatim").alias("verbatim"))
