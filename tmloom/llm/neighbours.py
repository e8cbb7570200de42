"""The k most similar vectors of every vector, by additive quantisation.

Method: a vector is approximated by a sum of codewords, one from each of several
full-dimensional codebooks. Codebooks are trained on residuals and then refitted
together by least squares; a vector is encoded by beam search over all of them. The
first codewords of a code are its address: the best address names the cell the vector is
stored in, and the best ones of the same beam the cells it is compared in. Within a cell
all stored vectors are scored from lookup tables of inner products, with the stored norms
of their approximations, and the best (``RERANK`` or twice ``k``, if that is more) are
scored exactly. A pair so found counts for both of its vectors, whichever asked.

The codebooks are fitted on at most ``SAMPLE_VECTORS`` vectors in the order of their
digests; every vector is stored and every vector is a query. The number of cells follows
the number of vectors, about ``PER_CELL`` (or four times ``k``) in a cell: beyond
``FIRST_WORDS`` cells the address takes in a further codebook. Of more cells a neighbour
can be in more, so the number a query is compared in grows with them (``probes``): with
the same number at every size neighbours would be missed in large tables. Cells with near
codewords form a region, and a query goes once to each region that has one of its cells,
with these. A region with more than
``BLOCK_ROWS`` stored vectors or queries is split into blocks, and every block of stored
vectors meets every block of queries, so no task holds more than two blocks. Exact
copies are collapsed before the search and expanded after it.

Measured against brute force, the search finds at least 0.9 of the true neighbours
(see the tests and the README).

Defined cases: null vectors and vectors with null, infinite or undefined numbers,
of another dimension, or of zero length take no part; repeated rows of one id are
one vector (of different vectors under one id the greatest digest counts); equal
similarities, to nine digits, order by id; with fewer than k others all are given;
extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tmloom.session import materialise

SAMPLE_VECTORS = 20_000
PER_CELL = 128
FIRST_WORDS = 4096
EXTRA_BOOKS = 3
EXTRA_WORDS = 128
BEAM = 4
#: a vector is compared in the number of cells to this power
PROBED = 0.375
LEAST_PROBES = 8
RERANK = 48
BLOCK_ROWS = 65_536
REGION_CELLS = 32


def probes(cells: int) -> int:
    """The number of cells that a vector is compared in, of so many."""
    return max(LEAST_PROBES, int(np.ceil(cells ** PROBED)))


def usable(df: DataFrame, vec_id: str, vector: str, dim: int) -> DataFrame:
    """``id, digest, raw, width``: the usable vectors by id, as the bytes of their numbers and a digest of these.

    Numbers keep the bytes they have in ``df``, and ``width`` says how many: floats stay floats.
    """
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    rows = df.filter(F.col(vec_id).isNotNull() & (F.size(vector) == dim)).select(F.col(vec_id).cast("string").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, v = batch.column(0), batch.column(1)
            flat = v.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim) + kind(0)  # no negative zero
            if flat.null_count:  # a null number is no number
                x[~flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim)] = np.nan
            ok = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            raw = [row.tobytes() for row in x[ok]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(ok)), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "digest", "raw"])

    return (rows.mapInArrow(pack, "id string, digest binary, raw binary")
            .groupBy("id").agg(F.max(F.struct("digest", "raw")).alias("v")).select("id", "v.digest", "v.raw", F.lit(np.dtype(kind).itemsize).alias("width")))


class Quantiser:
    """Codebooks of an additive quantiser; the first ``depth`` of them name the cells."""

    def __init__(self, books: list[np.ndarray], depth: int = 1):
        self.books, self.depth = books, depth
        self.half = [0.5 * (b ** 2).sum(1) for b in books]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 7) -> "Quantiser":
        rng = np.random.default_rng(seed)
        first, depth = cells, 1
        while first > FIRST_WORDS:
            first, depth = -(-first // EXTRA_WORDS), depth + 1
        residual, books = x.copy(), []
        for k in (first, *[EXTRA_WORDS] * max(EXTRA_BOOKS, depth - 1)):
            book = _kmeans(residual, min(k, len(x)), rng)
            residual = residual - book[_nearest(residual, book)]
            books.append(book)
        # all codebooks refitted together to the codes that beam search gives, drawn to where they were
        q = cls(books, depth)
        codes = q.encode(x)[0]
        width = np.array([len(b) for b in books])
        at = codes + np.concatenate([[0], np.cumsum(width)[:-1]])
        total = int(width.sum())
        gram = np.zeros(total * total)
        for a in range(len(books)):
            for b in range(len(books)):
                gram += np.bincount(at[:, a] * total + at[:, b], minlength=total * total)
        gram = gram.reshape(total, total)
        gram[np.diag_indices(total)] += 1.0
        rest = x - sum(b[codes[:, m]] for m, b in enumerate(books))
        pull = np.zeros((total, x.shape[1]))
        for m in range(len(books)):
            order = np.argsort(at[:, m], kind="stable")
            used, start = np.unique(at[order, m], return_index=True)
            pull[used] += np.add.reduceat(rest[order], start, axis=0)
        moved = np.linalg.solve(gram, pull).astype(np.float32)
        return cls([b + d for b, d in zip(books, np.split(moved, np.cumsum(width)[:-1]))], depth)

    def beam(self, x: np.ndarray, width: int, depth: int, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best codes of the first ``depth`` codebooks for each vector, best first, and their sums of codewords.

        With ``begun`` only codes that begin with those of that row.
        """
        n, dim = x.shape
        codes = np.zeros((n, 1, 0), np.int64) if begun is None else begun[:, None, :]
        approx = sum((self.books[m][codes[:, :, m]] for m in range(codes.shape[2])), np.zeros((n, 1, dim), np.float32))
        for book, half in list(zip(self.books, self.half))[codes.shape[2]:depth]:
            rest = x[:, None, :] - approx
            cost = (0.5 * (rest * rest).sum(2)[:, :, None] + half - rest @ book.T).reshape(n, -1)
            b = min(width, cost.shape[1])
            top = np.argpartition(cost, b - 1, axis=1)[:, :b]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(cost, top, 1), axis=1, kind="stable"), 1)
            back, word = top // len(book), top % len(book)
            codes = np.concatenate([np.take_along_axis(codes, back[:, :, None], 1), word[:, :, None]], 2)
            approx = np.take_along_axis(approx, back[:, :, None], 1) + book[word]
        return codes, approx

    def address(self, codes: np.ndarray) -> np.ndarray:
        """The cell of codes along the last axis."""
        cell = np.zeros(codes.shape[:-1], np.int64)
        for m in range(self.depth):
            cell = cell * len(self.books[m]) + codes[..., m]
        return cell

    def encode(self, x: np.ndarray, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes (one column per codebook) and norms of the approximations, by beam search."""
        codes, approx = self.beam(x, BEAM, len(self.books), begun)
        return codes[:, 0], np.linalg.norm(approx[:, 0], axis=1)

    def placed(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``n`` best cells of each vector, best first, and its code and norm in the first of them."""
        addresses = self.beam(x, n, self.depth)[0]
        return self.address(addresses), *self.encode(x, addresses[:, 0])

    def regions(self) -> np.ndarray:
        """The region of each first codeword: a few near codewords, or one that has many cells itself."""
        first = self.books[0]
        if self.depth > 1 or len(first) <= REGION_CELLS:
            return np.arange(len(first)) if self.depth > 1 else np.zeros(len(first), np.int64)
        return _nearest(first, _kmeans(first, len(first) // REGION_CELLS, np.random.default_rng(5)))

    def region_of(self, cell: np.ndarray, regions: np.ndarray) -> np.ndarray:
        inner = int(np.prod([len(b) for b in self.books[1:self.depth]], dtype=np.int64))
        return regions[cell // inner]

    def scores(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosine of each query with each stored vector, from lookup tables."""
        total = np.zeros((len(q), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            used, at = np.unique(codes[:, m], return_inverse=True)
            total += q @ book[used].T if len(used) == 1 else (q @ book[used].T)[:, at]
        return total / np.maximum(norms, 1e-9)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    half = 0.5 * (book ** 2).sum(1)
    return np.concatenate([np.argmin(half - x[s:s + 8192] @ book.T, axis=1) for s in range(0, len(x), 8192)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, book)
        order = np.argsort(a, kind="stable")
        words, at = np.unique(a[order], return_index=True)
        book[words] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
        empty = np.setdiff1d(np.arange(k), words)
        book[empty] = x[rng.choice(len(x), empty.size)]
    return book


def _matrix(column, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _exact_unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision, for whatever is approximate."""
    return _exact_unit(x).astype(np.float32)


def _best_of_cell(model: Quantiser, x: np.ndarray, no: np.ndarray, codes: np.ndarray, norms: np.ndarray, y: np.ndarray, asked: np.ndarray,
                  k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector, other and cosine, both ways: of the pairs of queries and stored vectors of a cell the ``k`` best of each, with all that equal the last of them."""
    approx = model.scores(y.astype(np.float32), codes, norms)
    approx[asked[:, None] == no[None, :]] = -2
    r = min(max(RERANK, 2 * k), len(no))
    top = np.argpartition(-approx, r - 1, axis=1)[:, :r]
    cos = np.round(np.einsum("qd,qrd->qr", y, x[top]), 12)
    cos[asked[:, None] == no[top]] = -2
    floor = np.partition(cos, r - min(k, r), axis=1)[:, r - min(k, r)]
    qi, ri = np.nonzero((cos >= floor[:, None] - 1e-9) & (cos >= least))
    # the same pairs as the stored vectors see them
    si, sj = np.nonzero((cos >= least) & (cos > -2))
    who, c = top[si, sj], cos[si, sj]
    order = np.lexsort((-c, who))
    who, c, si = who[order], c[order], si[order]
    start = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(np.append(start, len(who)))
    keep = c >= np.repeat(c[start + np.minimum(k, size) - 1], size) - 1e-9
    who, c, si = who[keep], c[keep], si[keep]
    return np.concatenate([asked[qi], no[who]]), np.concatenate([no[top[qi, ri]], asked[si]]), np.minimum(np.concatenate([cos[qi, ri], c]), 1.0)


def nearest(vectors: DataFrame, k: int = 3, min_cosine: float | None = None) -> DataFrame:
    """``id, other_id, cosine``: for each vector of ``usable`` its k most similar others.

    With ``min_cosine`` only neighbours of at least that similarity are given,
    which keeps partial results small. ``vectors`` is read several times: pass a
    materialised table.
    """
    spark = vectors.sparkSession
    # exact copies: one representative, the k + 1 smallest ids
    w = Window.partitionBy("digest").orderBy("id")
    firsts = vectors.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).groupBy("digest").agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.max(F.when(F.col("rn") == 1, F.col("raw"))).alias("raw"))
    reps = materialise(firsts.withColumn("no", F.monotonically_increasing_id()), "representatives")
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "id string, other_id string, cosine double")
    kind = np.float32 if vectors.first().width == 4 else np.float64
    sample = [r.raw for r in reps.orderBy("digest").select("raw").limit(SAMPLE_VECTORS).collect()]
    x = _unit(_matrix(sample, kind))
    cells = max(1, 2 ** round(np.log2(max(1, n / max(PER_CELL, 4 * k)))))
    model, ask_in = Quantiser.fit(x, cells), probes(cells)
    # at most FIRST_WORDS codewords, and EXTRA_WORDS in each further codebook
    shared = spark.sparkContext.broadcast((model.books, model.depth, model.regions()))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, depth, regions = shared.value
        q = Quantiser(books, depth)
        for pdf in batches:
            for s in range(0, len(pdf), 512):
                part = pdf.iloc[s:s + 512]
                cells, codes, norms = q.placed(_unit(_matrix(part["raw"], kind)), ask_in)
                at = q.region_of(cells, regions)
                asked = []
                for row, region in zip(cells, at):
                    order = np.argsort(region, kind="stable")
                    names, start = np.unique(region[order], return_index=True)
                    asked.append([{"region": r, "cells": c.tobytes()} for r, c in zip(names.tolist(), np.split(row[order].astype(np.int32), start[1:]))])
                yield pd.DataFrame({"no": part["no"].to_numpy(), "raw": part["raw"].to_numpy(), "codes": [c.tobytes() for c in codes.astype(np.int16)], "norm": norms, "own": at[:, 0].astype(np.int32), "asked": asked})

    # one row per vector; its places in the regions are made from it on the JVM, without encoding twice
    encoded = materialise(reps.select("no", "raw").mapInPandas(encode, "no long, raw binary, codes binary, norm float, own int, asked array<struct<region int, cells binary>>"), "encoded")
    stored = encoded.select(F.col("own").alias("region"), F.lit(True).alias("stored"), "no", "raw", F.col("codes").alias("places"), "norm")
    asked = encoded.select(F.explode("asked").alias("a"), "no", "raw").select("a.region", F.lit(False).alias("stored"), "no", "raw", F.col("a.cells").alias("places"), F.lit(0.0).cast("float").alias("norm"))
    # split full regions: one row of counts for each, joined and not collected
    sizes = asked.groupBy("region").agg(F.count("*").alias("q")).join(stored.groupBy("region").agg(F.count("*").alias("s")), "region").select(
        "region", F.ceil(F.col("s") / BLOCK_ROWS).cast("int").alias("sb"), F.ceil(F.col("q") / BLOCK_ROWS).cast("int").alias("qb"))
    own = lambda blocks: F.array(F.pmod(F.xxhash64("no"), F.col(blocks)).cast("int"))
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    placed = (stored.unionByName(asked).join(F.broadcast(sizes), "region")  # as many rows as first codewords at most
              .withColumn("s", F.explode(F.when(F.col("stored"), own("sb")).otherwise(every("sb"))))
              .withColumn("q", F.explode(F.when(F.col("stored"), every("qb")).otherwise(own("qb"))))
              .select("region", "s", "q", "stored", "no", "raw", "places", "norm"))
    least = -1.5 if min_cosine is None else min_cosine - 1e-9

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        books, depth, _ = shared.value
        q = Quantiser(books, depth)
        kept = pdf["stored"].to_numpy(bool)
        stored, asked = pdf[kept], pdf[~kept]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(stored) and len(asked):
            x, y = _exact_unit(_matrix(stored["raw"], kind)), _exact_unit(_matrix(asked["raw"], kind))
            no, ask = stored["no"].to_numpy(), asked["no"].to_numpy()
            codes, norms = _matrix(stored["places"], np.int16).astype(np.int64), stored["norm"].to_numpy(np.float32)
            cells_of = asked["places"].map(len).to_numpy() // 4
            sought = np.frombuffer(b"".join(asked["places"]), np.int32)
            cell = q.address(codes)
            order = np.argsort(cell, kind="stable")
            cells, start = np.unique(cell[order], return_index=True)
            at = np.searchsorted(cells, sought)
            hit = cells[np.minimum(at, len(cells) - 1)] == sought
            who = np.repeat(np.arange(len(asked)), cells_of)[hit]
            by = np.argsort(at[hit], kind="stable")
            asking, turn = np.unique(at[hit][by], return_index=True)
            for c, mine in zip(asking.tolist(), np.split(who[by], turn[1:])):
                here = order[start[c]:start[c + 1] if c + 1 < len(start) else None]
                step = max(1, 2_000_000 // len(here))
                for s in range(0, len(mine), step):
                    m = mine[s:s + step]
                    out.append(_best_of_cell(q, x[here], no[here], codes[here], norms[here], y[m], ask[m], k, least))
        return pd.DataFrame(dict(zip(("no", "other", "cosine"), (np.concatenate(c) for c in zip(*out)))))

    found = placed.groupBy("region", "s", "q").applyInPandas(search, "no long, other long, cosine double")
    # a pair is found once by each of its vectors, and in every block
    found = found.groupBy("no", "other").agg(F.max("cosine").alias("cosine"))
    names = reps.select("no", "ids")
    found = found.join(names.select(F.col("no").alias("other"), "ids"), "other").select("no", F.round("cosine", 9).alias("near"), "cosine", "ids")
    best = Window.partitionBy("no").orderBy(F.desc("near"), F.element_at("ids", 1))
    found = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    # copies: of another group at most its k smallest ids can count, of the own group the k smallest others
    near = (found.select("no", "near", "cosine", F.explode(F.slice("ids", 1, k)).alias("other_id"))
            .unionByName(names.filter(F.size("ids") > 1).select("no", F.lit(1.0).alias("near"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("other_id"))))
    # the own group's list has k + 1 entries, one of which may be the vector itself
    lists = near.groupBy("no").agg(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("d"), F.col("other_id").alias("o"), F.col("cosine").alias("c")))).alias("list"))
    out = (vectors.select("id", "digest").join(reps.select("digest", "no").join(lists, "no").select("digest", "list"), "digest")
           .select("id", F.explode(F.slice(F.filter("list", lambda s: s["o"] != F.col("id")), 1, k)).alias("s"))
           .select("id", F.col("s.o").alias("other_id"), F.col("s.c").alias("cosine")))
    return out if min_cosine is None else out.filter(F.col("cosine") >= min_cosine)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``low_id, high_id``: unordered pairs of which one is a neighbour of the other."""
    return neighbours.select(F.least("id", "other_id").alias("low_id"), F.greatest("id", "other_id").alias("high_id")).distinct()
