"""Exact top-k by cosine of a stated query set against all rows, in blocks.

The queries are sent to the executors in blocks of bounded size; each partition of
the stored rows scores a block with one matrix product and keeps its k best per
query, so what is shuffled is k rows per query and partition. No pairs are built.

Defined cases: vectors with null or undefined numbers, of another dimension or of
zero length take no part; equal similarities order by id; fewer than k rows give all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

QUERY_BLOCK = 4096


def usable(df: DataFrame, vec_id: str, vector: str, dim: int, scope: str | None = None) -> DataFrame:
    """``id, vec`` and, if asked for, ``scope``: the usable vectors, one row an id."""
    ok = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"), *([F.col(scope).alias("scope")] if scope else [])).dropDuplicates(["id"])


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Best:
    """The ``k`` best ids of each query so far; only what may still be among them is kept."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -2.0)
        self.query, self.score, self.name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1")

    def add(self, score: np.ndarray, names: np.ndarray) -> None:
        """``score`` is queries x rows; scores under -1 are no candidates."""
        floor = self.least
        if score.shape[1] > self.k:
            floor = np.maximum(floor, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero((score >= floor[:, None]) & (score >= -1.5))
        query, value, name = np.concatenate([self.query, q]), np.concatenate([self.score, score[q, r]]), np.concatenate([self.name, names[r]])
        # equal similarities are told apart by id, as in the final order
        order = np.lexsort((name, -value, query))
        query, value, name = query[order], value[order], name[order]
        start = np.searchsorted(query, np.arange(len(self.least)))
        keep = np.arange(len(query)) - start[query] < self.k
        self.query, self.score, self.name = query[keep], value[keep], name[keep]
        last = np.searchsorted(self.query, np.arange(len(self.least)), "right") - 1
        full = np.bincount(self.query, minlength=len(self.least)) == self.k
        self.least[full] = self.score[last[full]]


def cosine_topk(queries: DataFrame, stored: DataFrame, k: int, blocks: int | None = None, scoped: bool = False) -> DataFrame:
    """``query_id, id, cosine, rank``; both sides are results of ``usable``.

    With ``scoped`` both sides have a column ``scope``, and only rows of a query's own scope count;
    a row never finds itself then.
    """
    spark = queries.sparkSession
    n = queries.count() if blocks is None else 0
    blocks = blocks or max(1, -(-n // QUERY_BLOCK))
    kind = queries.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id string, cosine double"
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = part.collect()  # at most about QUERY_BLOCK rows
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r.id for r in rows], _unit([r.vec for r in rows]), np.array([r.scope for r in rows]) if scoped else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, scopes = shared.value
            best = _Best(len(ids), k)
            for pdf in batches:
                if scoped:
                    pdf = pdf[pdf["scope"].isin(set(scopes.tolist()))]
                for s in range(0, len(pdf), 2048):
                    chunk = pdf.iloc[s:s + 2048]
                    score = np.round(q @ _unit(chunk["vec"]).T, 12)
                    names = chunk["id"].to_numpy(dtype=str)
                    if scoped:
                        score[(scopes[:, None] != chunk["scope"].to_numpy(dtype=str)[None, :]) | (np.array(ids, dtype=str)[:, None] == names[None, :])] = -9
                    best.add(np.where(score > -2, np.round(score, 9), score), names)
            if len(best.query):
                yield pd.DataFrame({"query_id": np.array(ids, dtype=object)[best.query], "id": best.name, "cosine": best.score})

        part_out = stored.select("id", "vec", *(["scope"] if scoped else [])).mapInPandas(run, schema)
        out = part_out if out is None else out.unionByName(part_out)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
