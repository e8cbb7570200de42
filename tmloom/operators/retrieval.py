"""Candidates for a stated set of segments from all sources at once: exact, by vector, fuzzy, from the project itself.

The queries are few and stated; what they are compared with is everything. They go to the
executors in blocks of bounded size, and nothing else is broadcast. Exact matches come by
an equi-join on the project and the key.

Defined cases: segments without a source or project, and units without a target, take no
part; a segment is never a candidate for itself; equal scores keep the order in which the
candidates came: exact ones, then by similarity, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tmloom.functions import scoring as S, text as T
from tmloom.functions.embedding import embedding
from tmloom.functions.similarity import ratio
from tmloom.operators import tm, topk

QUERY_BLOCK = 2048
LETTERS = 64
#: places of the candidates of each source in the order of arrival
_VECTOR, _PER_SOURCE = 1000, 100


def stated(segments: DataFrame, every: int = 100) -> DataFrame:
    """The query set: the segments whose id, hashed to a number, is divisible by ``every``."""
    number = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long")
    return segments.filter((number % every == 0) & F.col("source").isNotNull() & F.col("project_id").isNotNull())


def vector_candidates(queries: DataFrame, chunks: DataFrame, files: DataFrame, k: int = 20) -> DataFrame:
    """``id, ref_id, source, category, cosine, rank``: the nearest chunks of files of the project; ``category`` is legal or other."""
    placed = chunks.filter("content is not null").join(files.select(F.col("id").alias("file_id"), "project_id", F.col("category")), "file_id").filter("project_id is not null")
    stored = topk.usable(placed.withColumn("v", embedding(F.col("content"))), "id", "v", 64, "project_id")
    asked = topk.usable(queries.withColumn("v", embedding(F.col("source"))), "id", "v", 64, "project_id")
    near = topk.cosine_topk(asked, stored, k, scoped=True).select(F.col("query_id").alias("id"), F.col("id").alias("ref_id"), "cosine", "rank")
    about = placed.groupBy(F.col("id").alias("ref_id")).agg(F.min("content").alias("source"), F.min(F.when(F.col("category") == "legal", "legal").otherwise("other")).alias("category"))
    return near.join(about, "ref_id")


def candidates(queries: DataFrame, units: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``id, key, ref_id, kind, exact, score, raw, pos, prio``: exact and vector candidates in one list, keyed by their clean source."""
    text = units.select(F.col("id").alias("unit_id"), "source_text")
    exact = tm.exact_lookup(queries, units).join(text, "unit_id").select(
        "id", T.clean(F.col("source_text")).alias("key"), F.col("unit_id").cast("string").alias("ref_id"), F.lit("tm").alias("kind"), F.lit(True).alias("exact"),
        F.col("score").cast("double").alias("score"), F.lit(None).cast("double").alias("raw"), F.col("rank").cast("long").alias("pos"))
    vector = vector_candidates(queries, chunks, files).select(
        "id", T.clean(F.col("source")).alias("key"), "ref_id", F.when(F.col("category") == "legal", "mandatory").otherwise("optional").alias("kind"), F.lit(False).alias("exact"),
        F.lit(0.0).alias("score"), F.col("cosine").alias("raw"), (F.col("rank") + _VECTOR).cast("long").alias("pos"))
    return exact.unionByName(vector).withColumn("prio", tm.priority(F.col("kind"), F.col("exact")))


def ranked(found: DataFrame, keep: int = 5) -> DataFrame:
    """``id, kind, ref_id, score, rank``: one candidate a source text, scored, cut at its threshold, the best ``keep``."""
    best = tm.priority_distinct(found, ["id", "key"], "prio", "pos")
    score = F.when(F.col("exact"), F.col("score").cast("int")).otherwise(S.relevance_score(F.col("raw")))
    least = S.threshold(F.col("kind"), F.lit(""))
    w = Window.partitionBy("id").orderBy(F.desc("final"), "first_position")
    return (best.withColumn("final", score).filter(F.col("exact") | (F.col("final") >= least)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
            .select("id", "kind", "ref_id", F.col("final").alias("score"), "rank"))


def usable_memory(segments: DataFrame) -> DataFrame:
    """Segments whose translation may serve another: translated or drafted by machine, with a target."""
    return segments.filter("target <> '' and status in ('translated', 'mt_draft') and source is not null and project_id is not null")


def internal_by_vector(queries: DataFrame, segments: DataFrame, k: int = 20, farthest: float = 0.5) -> DataFrame:
    """``id, ref_id, score``: other segments of the project among the ``k`` nearest, not farther than that, with another source."""
    memory = usable_memory(segments)
    stored = topk.usable(memory.withColumn("v", embedding(F.col("source"))), "id", "v", 64, "project_id")
    asked = topk.usable(queries.withColumn("v", embedding(F.col("source"))), "id", "v", 64, "project_id")
    near = topk.cosine_topk(asked, stored, k, scoped=True).filter(F.col("cosine") >= 1 - farthest).select(F.col("query_id").alias("id"), F.col("id").alias("ref_id"), "cosine")
    other = memory.select(F.col("id").alias("ref_id"), F.col("source").alias("other"))
    return (near.join(other, "ref_id").join(queries.select("id", "source"), "id").filter("other <> source")
            .select("id", "ref_id", F.floor(F.round(F.col("cosine") * 100, 6)).cast("int").alias("score")))


def fuzzy_search(queries: DataFrame, segments: DataFrame, least: float = 80.0, shortest: int = 5) -> DataFrame:
    """``id, ref_id, score``: all segments of a query's project whose text is at least so similar to its own, and another.

    The queries stand on every executor in blocks; a row meets the queries of its project.
    Lengths, and how many letters two texts can have in common at all, leave few pairs for
    the exact similarity; neither loses one.
    """
    spark = queries.sparkSession
    plain = T.strip_tags(F.col("source"))
    rows = usable_memory(segments).select("id", "project_id", plain.alias("text"))
    asked = queries.select("id", "project_id", plain.alias("text")).filter(F.length("text") >= shortest)
    blocks, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for b in range(blocks):
        block = [(r.id, r.project_id, r.text) for r in asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()]  # about QUERY_BLOCK rows
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            by: dict[str, list[tuple[str, str]]] = {}
            for i, scope, text in shared.value:
                by.setdefault(scope, []).append((i, text))
            known = {scope: (q, _letters([t for _, t in q]), np.array([len(t) for _, t in q])) for scope, q in by.items()}
            for pdf in batches:
                found = []
                for i, scope, text in pdf[["id", "project_id", "text"]].itertuples(index=False):
                    if scope not in known or text is None:
                        continue
                    q, letters, n = known[scope]
                    common = np.minimum(letters, _letters([text])).sum(1)
                    for k in np.flatnonzero(200.0 * common >= least * (n + len(text)) - 1e-6).tolist():
                        if q[k][0] != i and q[k][1] != text and (s := ratio(q[k][1], text)) >= least:
                            found.append((q[k][0], i, int(s)))
                yield pd.DataFrame(found, columns=["id", "ref_id", "score"]).astype({"id": object, "ref_id": object, "score": "int32"})

        part = rows.mapInPandas(run, "id string, ref_id string, score int")
        out = part if out is None else out.unionByName(part)
    return out


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text; letters share ``LETTERS`` places, so counts in common are never too low."""
    out = np.zeros((len(texts), LETTERS), np.int32)
    for k, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
        out[k] = np.bincount(codes.astype(np.int64), minlength=LETTERS)
    return out


def internal_matches(by_letters: DataFrame, by_vector: DataFrame, first: int = 5, keep: int = 3) -> DataFrame:
    """``id, ref_id, score, rank``: the ``first`` fuzzy ones and the vector ones that these do not have, the best ``keep`` of all."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "ref_id")
    fuzzy = by_letters.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= first).drop("rn")
    both = fuzzy.unionByName(by_vector.join(fuzzy.select("id", "ref_id"), ["id", "ref_id"], "left_anti"))
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def combined(queries: DataFrame, segments: DataFrame, units: DataFrame, chunks: DataFrame, files: DataFrame, terms: DataFrame,
             internal: DataFrame, internal_keep: int = 3) -> DataFrame:
    """``id, part, kind, ref_id, score, rank``: the ranked candidates, the internal ones and the terms of each query segment."""
    from tmloom.operators.glossary import phrase_hits

    main = ranked(candidates(queries, units, chunks, files)).withColumn("part", F.lit(1))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "ref_id")
    own = internal.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= internal_keep).select(
        "id", F.lit("internal").alias("kind"), "ref_id", "score", "rank", F.lit(2).alias("part"))
    hits = phrase_hits(queries.select("id", F.col("project_id").alias("scope"), "source"), terms)
    wt = Window.partitionBy("id").orderBy("at", "term_id")
    words = hits.select("id", F.lit("glossary").alias("kind"), F.col("term_id").alias("ref_id"), F.lit(100).alias("score"), F.row_number().over(wt).alias("rank"), F.lit(3).alias("part"))
    return main.unionByName(own).unionByName(words).select("id", "part", "kind", "ref_id", "score", "rank")
