"""Models behind one interface, with deterministic stand-ins that need no network.

A provider offers some of: ``embed`` (texts to vectors), ``rank`` (a query and texts to
relevances from 0 to 1), ``translate`` (see ``generation.Model``) and ``terms`` (a pair of
texts to pairs of terms). Operators take a provider by name, so that another can be put in
its place without a change of theirs.

Defined cases: an unknown name is an error; texts without words have no vector and no
relevance; a provider that lacks a role, or fails, leaves exact candidates as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tmloom.functions.embedding import embedded
from tmloom.operators.generation import Model, echo

#: relevance of an internal candidate where there is nothing to rank with
INTERNAL_WITHOUT_RANK = 60


@dataclass(frozen=True)
class Provider:
    """What a model provider can do; a role it lacks is null."""

    translate: Model | None = None
    embed: Callable[[list[str]], list[list[float] | None]] | None = None
    rank: Callable[[str, list[str]], list[float]] | None = None
    terms: Callable[[str, str], list[tuple[str, str]]] | None = None


def relevances(query: str, texts: list[str]) -> list[float]:
    """The cosines of the stand-in vectors."""
    q = embedded(query)
    out = []
    for t in texts:
        v = embedded(t)
        out.append(0.0 if q is None or v is None else float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))))
    return out


def capitalised_terms(source: str, target: str, most: int = 3) -> list[tuple[str, str]]:
    """At most three pairs of the longer capitalised words of both texts, in their order."""
    words = lambda t: [w for w in dict.fromkeys(re.findall(r"\w+", t or "")) if w[0].isupper() and len(w) > 3]
    return list(zip(words(source), words(target)))[:most]


_KNOWN: dict[str, Provider] = {"offline": Provider(echo, lambda texts: [embedded(t) for t in texts], relevances, capitalised_terms)}


def register(name: str, provider: Provider) -> None:
    _KNOWN[name] = provider


def provider(name: str = "offline") -> Provider:
    if name not in _KNOWN:
        raise KeyError(f"no provider {name!r}; known are {sorted(_KNOWN)}")
    return _KNOWN[name]


def with_vectors(df: DataFrame, text: str, by: Provider, out: str = "embedding", size: int = 32) -> DataFrame:
    """``df`` with the vectors of a text column, asked for in batches; blank texts have none."""
    columns = [c for c in df.columns if c != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, vectors = pdf[text].tolist(), [None] * len(pdf)
            full = [k for k, t in enumerate(texts) if t is not None and t.strip()]
            for s in range(0, len(full), size):
                part = full[s:s + size]
                for k, v in zip(part, by.embed([texts[k] for k in part])):
                    vectors[k] = v
            yield pdf.assign(**{out: pd.Series(vectors, dtype=object, index=pdf.index)})

    schema = df.select(*columns).withColumn(out, F.lit(None).cast("array<double>")).schema
    return df.select(*columns).mapInPandas(run, schema)


def reranked(candidates: DataFrame, by: Provider) -> DataFrame:
    """``candidates`` (``id, query, key, exact, raw``) with ``raw`` from the provider, for those that are not exact.

    Without a ranking provider, or when it fails, only exact candidates stay. A segment's
    candidates are a short list, made by the retrieval.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = ~pdf["exact"].astype(bool)
        try:
            if by.rank is None:
                raise RuntimeError("no ranking")
            if todo.any():
                pdf.loc[todo, "raw"] = by.rank(pdf["query"].iloc[0], pdf.loc[todo, "key"].tolist())
            return pdf
        except Exception:
            return pdf[~todo]

    return candidates.groupBy("id").applyInPandas(run, candidates.schema)


def internal_scores(query: str, texts: list[str], by: Provider) -> list[int]:
    """Whole-number scores of internal candidates."""
    return [INTERNAL_WITHOUT_RANK] * len(texts) if by.rank is None else [int(r * 100) for r in by.rank(query, texts)]


def extracted_terms(pairs: DataFrame, by: Provider) -> DataFrame:
    """``segment_id, scope, term, target_term`` from rows of ``segment_id, scope, source, target``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, s, a, b) for i, s, x, y in pdf.itertuples(index=False) for a, b in by.terms(x, y)]
            yield pd.DataFrame(rows, columns=["segment_id", "scope", "term", "target_term"]).astype(object)

    return pairs.select("segment_id", "scope", "source", "target").filter("source is not null and target is not null").mapInPandas(
        run, "segment_id string, scope string, term string, target_term string")
