"""Scores of translation matches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BAND = (0.75, 0.99)
ORIGIN_SCORES = {"mandatory": 100, "user": 99}
OTHER_ORIGIN_SCORE = 98


def relevance_score(raw: Column, low: float = BAND[0], high: float = BAND[1]) -> Column:
    """A re-ranker's relevance on 0-100: logarithmic between ``low`` and ``high``."""
    t = (raw - low) / max(high - low, 1e-6)
    return F.when(t <= 0, 0).when(t >= 1, 100).otherwise(F.bround(F.log1p(9 * t) / F.log(F.lit(10.0)) * 100).cast("int"))


def origin_score(origin: Column) -> Column:
    out = F
    for name, score in ORIGIN_SCORES.items():
        out = out.when(F.lower(origin) == name, score)
    return out.otherwise(OTHER_ORIGIN_SCORE)


def threshold(kind: Column, category: Column, mandatory: int = 60, optional: int = 40, tm: int = 60) -> Column:
    """The least score at which a match is shown."""
    return F.when((kind == "mandatory") | (category == "legal"), mandatory).when(category == "tm", tm).otherwise(optional)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off; 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100)).otherwise(0).cast("int")


def percent_rounded(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(0).cast("int")


def chain_score(distance: Column, step: int = 5, floor: int = 70) -> Column:
    """Score of an earlier stage by its distance."""
    return F.greatest(99 - (distance - 1) * step, F.lit(floor)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length in double arithmetic."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
