"""String similarity that the built-in functions do not have, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one big-integer step per letter of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """Similarity by insertions and deletions, 0 to 100; two empty texts are alike."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity of two columns; the function is made on use, as workers import this module without a session."""
    return pandas_udf(_ratios, DoubleType())(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
