"""The offline stand-in for an embedding model: a hashed bag of words.

Two texts are near each other if they share words. The numbers are counts, so the same
text has the same vector everywhere. Defined cases: null and wordless texts give null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

DIM = 64
_WORD = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=1 << 16)
def bucket(word: str) -> int:
    return hashlib.md5(word.encode()).digest()[0] % DIM


def embedded(text: str | None) -> list[float] | None:
    """The counts of the words of a text, letter case aside, in ``DIM`` buckets."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return None
    out = [0.0] * DIM
    for w in words:
        out[bucket(w)] += 1.0
    return out


def _embedded(c: pd.Series) -> pd.Series:
    return pd.Series([embedded(x) for x in c], dtype=object)


def embedding(c: Column) -> Column:
    """The vector of a text column, in Arrow batches; made on use, as workers import this module without a session."""
    return pandas_udf(_embedded, ArrayType(DoubleType()))(c)
