"""Key columns: normalised spelling and the first delivery of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def norm_key(c: Column | str) -> Column:
    """A key as compared: lower case, no blanks around; a blank key is null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def first_delivery(df: DataFrame, arrived: str, *key: str, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``key`` columns with the earliest ``arrived`` (and least ``also``).

    Deliveries of one record have the same content, so the content columns a caller
    needs can be part of the key: all aggregates are then of fixed width, which
    keeps the aggregation a hash aggregation that combines on the map side.
    """
    return df.groupBy(*key).agg(*[F.min(c).alias(c) for c in (arrived, *also)])
