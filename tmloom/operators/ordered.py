"""Operators over the order of rows in a group, without one task per group.

A group may hold a third of all rows, so none of these sorts a whole group in one
task: the order column is cut into buckets, the work is done per (group, bucket),
and what crosses the buckets is carried by one small row per bucket.

Defined cases: rows with a null group or order value are dropped; equal order values
are told apart by the tie column; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET = 4096


def _bucketed(df: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    keep = F.col(order).isNotNull()
    for g in group:
        keep = keep & F.col(g).isNotNull()
    return df.filter(keep).withColumn("__bucket", F.floor(F.col(order) / size))


def spread(df: DataFrame, group: list[str], order: str, size: int = BUCKET) -> int:
    """The width of a bucket that holds about ``size`` rows of the largest group; ``size`` where its order values lie close.

    One pass over the groups; only the largest group's density comes to the driver.
    """
    span = df.filter(F.col(order).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), (F.max(order) - F.min(order) + 1).alias("s"))
    most = span.agg(F.max(F.struct("n", "s")).alias("m")).first().m
    return size if most is None else max(size, int(size * (most.s / most.n)))


def positions(df: DataFrame, group: list[str], order: str, tie: str, out: str = "position", size: int | None = BUCKET) -> DataFrame:
    """``df`` with the zero-based place of each row in its group.

    Where order values may lie far apart, ``size`` None takes the width of the buckets from
    them, so that a group never has a bucket for each row.
    """
    b = _bucketed(df, group, order, spread(df, group, order) if size is None else size)
    before = b.groupBy(*group, "__bucket").agg(F.count("*").alias("__n")).withColumn(
        "__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(order, tie)) - 1
    return b.withColumn("__place", place).join(before.drop("__n"), [*group, "__bucket"]).withColumn(
        out, (F.col("__place") + F.col("__before")).cast("bigint")).drop("__bucket", "__place", "__before")


def framed(df: DataFrame, group: list[str], order: str, frames: dict[str, tuple[Column, int, int]], tie: str, size: int = BUCKET) -> DataFrame:
    """``df`` with lists over frames of order values.

    ``frames`` maps an output column to (value, from, to), relative to the row's own
    order value. Rows near the edge of a bucket stand in the next bucket as well, so
    each bucket sees all it needs; the width must be less than the bucket.
    """
    width = max(max(abs(a), abs(z)) for _, a, z in frames.values())
    if width >= size:
        raise ValueError("frame wider than the bucket")
    b = _bucketed(df, group, order, size)
    copies = F.array_distinct(F.array(F.floor((F.col(order) - width) / size), F.col("__bucket"), F.floor((F.col(order) + width) / size)))
    b = b.withColumn("__in", F.explode(copies))
    w = Window.partitionBy(*group, "__in").orderBy(F.col(order).cast("bigint"))
    for name, (value, a, z) in frames.items():
        # the tie inside one order value is settled by sorting the list
        listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), value.alias("v"))).over(w.rangeBetween(a, z)))
        b = b.withColumn(name, F.transform(listed, lambda s: s["v"]))
    return b.filter(F.col("__in") == F.col("__bucket")).drop("__in", "__bucket")


def last_values(df: DataFrame, group: list[str], order: str, tie: str, value: Column, k: int, out: str, size: int = BUCKET) -> DataFrame:
    """``df`` with the last ``k`` values that are not null before each row, in order."""
    b = _bucketed(df, group, order, size).withColumn("__v", value)
    # the k values before a row, one by one, so that no list of all earlier ones is ever made
    over = f"over (partition by {', '.join(f'`{c}`' for c in [*group, '__bucket'])} order by `{order}`, `{tie}`)"
    b = b.withColumn("__own", F.array_compact(F.array(*[F.expr(f"lag(__v, {n}) ignore nulls {over}") for n in range(k, 0, -1)])))
    item = F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), F.col("__v").alias("v"))
    tails = b.groupBy(*group, "__bucket").agg(F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), item))).alias("__all")).select(
        *group, "__bucket", F.transform(F.slice("__all", F.greatest(F.size("__all") - k + 1, F.lit(1)), k), lambda s: s["v"]).alias("__tail"))
    # the last k values lie in the last k buckets that have any: number those even, the empty ones odd between them
    filled = (F.size("__tail") > 0).cast("int")
    rank = F.sum(filled).over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))
    tails = tails.withColumn("__no", (2 * rank + 1 - filled).cast("bigint"))
    earlier = F.collect_list(F.struct(F.col("__bucket").alias("b"), F.col("__tail").alias("t"))).over(
        Window.partitionBy(*group).orderBy("__no").rangeBetween(-2 * k, -1))
    tails = tails.withColumn("__carry", F.flatten(F.transform(F.array_sort(earlier), lambda s: s["t"]))).drop("__tail", "__no")
    both = F.concat("__carry", "__own")
    return (b.join(tails, [*group, "__bucket"]).withColumn(out, F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), k))
            .drop("__v", "__own", "__carry", "__bucket"))


def batches(df: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """``group, order, run_start, batch``: contiguous runs of order values, cut into batches of ``size``."""
    distinct = df.select(*group, order).distinct()
    at = positions(distinct, group, order, order).withColumn("__island", F.col(order) - F.col("position"))
    starts = at.groupBy(*group, "__island").agg(F.min(order).alias("run_start"))
    return at.join(starts, [*group, "__island"]).select(*group, order, "run_start", F.floor((F.col(order) - F.col("run_start")) / size).cast("bigint").alias("batch"))


def sessions(df: DataFrame, group: list[str], time: str, tie: str, gap_seconds: int, change: str | None = None) -> DataFrame:
    """``df`` with ``session``: a new one after a gap, or where ``change`` differs from the row before.

    Rows without a time are dropped. Two-level: a session number within a day of
    the group, and the number of sessions of earlier days; the first row of a day is
    compared with the last of the day before that has rows.
    """
    day = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 86_400_000_000)
    b = df.filter(F.col(time).isNotNull()).withColumn("__us", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("__day", day)
    w = Window.partitionBy(*group, "__day").orderBy("__us", tie)
    mark = F.col(change) if change else F.lit(0)
    b = b.withColumn("__mark", mark).withColumn("__prev", F.lag("__us").over(w)).withColumn("__prev_mark", F.lag("__mark").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    edges = b.groupBy(*group, "__day").agg(F.max(F.struct("__us", tie, "__mark")).alias("__last"))
    wd = Window.partitionBy(*group).orderBy("__day")
    edges = edges.withColumn("__before", F.lag("__last").over(wd)).drop("__last")
    b = b.join(edges, [*group, "__day"])
    prev = F.when(F.col("__first"), F.col("__before.__us")).otherwise(F.col("__prev"))
    prev_mark = F.when(F.col("__first"), F.col("__before.__mark")).otherwise(F.col("__prev_mark"))
    starts = prev.isNull() | (F.col("__us") - prev >= gap_seconds * 1_000_000) | ~prev_mark.eqNullSafe(F.col("__mark"))
    b = b.withColumn("__start", starts.cast("int"))
    days = b.groupBy(*group, "__day").agg(F.sum("__start").alias("__n")).withColumn(
        "__base", F.coalesce(F.sum("__n").over(wd.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    run = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    temp = [c for c in ("__us", "__day", "__mark", "__prev", "__prev_mark", "__first", "__before", "__start", "__base", "__run")]
    return b.withColumn("__run", run).join(days, [*group, "__day"]).withColumn("session", (F.col("__run") + F.col("__base")).cast("bigint")).drop(*temp)
