"""Operators over the order of rows: against a plain sort, with sparse and dense order values."""

import random

from pyspark.sql import functions as F

from tmloom.operators import ordered as O


def rows(spark, step):
    rng = random.Random(9)
    data = [("g" if i % 3 else "h", i * step + rng.randrange(2), f"r{i:03d}", rng.choice([None, f"v{i}"])) for i in range(200)] + [("g", None, "x", "v"), (None, 1, "y", "v")]
    return data, spark.createDataFrame(data, "grp string, o long, id string, v string")


def expected(data, k):
    out = {}
    for g in ("g", "h"):
        seen = []
        for n, (_, o, i, v) in enumerate(sorted((r for r in data if r[0] == g and r[1] is not None), key=lambda r: (r[1], r[2]))):
            out[i] = (n, seen[-k:])
            if v is not None:
                seen = seen + [v]
    return out


def test_positions_and_last_values(spark):
    for step in (1, 1_000_003):
        data, df = rows(spark, step)
        want = expected(data, 3)
        for size in (7, None):
            got = {r.id: r.position for r in O.positions(df, ["grp"], "o", "id", size=size).collect()}
            assert got == {i: n for i, (n, _) in want.items()}
        got = {r.id: r.h for r in O.last_values(df, ["grp"], "o", "id", F.col("v"), 3, "h", size=11).collect()}
        assert got == {i: h for i, (_, h) in want.items()}


def test_buckets_follow_the_values(spark):
    _, df = rows(spark, 1_000_003)
    width = O.spread(df, ["grp"], "o", 50)
    assert df.filter("o is not null").select(F.floor(F.col("o") / width)).distinct().count() <= 8
    assert O.spread(df.limit(0), ["grp"], "o", 50) == 50
