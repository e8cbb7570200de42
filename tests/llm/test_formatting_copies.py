"""Formatting copies: against a plain grouping, hot groups, defined cases."""

import collections
import random

import regex
from pyspark.sql import functions as F

from tmloom.llm.formatting_copies import canonical, copy_counts, formatting_copies, keyed_records


def bare(s):
    s = regex.sub(r"(?<=\d),(?=\d)", "\x11", s)
    s = regex.sub(r"(?<=\d)\.(?=\d)", "\x12", s)
    return regex.sub(r"[\p{P}\s​-‏⁠-⁤﻿\xad]+", "", s).upper().lower()


def canon(s):
    s = regex.sub(r"</?\d+\s*/?>", "", s)
    fields = []
    for p in regex.split(r"[;|\r\n]+", s):
        if bare(p):
            if ":" in p and regex.match(r"\W*[^\d\W]", p) or not fields:
                fields.append(p)
            else:
                fields[-1] += " " + p
    if len(fields) >= 2 and all(":" in p for p in fields):
        return tuple(sorted(tuple(bare(x) for x in p.split(":", 1)) for p in fields))
    return bare(s)


def groups(rows):
    g = collections.defaultdict(set)
    for i, p, t in rows:
        if t is not None:
            g[(p or "").strip().lower(), canon(t)].add(str(i))
    return {(min(ids), x) for ids in g.values() for x in ids if x != min(ids)}


def found(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "id string, project_id string, text string").withColumn("canon", F.lit("clash"))
    return sorted((r.keep_id, r.copy_id) for r in formatting_copies(keyed_records(df, "t", "id", "project_id", "text"), partitions).collect())


CASES = [
    ("Only 5 of the targets – mainly here.", "ONLY 5 ​of <1>the</1> targets - mainly here!", True),
    ("Costs 1.5 percent", "Costs 15 percent", False), ("Costs 12,300", "Costs 12300", False), ("Costs 1,5.", "costs 1,5", True),
    ("Straße", "STRASSE", True), ("co-financing", "co financing", True), ("A: 1; B: 2", "b: 2 | a: 1.", True), ("A: 1; B: 2", "A: 1; B: 3", False),
    ("A: 1; B: 2", "A: 1\nB:\n2", True), ("A: x y; B: 2", "B: 2\nA: x\ny", True), ("Note: first; second", "second; Note: first", False),
    ("ab: c; d: e", "a: bc; d: e", False), ("...", "–", True), ("", " 　", True), ("Name: 12:30; B: 1", "b: 1; name: 12:30", True),
]


def test_pairs(spark):
    for a, b, same in CASES:
        assert (canon(a) == canon(b)) is same, (a, b)
    df = spark.createDataFrame([(a, b) for a, b, _ in CASES], "a string, b string").select((canonical(F.col("a")) == canonical(F.col("b"))).alias("x"))
    assert [r.x for r in df.collect()] == [c[2] for c in CASES]


def test_hot_group_over_many_partitions(spark):
    random.seed(1)
    rows = [(f"h{i:04d}", "p", random.choice(["Same text.", "same  TEXT", "«same» text!"])) for i in range(400)]
    rows += [(f"x{i:04d}", random.choice(["p", " P", "q", None]), f"Text {i % 150}") for i in range(600)]
    rows += rows[::7] + [("n1", "p", None)]
    want = sorted(groups(rows))
    for partitions in (1, 3, 16):
        assert found(spark, rows, partitions) == want


def test_counts_and_empty(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([("2", "p", "a"), ("10", "p", "A."), ("10", "p", "A."), ("3", "p", "a!" * 1)], "id string, project_id string, text string")
    got = copy_counts(formatting_copies(keyed_records(df, "t", "id", "project_id", "text"))).collect()
    assert [tuple(r) for r in got] == [("t", "10", 3)]
    long = "word " * 200_000
    assert found(spark, [("1", "p", long), ("2", "p", long.upper())]) == [("1", "2")]
