"""Orphan references: reasons, spellings of keys, deliveries, empty tables."""

import datetime as D

from tmloom.operators.references import Reference, orphan_report, orphans

T = D.datetime(2024, 1, 10)
REF = Reference("kids", "id", "pid", "at", "parents")
KIDS = "id string, pid string, at timestamp_ntz, arrived_at timestamp_ntz, extra string"
PARENTS = "id string, arrived_at timestamp_ntz, reason string"
LOG = "table_name string, row_id string"


def run(spark, kids, parents, log):
    found = orphans(spark.createDataFrame(kids, KIDS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(log, LOG), REF)
    return found


def test_reasons(spark):
    day = D.timedelta(days=1)
    kids = [("1", " P1 ", T, T, None), ("2", "p2", T, T, None), ("3", "P3", T, T, None), ("4", "p4", None, T, None), ("5", " ", T, T, None), ("6", None, T, T, None),
            ("7", "p1", T, T + 9 * day, None), ("7", "p1", T, T - day, None), ("8", "p5", T, None, None)]
    parents = [("p1", T, None), ("P1", T + day, None), ("p3", T + day, None), ("p5", T, None), (None, T, None)]
    log = [("parents", "P2 "), ("parents", "p2"), ("parents", "p1"), ("other", "p4"), ("parents", None)]
    got = sorted((r.child_id, r.reason, r.period) for r in run(spark, kids, parents, log).collect())
    assert got == [("2", "deleted", "2024-01"), ("3", "late", "2024-01"), ("4", "missing", None), ("7", "late", "2024-01")]


def test_empty_and_report(spark):
    assert run(spark, [], [], []).count() == 0
    found = run(spark, [(str(i), "gone", T, T, None) for i in range(5)], [], [])
    assert [tuple(r) for r in orphan_report(found).collect()] == [("kids", "2024-01", "missing", 5, 1)]
