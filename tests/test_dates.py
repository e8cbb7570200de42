"""Dates to instants: spellings, zones, daylight saving, defined cases."""

import datetime as D

import pytest

from tmloom.functions.instants import with_instant
from tmloom.operators.dates import normalised_dates


def us(*a):
    return int((D.datetime(*a, tzinfo=D.timezone.utc) - D.datetime(1970, 1, 1, tzinfo=D.timezone.utc)) / D.timedelta(microseconds=1))


CASES = [
    ("2024-01-02T03:04:05Z", None, None, us(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02t03:04z", None, None, us(2024, 1, 2, 3, 4)),
    (" 2024-01-02 03:04:05,123456789 ", "UTC", None, us(2024, 1, 2, 3, 4, 5, 123456)),
    ("2024-01-02T03:04:05.123456789012345Z", None, None, us(2024, 1, 2, 3, 4, 5, 123456)),
    ("2024-01-02T03:04:05Z\x01", None, None, None),
    ("2024-01-02T03:04:05.5+05:45", None, None, us(2024, 1, 1, 21, 19, 5, 500000)),
    ("2024-01-02 03:04-05", None, None, us(2024, 1, 2, 8, 4)),
    ("20220327T020502Z", None, None, us(2022, 3, 27, 2, 5, 2)),
    ("02.10.2023, 05:41:14", "Europe/Berlin", None, us(2023, 10, 2, 3, 41, 14)),
    ("4. August 2022, 02:03:42 Uhr", "Europe/Berlin", "en-US", us(2022, 8, 4, 0, 3, 42)),
    ("Mon, 26 Jun 2023 22:39:23 +0200", None, None, us(2023, 6, 26, 20, 39, 23)),
    ("11/30/2023 4:45:05 PM", "UTC", "en-US", us(2023, 11, 30, 16, 45, 5)),
    ("04/03/2022 12:17 AM", "UTC", "en-GB", us(2022, 3, 4, 0, 17)),
    ("07/04/2022 17:16:18", "UTC", None, None),
    ("07/04/2022 17:16:18", "UTC", "de-DE", None),
    ("14/02/2022 13:02:13", "UTC", "en-US", None),
    ("1658850354", None, None, 1658850354 * 10**6),
    ("1675234555216", None, None, 1675234555216 * 10**3),
    ("1692215800773437", None, None, 1692215800773437),
    ("2024-07-23 05:24:07 CEST", "Europe/London", None, us(2024, 7, 23, 3, 24, 7)),
    ("2024-07-23 05:24 EDT", None, None, us(2024, 7, 23, 9, 24)),
    ("2024-07-23 05:24 IST", None, None, None),
    ("2024-09-02T06:27[Europe/Berlin]", "UTC", None, us(2024, 9, 2, 4, 27)),
    ("2022-09-15 01:05 Australia/Sydney", None, None, us(2022, 9, 14, 15, 5)),
    ("2024-03-31 02:28:38", "Europe/Berlin", None, None),  # does not exist
    ("2024-03-31 03:00", "Europe/Berlin", None, us(2024, 3, 31, 1)),
    ("2024-03-31 01:59:59", "Europe/Berlin", None, us(2024, 3, 31, 0, 59, 59)),
    ("2024-10-27 02:30", "Europe/Berlin", None, None),  # occurs twice
    ("2024-10-27T02:42+02", "Europe/Berlin", None, us(2024, 10, 27, 0, 42)),
    ("2024-10-27 03:00", "Europe/Berlin", None, us(2024, 10, 27, 2)),
    ("2024-10-27 01:59", "Europe/Berlin", None, us(2024, 10, 26, 23, 59)),
    ("2023-02-30 10:15", "UTC", None, None),
    ("2024-02-29 10:15", "UTC", None, us(2024, 2, 29, 10, 15)),
    ("1900-02-29 10:15", "UTC", None, None),
    ("2024-03-12T25:10:00Z", None, None, None),
    ("0000-00-00 00:00:00", "UTC", None, None),
    ("2024-01-02", "UTC", None, None),
    ("2024-01-02 03:04", None, None, None),
    ("2024-01-02 03:04", "Mars/Base", None, None),
    ("today", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None), ("x" * 5000, "UTC", "en-US", None),
]


def test_spellings(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "n int, text string, zone string, locale string")
    got = {r.n: r.utc_us for r in with_instant(df, "text", "zone", "locale").collect()}
    assert [(CASES[i][0], v) for i, v in sorted(got.items())] == [(c[0], c[3]) for c in CASES]


SEGMENTS = "id string, metadata_json string"


@pytest.mark.parametrize("meta, want", [
    ('{"metadata": {"revisions": [null, {"date": "2024-01-02T03:04:05Z"}, {"text": "x"}]}}', [("revision", 1)]),
    ('{"metadata": {"revision_stages": {"date": "2024-01-02T03:04:05Z"}}}', [("stage", 0)]),
    ('"{\\"metadata\\": {\\"revisions\\": [{\\"date\\": \\"2024-01-02T03:04:05Z\\"}]}}"', [("revision", 0)]),
    ('﻿{"metadata": {"revisions": [{"date": "2024-01-02T03:04:05Z"}]}}', [("revision", 0)]),
    ('{"metadata": {"revisions": [{"date": "2024-01-02T03:04:05Z"}', []),
    ("", []), (None, []), ("null", []), ("[]", []), ('{"metadata": null, "revisions": 1}', []), ('{"metadata": {"revisions": 7, "revision_stages": "x"}}', []),
])
def test_metadata_forms(spark, meta, want):
    seg = spark.createDataFrame([("a", meta), ("a", meta)], SEGMENTS)
    req = spark.createDataFrame([], "request_id long, tc_date string, client_tz string, client_locale string")
    assert sorted((r.origin, r.pos) for r in normalised_dates(req, seg).collect()) == want
