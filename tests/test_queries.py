"""Every query of the core against its SQL counterpart, or its shape where SQL cannot say it."""

import pytest

from tests.oracle import rows, sql_rows
from tmloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        columns, want = sql_rows(ORACLES[name], sf)
        assert sorted(df.columns) == columns
        assert got == want
