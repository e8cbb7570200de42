"""Every query of the training-data operators runs and has the columns it must have."""

import pytest

from tests.oracle import rows, sql_rows
from tmloom.llm import plans

COLUMNS = {"p1_found": ["file_id", "source_index", "target_index"], "p2_found": ["record_table", "keep_id", "copy_id"], "p5_found": ["low_id", "high_id"],
           "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in plans.ORACLES:
        columns, want = sql_rows(plans.ORACLES[name], sf)
        assert sorted(df.columns) == columns
        assert rows(df.columns, [tuple(r) for r in got]) == want
