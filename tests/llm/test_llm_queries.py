"""Every pN_ query runs over the smallest tables, with exactly the columns it must have."""

import pytest

from foliant.llm import queries

COLUMNS = {
    "p1_found": ["kind", "record_id", "lang"], "p2_found": ["kind", "record_id", "defect"], "p3_found": ["job_id", "idx"], "p4_found": ["kind", "book_id", "idx"],
    "p5_found": ["book_id", "page_number", "block_ix", "noise"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = df.collect()
    if name.endswith("_found"):
        assert rows and len(set(rows)) == len(rows)
