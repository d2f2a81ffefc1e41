"""Every query runs; those with SQL agree with DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from foliant.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    df = QUERIES[name](spark, data)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in SQL:
        return
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == columns
    got = Counter(repr(tuple(r[c] for c in columns)) for r in rows)
    want = Counter(repr(tuple(r[rel.columns.index(c)] for c in columns)) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "part", "side", "text"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_core_needs_no_subpackage():
    import pathlib
    import re

    for p in pathlib.Path(catalogue.__file__).parent.parent.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"^\s*(?:from|import)\s+\S*\bllm\b", p.read_text(), re.M), p
