"""Operators with SQL against it on the smallest tables."""

import duckdb
import pytest

from strandwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(ORACLES[name])
    assert columns == sorted(x[0] for x in want.description)
    places = [[x[0] for x in want.description].index(c) for c in columns]
    rows = lambda each: sorted(map(str, each))
    assert rows(tuple(r[c] for c in columns) for r in found.collect()) == rows(tuple(r[k] for k in places) for r in want.fetchall())
