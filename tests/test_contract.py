"""Every contract query against its SQL on the smallest tables."""

import duckdb
import pytest

from strandwise import contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        made.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return made


@pytest.mark.parametrize("name", list(contract.QUERIES))
def test_query(spark, con, name):
    got = contract.QUERIES[name](spark, SF).toPandas()
    want = con.execute(contract.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert len(got) == len(want)
    assert order(got).equals(order(want))
